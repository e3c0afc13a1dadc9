"""Corpora made from tables: docs(rel, size, sha, body). The SQL of each holds in either engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCS_SQL = "select lang || '/' || source || '/' || cast(doc_id as string) || '.txt' as rel, text as body from documents where text is not null"
CODE_SQL = """select 'src/' || lower(replace(p_type, ' ', '_')) || '/m' || cast(p_partkey as string) || '.py' as rel,
 'import base' || chr(10) || 'from core.b' || cast(p_size as string) || ' import helper, Base' || cast(p_size as string) || chr(10) || chr(10)
 || 'class Part' || cast(p_partkey as string) || '(Base' || cast(p_size as string) || '):' || chr(10) || '    def price_' || cast(p_size as string) || '(self):' || chr(10)
 || '        return helper(' || cast(p_partkey as string) || ')' || chr(10) || chr(10) || '    def name_' || cast(p_partkey % 7 as string) || '(self):' || chr(10)
 || '        return self.price_' || cast(p_size as string) || '()' || chr(10) || chr(10) || 'def make_' || cast(p_partkey % 11 as string) || '():' || chr(10) || '    return Part' || cast(p_partkey as string) || '()' || chr(10)
 || 'LIMIT_' || cast(p_size as string) || ' = ' || cast(p_partkey as string) || chr(10) as body from part"""
SCRIPT_SQL = """select 'web/' || lower(replace(p_type, ' ', '_')) || '/w' || cast(p_partkey as string) || '.ts' as rel,
 'export abstract class Part' || cast(p_partkey as string) || '<T> extends core.Base' || cast(p_size as string) || ' {' || chr(10) || '  private static async price' || cast(p_size as string) || '(x: number): number {' || chr(10)
 || '    if (x) {' || chr(10) || '      const twice = x * 2;' || chr(10) || '    }' || chr(10) || '  }' || chr(10) || '}' || chr(10) || 'export interface Shape' || cast(p_partkey % 11 as string) || ' { }' || chr(10)
 || 'export default async function make' || cast(p_partkey % 7 as string) || '() {' || chr(10) || '  run(1) {' || chr(10) || '}' || chr(10) || 'let limit' || cast(p_size as string) || ': number = ' || cast(p_partkey as string) || ';' as body from part"""
ASKED_SQL = """select p_partkey as qid, 'Why does `Part' || cast(p_partkey as string) || '.price_' || cast(p_size as string) || '()` of Acme Tools & Sons, fail with Size' || cast(p_size as string) || 'Error for order INV-' || cast(10000 + p_partkey as string)
 || ' since 2024-07, see https://example.com/a.b and "' || p_name || ' now" with --dry-run? File "src/core/m' || cast(p_partkey as string) || '.py", line 3, in make_part' as body from part"""
CONV_SQL = "select 'conv/' || cast(conv_id as string) || '.md' as rel, string_agg('## ' || role || chr(10) || coalesce(text, ''), chr(10)) within group (order by turn) as body from conversations group by conv_id"
PAGES_SQL = r"select regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', '') || '.html' as rel, html as body from pages where url is not null"


def corpus(spark: SparkSession, sf_dir: str, sql: str, table: str) -> DataFrame:
    """docs(rel, size, sha, body) of one of the corpora above."""
    spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return as_docs(spark.sql(sql))


def as_docs(found: DataFrame) -> DataFrame:
    body = F.col("body")
    return found.select("rel", F.octet_length(body).cast("long").alias("size"), F.sha2(body.cast("binary"), 256).alias("sha"), "body")
