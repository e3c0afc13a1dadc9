"""The training-corpus pipeline: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm import decontaminate, jaccard_join, language_mix, line_dedup, mix_sources
from siftwright.llm.store import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents in which no language is found (no text, or no letter) go; the others get the found language."""
    langs, table = language_mix.fit(docs.where(~language_mix.held_out()))
    found = language_mix.predict(docs, langs, table, keep=tuple(docs.columns)).where("lang_pred <> 'und'")
    return found.select(*((F.col("lang_pred") if c == "lang" else F.col("row").getField(c)).alias(c) for c in docs.columns))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines of repeated three-line windows go; documents that lose all their lines go."""
    return line_dedup.without_repeats(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of linked documents the one of the smallest doc_id stays."""
    groups = jaccard_join.jaccard_components(docs)
    gone = groups.where("component_id <> doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: how many words of each document the mix takes."""
    return mix_sources.mix(docs)


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("jaccard_join", dedup_documents), ("decontamination", decontaminate_documents), ("mix_sources", mix)]

#: Language ID, the join's verification and the latent search are trained or iterative: tested by brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's result is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
