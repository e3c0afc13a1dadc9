import math

import duckdb
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from siftwright.llm import url_filter as U

PAGE = "page_id long, url string"
#: The contract's host, path and rule in SQL.
SQL = r"""
with p as (select page_id, url, regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1) as h, regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path from pages),
u as (select page_id, coalesce(translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host, coalesce(path, '') as path from p),
r(rule, verdict, rh, rp) as (values ('com/en/', 'block', 'com', '/en/'), ('example.com/en/7', 'allow', 'example.com', '/en/7'), ('net/de/', 'allow', 'net', '/de/'), ('example.net/de/8', 'block', 'example.net', '/de/8'), ('org/es/', 'block', 'org', '/es/')),
m as (select page_id, rule, verdict, row_number() over (partition by page_id order by length(rule) desc) as k from u join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select u.page_id, host, path, rule, verdict from u left join m on m.page_id = u.page_id and k = 1
"""


def test_host_path_and_rule_equal_the_sql(spark):
    pages = "/root/testdata/sf0.1/pages.parquet"
    duckdb.sql(f"create or replace view pages as select * from '{pages}'")
    want = {r[0]: r[1:] for r in duckdb.sql(SQL).fetchall()}
    got = U.judge_urls(spark.read.parquet(pages), U.RULES).collect()
    assert len(got) == len(want) and sum(r.rule is not None for r in got) > 100
    for r in got:
        host, path, rule, verdict = want[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)


def plain(url, host, path):
    n = len(url)
    query = url.split("?", 1)[1].split("#")[0] if "?" in url else ""
    return {
        "f_length": n, "f_host_length": len(host), "f_path_length": len(path), "f_depth": path.count("/"), "f_labels": len(host.split(".")) if host else 0,
        "f_digit_ratio": sum(c in "0123456789" for c in url) / n if n else 0.0, "f_entropy": -sum(url.count(c) / n * math.log2(url.count(c) / n) for c in set(url)) if n else 0.0,
        "f_params": len(query.split("&")) if query else 0, "f_hyphens": url.count("-"), "f_fragment": int("#" in url), "suffix": host.rsplit(".", 1)[-1],
    }


def test_features_equal_the_plain_ones(spark):
    urls = ["", "x", "http://a-b.Example.com/p/1?q=2&r=3#f-1", "https://é.org//a//b?x", "ftp://h", "u://h/" + "a1-" * 3000, "no/scheme?a&b&c"]
    rows = spark.createDataFrame(list(enumerate(urls)), PAGE)
    host, path = U.url_parts(F.col("url"))
    for r in U.features(rows.withColumns({"host": host, "path": path})).collect():
        for k, v in plain(r.url, r.host, r.path).items():
            assert r[k] == (v if isinstance(v, str) else pytest.approx(v)), (r.url, k)


def test_expressions_equal_the_trees(spark, monkeypatch):
    """The SQL of the trees gives what the fitted model itself predicts."""
    kept = []

    class Kept(U.GBTClassifier):
        def fit(self, rows):
            kept.append(super().fit(rows))
            return kept[-1]

    monkeypatch.setattr(U, "GBTClassifier", Kept)
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    host, path = U.url_parts(F.col("url"))
    urls = pages.withColumns({"host": host, "path": path}).where("url is not null")
    urls = urls.withColumn("blocked", (F.length("url") % 3 == 0).cast("int"))
    p, table = U.train(urls.select("page_id", "url", "host", "path", "blocked"))
    x = U.with_suffix(U.features(urls), table, table[-1][2])
    names = [c for c in x.columns if c.startswith("f_")]
    both = kept[0].transform(VectorAssembler(inputCols=names, outputCol="x").transform(x)).select(p.alias("own"), vector_to_array("probability")[1].alias("model")).collect()
    assert len(both) > 1000 and all(r.own == pytest.approx(r.model, abs=1e-9) for r in both)


def test_defined_results(spark):
    long = "http://a.com/en/" + "x/" * 50_000
    rows = [(None, "http://a.com/en/1"), (1, "http://b.org/q"), (1, "http://b.org/q"), (2, None), (3, ""), (4, long), (5, "http://c.net/de/1")]
    pages = spark.createDataFrame(rows, PAGE)
    for name in ("host", "path", "rule", "verdict", "suffix", "f_length", "f_suffix_share", "blocked"):
        pages = pages.withColumn(name, F.lit("clash"))
    got = U.judge_urls(pages, U.RULES).collect()
    assert len(got) == len(rows) and sorted((r.page_id or 0, r.rule) for r in got if r.rule) == [(0, "com/en/"), (4, "com/en/"), (5, "net/de/")]
    assert len({r.verdict for r in got if r.page_id == 1}) == 1 and all(r.host == r.path == "" for r in got if r.page_id in (2, 3))
    assert U.judge_urls(pages.where("false"), U.RULES).count() == 0
    assert {r.verdict for r in U.judge_urls(pages.where("page_id = 1"), U.RULES).collect()} == {"allow"}
    assert {r.rule for r in U.judge_urls(pages, []).collect()} == {None}
