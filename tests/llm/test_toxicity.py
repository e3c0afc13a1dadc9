import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwright.llm import toxicity as T
from siftwright.llm import words as W

TEXT = "doc_id long, text string"


def test_slopes_are_those_of_the_risk():
    rng = np.random.default_rng(2)
    for prior in (0.05, 0.5, 0.9):
        zp, zu = rng.normal(1, 2, 7), rng.normal(-1, 2, 11)
        first, second = T.risk(zp, zu, prior)
        assert first == pytest.approx(prior * sum(np.log(1 + np.exp(-z)) for z in zp) / 7)
        assert second == pytest.approx(sum(np.log(1 + np.exp(z)) for z in zu) / 11 - prior * sum(np.log(1 + np.exp(z)) for z in zp) / 7)
        # Where the corrected part is below zero, the step goes against it alone.
        worth = (lambda a, b: sum(T.risk(a, b, prior))) if second >= 0 else (lambda a, b: -T.risk(a, b, prior)[1])  # noqa: B023
        gp, gu = T.slopes(zp, zu, prior)
        for i, (g, which) in enumerate([*((g, 0) for g in gp), *((g, 1) for g in gu)]):
            at = i if which == 0 else i - 7
            up, down = [zp.copy(), zu.copy()], [zp.copy(), zu.copy()]
            up[which][at] += 1e-5
            down[which][at] -= 1e-5
            assert g == pytest.approx((worth(*up) - worth(*down)) / 2e-5, abs=1e-6)


def test_scores_are_plain_sums(spark):
    weights = np.random.default_rng(1).normal(0, 1, T.BUCKETS).astype(np.float32)
    text = "Some words, some more WORDS; wordings über 12 a"
    import pyarrow as pa

    (_, data, offsets), = W.chunks(pa.RecordBatch.from_pydict({"text": [text, ""]}))
    rows, buckets = T.features(data, offsets)
    found = {w.lower().encode() for w in re.findall(r"[A-Za-z\x80-\U0010ffff]+", text)}
    parts = {(n, w[:n]) for w in found for n in T.PREFIXES if len(w) > n}
    assert len(buckets) == len(set(buckets)) == len(found) + len(parts) and set(rows) == {0}
    assert T._Rows([buckets, buckets[:0]], T.BUCKETS).times(weights, 0.5).tolist() == pytest.approx([float(weights[buckets].sum()) + 0.5, 0.5], rel=1e-4)


def test_the_best_bin_finds_the_prior():
    rng = np.random.default_rng(5)
    for prior in (0.05, 0.2, 0.6):
        positive = rng.normal(3, 1, 1500)
        n = int(4000 * prior)
        unlabelled = np.concatenate([rng.normal(3, 1, n), rng.normal(-1, 1, 4000 - n)])
        assert T.best_bin(positive, unlabelled) == pytest.approx(prior, abs=0.04)


def test_confirmed_rows_alone(spark):
    """Only toxic rows are labelled: what is not toxic is left alone all the same."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = T.toxicity(docs, labels.where("toxic = 1")).join(labels, "doc_id").where("held_out").collect()
    hit, wrong = sum(r.toxic == 1 and r.predicted == 1 for r in got), sum(r.toxic == 0 and r.predicted == 1 for r in got)
    assert hit >= 0.6 * sum(r.toxic == 1 for r in got) and wrong <= 0.02 * len(got)


def test_defined_results(spark):
    rows = [(1, "bad words here"), (1, "bad words here"), (2, None), (3, ""), (None, "fine"), (4, "fine " * 100_000), *((100 + i, f"plain text {i}") for i in range(40))]
    docs = spark.createDataFrame(rows, TEXT)
    for name in ("toxic", "score", "hit", "held_out", "predicted", "n"):
        docs = docs.withColumn(name, F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (99, 1), *((100 + i, 0) for i in range(40))], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    got = T.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1 and len({r.score for r in got if r.doc_id in (2, 3)}) == 1
    assert T.toxicity(docs.where("false"), labels).count() == 0
    for none in (labels.where("false"), labels.where("toxic = 0")):
        assert {r.predicted for r in T.toxicity(docs, none).collect()} == {0}
    assert T.toxicity(docs, labels, prior=0.3).count() == len(rows)
