import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_llm import EDGE  # noqa: F401

from siftwright.llm import license_scan as L
from siftwright.llm import words as W

TEXT = "doc_id long, text string"


def hashes(text):
    ((_, data, offsets),) = W.chunks(pa.RecordBatch.from_pydict({"text": [text]}))
    return W.words(L._clean(data), offsets)[0]


def full(a, b):
    """The longest common subsequence without a band."""
    row = [0] * (len(b) + 1)
    for x in a.tolist():
        old = row[:]
        for j, y in enumerate(b.tolist()):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


def test_bands_equal_the_plain_alignment():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = (rng.integers(1, 6, int(rng.integers(1, 25))).astype(np.uint64) for _ in range(2))
        m, first, last = L.align(a, b, -30, 30)
        assert m == full(a, b)
        if m:
            assert full(a, b[first : last + 1]) == m and full(a, b[first + 1 : last + 1]) < m and full(a, b[first:last]) < m
        low = int(rng.integers(-5, 3))
        high = low + int(rng.integers(0, 6))
        best = {}
        for i in range(len(a)):
            for j in range(len(b)):
                best[i, j] = max(best.get((i - 1, j), 0) if low <= j - i + 1 <= high else 0, best.get((i, j - 1), 0) if low <= j - 1 - i <= high else 0, best.get((i - 1, j - 1), 0) + (a[i] == b[j])) if low <= j - i <= high else 0
        assert L.align(a, b, low, high)[0] == max(best.values())


def edited(rng, words, share, kind):
    out = []
    for w in words:
        if rng.random() < share:
            if kind == "replace":
                out.append(f"x{rng.randrange(99)}")
            elif kind == "insert":
                out += [w, f"y{rng.randrange(99)}"]
        else:
            out.append(w)
    return out


def test_recall_against_the_full_alignment(spark):
    """Copies with words replaced, left out or put in, whose full alignment reaches the coverage."""
    rng, rows = random.Random(2), []
    for name, text in L.TEMPLATES.items():
        if name.endswith("-notice"):
            continue
        words = text.split()
        for kind in ("replace", "drop", "insert"):
            for share in (0.05, 0.1, 0.15, 0.2):
                rows.append((len(rows), "some words before it " * 5 + " ".join(edited(rng, words, share, kind)) + " and after", name))
    got = {}
    for r in L.scan(spark.createDataFrame([r[:2] for r in rows], TEXT)).collect():
        got.setdefault(r.doc_id, []).append(r)
    held = found = 0
    for i, text, name in rows:
        a, b = hashes(L.TEMPLATES[name]), hashes(text)
        if full(a, b) >= L.COVERAGE * len(a):
            held += 1
            found += bool(got.get(i))
    assert held > 200 and found >= 0.98 * held


def test_parts_count_together(spark):
    words = L.TEMPLATES["MIT"].split()
    put = lambda at, n: " ".join([*words[:at], *(f"own{i}" for i in range(n)), *words[at:]])
    rows = [(1, put(80, 20)), (2, put(60, 90)), (3, " ".join(words[:100] + words[115:])), (4, L.TEMPLATES["MIT"] + " " + L.TEMPLATES["MIT"]), (5, put(40, 30) + " " + L.TEMPLATES["ISC"])]
    got = {}
    for r in L.scan(spark.createDataFrame(rows, TEXT)).collect():
        got.setdefault(r.doc_id, []).append((r.license, round(r.coverage, 2)))
    assert got[1] == [("MIT", 1.0)] and got[2] == [("MIT", 1.0)] and got[3] == [("MIT", round(1 - 15 / len(hashes(L.TEMPLATES["MIT"])), 2))]
    assert got[4] == [("MIT", 1.0)] * 2 and got[5] == [("MIT", 1.0), ("ISC", 1.0)]


def test_every_template_is_found_as_itself(spark):
    assert len(L.TEMPLATES) >= 25
    rows = [(i, f"Some words first. {text} Then an end.") for i, text in enumerate(L.TEMPLATES.values())]
    got = {}
    for r in L.scan(spark.createDataFrame(rows, TEXT)).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.coverage))
    assert got == {i: [(name, 1.0)] for i, name in enumerate(L.TEMPLATES)}


def test_defined_results(spark):
    mit = L.TEMPLATES["MIT"]
    rows = [(None, mit), (1, mit), (1, mit), (2, None), (3, ""), (4, "the software " * 50_000 + mit), (5, "of this software and " * 20_000)]
    docs = spark.createDataFrame(rows, TEXT).withColumn("license", F.lit("clash")).withColumn("coverage", F.lit("clash"))
    got = L.scan(docs).collect()
    assert sorted(((r.doc_id, r.license, r.coverage, r.first_word) for r in got), key=str) == sorted([(None, "MIT", 1.0, 0), (1, "MIT", 1.0, 0), (1, "MIT", 1.0, 0), (4, "MIT", 1.0, 100_000)], key=str)
    assert L.scan(docs.where("false")).count() == 0 == L.scan(docs, templates={}).count()
