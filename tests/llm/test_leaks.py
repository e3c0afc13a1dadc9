import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftwright.llm import decontaminate as D

TEXT = "doc_id long, text string"
SIZES = (10, 30, 64, 65, 150, 300, 900, 3000)


@pytest.mark.parametrize("n", [10, 49, 50, 500])
def test_whole_copies_are_found_at_every_size(spark, n):
    """Items of 10 to 3000 words, each held by one document, and one of common words that all hold: no more and no fewer."""
    rng = random.Random(n)
    words = [f"w{i}" for i in range(4000)]
    common = "the cat sat by a door and then it went to look for some food in that old house near our river".split()
    items = [(k, " ".join(rng.choices(words, k=size))) for k, size in enumerate(SIZES)] + [(99, " ".join(common))]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(30, 200)))) for i in range(n)]
    held = {(i, 99) for i in range(n)}
    for k, text in items[:-1]:
        i = (3 * k + 1) % n
        rows[i] = (i, rows[i][1] + " " + text + " " + " ".join(rng.choices(words, k=40)))
        held.add((i, k))
    rows = [(i, f"{text} {' '.join(common)}") for i, text in rows]
    docs, bench = spark.createDataFrame(rows, TEXT), spark.createDataFrame(items, "item_id long, text string")
    got = D.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == held
    assert all(r.lcs_ratio == 1.0 and -1 <= r.cosine <= 1 for r in got)
    without = bench.where("item_id <> 99")
    assert {r.doc_id for r in D.without_leaks(docs, without).collect()} == set(range(n)) - {i for i, k in held if k != 99}


def test_hot_copies_leave_the_fit_alone(spark):
    item = "one telling passage about seven green lanterns over the quiet harbour of a northern town in winter"
    rows = [(i, "the same short copy again and again " * 3) for i in range(900)] + [(1000 + i, f"text {i} of many other words number{i} here " * 4 + (item if i % 10 == 0 else "")) for i in range(100)]
    got = {r.doc_id for r in D.leaks(spark.createDataFrame(rows, TEXT), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1000 + i for i in range(0, 100, 10)}


def test_defined_results(spark, tmp_path):
    item = "three four five six seven eight nine ten"
    rows = [(None, item), (1, item), (1, item), (2, None), (3, ""), (4, "filler " * 60_000 + item), (5, "three four five")]
    docs = spark.createDataFrame(rows, TEXT)
    for name in ("item_id", "cosine", "lcs", "place", "lang"):
        docs = docs.withColumn(name, F.lit("clash"))
    items = spark.createDataFrame([(7, item), (7, item), (8, None), (None, item)], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    assert sorted(((r.doc_id, r.item_id) for r in D.leaks(docs, items).collect()), key=str) == sorted([(None, 7), (1, 7), (1, 7), (4, 7)], key=str)
    kept = D.without_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5]
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.decontaminate_documents(spark, docs, str(tmp_path)).count() == 3
    assert corpus_pipeline.decontaminate_documents(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_every_stage_takes_nulls_clashes_and_nothing(spark, tmp_path):
    """Each stage of the pipeline from rows with nulls, repeats, clashing names, and from no rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, "plain words in a row here for once", "en", "s", 1), (1, "plain words in a row here for once more", "en", None, 1), (1, "plain words in a row here for once more", "en", None, 1), (2, None, None, None, None), (3, "", "en", "s", 0)]
    spark.createDataFrame([(7, "quite other things that no document holds at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema)
    for name in ("score", "component_id", "n_shingles", "gone", "size", "taken", "node", "row"):
        docs = docs.withColumn(name, F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.where("false")):
            out = stage(spark, given, str(tmp_path))
            if name != "mix_sources":
                assert out.columns == given.columns, name
            n = out.count()
            assert n <= given.count()
            if name in ("line_dedup", "decontamination", "mix_sources"):
                assert n == given.count(), name
