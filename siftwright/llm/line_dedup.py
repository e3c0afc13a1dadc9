"""Operator 4: remove lines that lie in repeated three-line windows.

Method: every run of three consecutive lines is hashed (128 bits); a window seen more than once keeps its first
occurrence (by document, then line) and every later occurrence covers its three lines. Overlapping covered windows
merge: a line goes if any later occurrence covers it. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

WINDOW = 3


def _windows(docs: DataFrame) -> DataFrame:
    """no_id, doc_id, mark (of the text), pos, k1, k2: one row for each window."""
    lines = F.split("text", "\n", -1)
    short = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("mark"), F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(41), x).alias("b"))).alias("h"))
    spans = F.when(F.size("h") >= WINDOW, F.sequence(F.lit(1), F.size("h") - (WINDOW - 1)))
    at = lambda i, k, side: F.element_at(F.col("h"), i + k)[side]
    keys = F.transform(spans, lambda i: F.struct((i - 1).alias("pos"), F.xxhash64(*(at(i, k, "a") for k in range(WINDOW))).alias("k1"), F.xxhash64(*(at(i, k, "b") for k in range(WINDOW))).alias("k2")))
    return short.select("doc_id", "mark", F.explode(keys).alias("w")).select(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark", "w.*")


def covered_lines(docs: DataFrame) -> DataFrame:
    """doc_id, mark, gone: the covered line numbers (from 0) of every document that loses any."""
    windows = _windows(docs)
    place = F.struct("no_id", "doc_id", "mark", "pos")
    repeated = written(windows.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("k1", "k2", "first"), "windows")
    later = windows.join(repeated, ["k1", "k2"]).where(~place.eqNullSafe(F.col("first"))).select("doc_id", "mark", F.explode(F.sequence("pos", F.col("pos") + (WINDOW - 1))).alias("line"))
    return later.distinct().groupBy("doc_id", "mark").agg(F.collect_list("line").alias("gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, more) -> the same columns with text cut, and n_lines, n_removed.

    Lines end at \\n alone. A null text stays null (0 lines); an empty one is one empty line; texts of fewer than three
    lines have no window and stay whole. Documents go by doc_id, null last; rows that repeat a doc_id are told apart
    by their text, and wholly equal rows are one document and lose the same lines. A text that loses every line
    becomes empty. A very long text is cut whole, in time in proportion to its lines. No row is dropped; an empty table
    gives none. Other columns may have any name; n_lines and n_removed of docs give way to those of the result.
    """
    gone = covered_lines(docs)
    # Columns go by place from here on, so that none of docs can clash with another.
    names = docs.columns
    own = [f"c{i}" for i in range(len(names))]
    of = dict(zip(names, own, strict=True))
    text = F.col(of["text"])
    joined = docs.toDF(*own).withColumn("key", F.xxhash64(text)).join(gone.withColumnRenamed("doc_id", "id"), F.col(of["doc_id"]).eqNullSafe(F.col("id")) & (F.col("key") == F.col("mark")), "left")
    lines = F.split(text, "\n", -1)
    # The numbers of the lines that stay, by hashing, then these lines.
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    joined = joined.select(*own, "gone", lines.alias("lines"), F.when(F.col("gone").isNotNull(), stay).alias("stay"))
    cut = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform("stay", lambda i: F.element_at(F.col("lines"), i + 1)), "\n"))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size("lines"))
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    kept = [(c, k) for c, k in of.items() if c not in ("n_lines", "n_removed")]
    return joined.select(*((cut if c == "text" else F.col(k)).alias(c) for c, k in kept), n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The columns of docs after dedup_lines; n_chars follows the text; documents that lost all their lines go."""
    names = docs.columns
    # n_lines and n_removed are names of the result: columns of docs that are called so go by another.
    inner = [f"own_{c}" if c in ("n_lines", "n_removed") else c for c in names]
    cut = dedup_lines(docs.toDF(*inner)).where("n_removed = 0 or n_removed < n_lines")
    if "n_chars" in names:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(*inner).toDF(*names)
