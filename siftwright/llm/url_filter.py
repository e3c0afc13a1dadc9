"""Operator 10: block or allow URLs by rules and, where no rule fits, by gradient-boosted trees on lexical features.

Method: URLs that a rule decides are the labelled ones; boosted trees learn from a bounded sample of them which shape of
URL is blocked: length, depth, digit ratio, entropy, parameter counts and statistics of the host's suffix. The trees
are turned into SQL expressions, so scoring is a projection. Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The trees and the suffix statistics are fitted on about so many labelled URLs, drawn by a hash of the row.
SAMPLE = 10_000
TREES, DEPTH = 15, 3


@dataclass(frozen=True)
class Rule:
    """verdict block or allow for a host and its subdomains where the path starts with the rule's."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2] if "/" in self.text else ""


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def matched_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """struct(text, verdict) of the longest fitting rule, or null; of equal length the first given."""
    out = None
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<text:string,verdict:string>")


def features(urls: DataFrame) -> DataFrame:
    """urls (url, host, path, ...) with the lexical features added, f_* double."""
    url = F.coalesce("url", F.lit(""))
    size = F.length(url)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    letters = F.array_distinct(F.split(url, ""))
    share = lambda c: (size - F.length(F.replace(url, c, F.lit("")))) / size
    entropy = F.when(size > 0, F.aggregate(F.transform(F.filter(letters, lambda c: c != ""), lambda c: -share(c) * F.log2(share(c))), F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    columns = {
        "f_length": size,
        "f_host_length": F.length("host"),
        "f_path_length": F.length("path"),
        "f_depth": F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit(""))),
        "f_labels": F.when(F.col("host") == "", 0).otherwise(F.size(F.split("host", r"\."))),
        "f_digit_ratio": F.when(size > 0, digits / size).otherwise(0.0),
        "f_entropy": entropy,
        "f_params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "f_hyphens": F.length(F.regexp_replace(url, "[^-]", "")),
        "f_fragment": F.contains(url, F.lit("#")).cast("int"),
    }
    return urls.select("*", *(v.cast("double").alias(k) for k, v in columns.items()), F.substring_index("host", ".", -1).alias("suffix"))


def _tree(node, names: list[str]) -> Column:
    """One regression tree as nested CASE expressions."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.col(names[split.featureIndex()]) <= float(split.threshold()), _tree(node.leftChild(), names)).otherwise(_tree(node.rightChild(), names))


def train(labelled: DataFrame) -> tuple[Column, list[tuple]]:
    """labelled (page_id, url, host, path, blocked 0/1) -> the probability of block over features(), and the suffix statistics.

    Of one class alone, the probability is that class; of no row, 0.
    """
    unit = F.xxhash64("url", "page_id", F.lit(10)).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    sample = features(labelled.where(unit < SAMPLE / max(1, labelled.count()))).persist()
    stats = sample.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("blocked").alias("b")).orderBy("suffix").collect()
    n, b = sum(r["n"] for r in stats), sum(r["b"] for r in stats)
    if not 0 < b < n:
        sample.unpersist()
        return F.lit(1.0 if b else 0.0), []
    prior = b / n
    table = [(r["suffix"], float(r["n"] / n), float((r["b"] + 10 * prior) / (r["n"] + 10))) for r in stats]
    x = with_suffix(sample, table, prior)
    names = [c for c in x.columns if c.startswith("f_")]
    rows = VectorAssembler(inputCols=names, outputCol="x").transform(x).select("x", F.col("blocked").cast("double").alias("y"))
    model = GBTClassifier(featuresCol="x", labelCol="y", maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=10).fit(rows)
    raw = sum((w * _tree(t._java_obj.rootNode(), names) for w, t in zip(model.treeWeights, model.trees, strict=True)), F.lit(0.0))
    sample.unpersist()
    return 1 / (1 + F.exp(-2 * raw)), [*table, (None, 0.0, prior)]


def with_suffix(x: DataFrame, table: list[tuple], prior: float) -> DataFrame:
    """Add the share and the blocked share of the host's suffix among the labelled URLs (about SAMPLE suffixes at most)."""
    small = x.sparkSession.createDataFrame([r for r in table if r[0] is not None], "suffix string, f_suffix_share double, f_suffix_blocked double")
    return x.join(F.broadcast(small), "suffix", "left").fillna({"f_suffix_share": 0.0, "f_suffix_blocked": prior})


def judge_urls(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """pages (page_id, url, more) -> page_id, host, path, rule (its text or null), verdict (block or allow).

    A null URL, or one without ://, has an empty host and path and no rule; the trees judge it like any other. Rows come
    back one for one, repeated and null ids included; other columns are ignored. Without labelled URLs all is allowed.
    """
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    urls = urls.withColumn("rule", matched_rule(rules, F.col("host"), F.col("path")))
    labelled = urls.where("rule is not null and url is not null").select("page_id", "url", "host", "path", (F.col("rule.verdict") == "block").cast("int").alias("blocked"))
    p, table = train(labelled)
    if table:
        urls = with_suffix(features(urls), table, table[-1][2])
    own = F.when(p >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return urls.select("page_id", "host", "path", F.col("rule.text").alias("rule"), F.coalesce("rule.verdict", own).alias("verdict"))


#: The contract's rules.
RULES = [Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/")]
