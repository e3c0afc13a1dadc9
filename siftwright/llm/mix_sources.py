"""Operator 1: mix sources to target weights by Pareto order sampling.

Method: each source gets a target in words; its documents are first taken in certain whole copies (the whole part
of target / size of the source), the rest by Pareto order sampling: a document's rank is the odds of its random
number over the odds of its inclusion, and the documents of the lowest ranks are taken until their words reach what
is left of the target. The inclusion odds are those of the source's remaining share, raised for longer documents
(by the square root of their size over the mean), so the last document taken, which decides how far the words miss
the target, is a short one. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: The ranks of a source are summed in so many steps; only the step in which its target falls is sorted row by row.
STEPS = 1024
_UNIT = float(1 << 52)


def source_targets(sizes: DataFrame) -> DataFrame:
    """sizes (source, source_size long, n) -> and target double: weights 5, 2, 1 by code point, null last, capped at three times.

    Targets share the sum of all sizes. A source's target is the smaller of three times its size and its weight times
    one common level; the level is found from the sources in the order in which they reach their cap.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = (F.row_number().over(order) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), place.cast("int") + 1)
    t = sizes.withColumn("weight", weight).withColumn("cap", (MOST_COPIES * F.col("source_size")).cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, all_ = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    t = t.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", (F.sum("source_size").over(all_) - F.col("full")) / F.col("open"))
    level = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(all_)
    t = t.withColumn("at", level["level"])
    return t.select("source", "source_size", "n", F.coalesce(F.least("cap", F.col("weight") * F.col("at")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """docs (doc_id, text, source, more) -> doc_id, source, size, source_size, target, taken.

    size: words of the text (null: 0). taken: words the mix takes of the document, whole copies counted; never more than
    three times its size. Random numbers come from the doc_id and the seed, so reruns agree; equal ranks go by doc_id and size, and rows
    that agree in both are exchangeable. Empty documents are taken with 0 words; sources
    without words have target 0. A null doc_id ranks as the empty text. Null is a source of its own. An empty table gives none.
    The size that a sample is fixed to is its words, which the targets are given in, not its number of documents: a very long text counts
    by its words, and the last document taken is the one that brings the words nearest to the target. Other columns are ignored.
    """
    words = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1))).cast("long")
    sized = written(docs.select("doc_id", "source", words.alias("size")), "sizes")
    sources = written(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))), "sources")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(_UNIT)
    share = F.col("ratio") - F.col("copies")
    odds = share / (1 - share) * F.sqrt(F.greatest(F.col("size"), F.lit(1)) / (F.col("source_size") / F.col("n")))
    t = sources.withColumnRenamed("source", "src").withColumn("ratio", ratio).withColumn("copies", F.floor("ratio"))
    # The rank: odds of the random number over the inclusion odds; none where the copies are all.
    rank = F.when(share > 0, (u / (1 - u)) / odds)
    joined = sized.join(t, F.col("source").eqNullSafe(F.col("src"))).withColumn("rank", rank)
    ranked = joined.withColumn("step", F.floor(F.col("rank") / (1 + F.col("rank")) * STEPS).cast("int")).withColumn("left", F.col("target") - F.col("copies") * F.col("source_size"))
    steps = ranked.where("rank is not null").groupBy("source", "step").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    so_far = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("upto", F.sum("words").over(so_far)).where(F.col("upto") > F.col("left"))
    edges = written(steps.groupBy(F.col("source").alias("edge_source")).agg(F.min(F.struct("step", (F.col("upto") - F.col("words")).alias("before"))).alias("edge")).select("edge_source", "edge.*").withColumnRenamed("step", "edge_step"), "edges")
    placed = ranked.join(edges, F.col("source").eqNullSafe(F.col("edge_source")), "left")
    keep = ["doc_id", "source", "size", "source_size", "target"]
    whole = (F.col("copies") * F.col("size")).cast("long")
    inside = F.col("rank").isNotNull() & (F.col("edge_step").isNull() | (F.col("step") < F.col("edge_step")))
    clear = placed.where(~F.coalesce(F.col("step") == F.col("edge_step"), F.lit(False))).select(*keep, (whole + F.when(inside, F.col("size")).otherwise(0)).alias("taken"))
    in_order = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("size").over(in_order)
    edge = placed.where(F.col("step") == F.col("edge_step")).withColumn("upto", upto)
    edge = edge.select(*keep, (whole + F.when(F.col("upto") - F.col("size") / 2 < F.col("left"), F.col("size")).otherwise(0)).alias("taken"))
    return clear.union(edge)


#: The same mix as SQL, for checking: everything but the steps, which only spread the work.
ORACLE = r"""
with sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
sizes as (select source, sum(size)::bigint as source_size, count(*) as n from sized group by source),
weighed as (select *, case (row_number() over (order by source is null, source) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight, (3 * source_size)::double as cap from sizes),
levels as (select *, coalesce(sum(cap) over (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding), 0) as full_, sum(weight) over (order by cap / weight, source is null, source rows between current row and unbounded following) as open_, (sum(source_size) over ())::double as all_ from weighed),
at_ as (select min_by((all_ - full_) / open_, cap / weight) as lv from levels where (all_ - full_) / open_ <= cap / weight),
targets as (select source, source_size, n, coalesce(least(cap, weight * lv), cap) as target from levels left join at_ on true),
ratios as (select *, case when source_size > 0 then target / source_size else 0.0 end as ratio from targets),
ranked as (select s.doc_id, s.size, r.*, floor(ratio) as copies, ratio - floor(ratio) as share, (('0x' || substr(md5('mix:' || coalesce(s.doc_id::varchar, '')), 1, 13))::bigint + 0.5) / 4503599627370496.0::double as u from sized s join ratios r on s.source is not distinct from r.source),
ordered as (select *, (u / (1 - u)) / (share / (1 - share) * sqrt(greatest(size, 1) / (source_size / n))) as rank from ranked where share > 0),
summed as (select *, sum(size) over (partition by source order by rank, doc_id, size rows between unbounded preceding and current row) as upto from ordered),
taken as (select doc_id, size, source_size, target, (copies * size)::bigint + case when upto - size / 2.0 < target - copies * source_size then size else 0 end as taken from summed
  union all select doc_id, size, source_size, target, (copies * size)::bigint from ranked where not share > 0)
select doc_id, size, source_size, round(target, 6) as target, taken::bigint as taken from taken
"""
