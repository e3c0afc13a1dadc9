"""Operator 6: documents whose sets of five-word shingles overlap by a Jaccard similarity of 0.8 or more.

Method: token-combination prefixes. All documents agree on one order of the shingles: rare ones first, then the
frequent class, by hash within each. A document indexes the single shingles of its prefix; once its prefix reaches
into the frequent class, the prefix is extended and indexes two-token combinations of neighbouring frequent
shingles instead. Candidates that share an index entry are checked against an exact bound (parity bitmaps bound the
symmetric difference from below) and then verified on the whole sets.

Why the index loses no link. For a similar pair let I, U be the sizes of intersection and union, I >= 0.8 U. A
document of n shingles misses at most E = n - ceil(0.8 n) of its own, and the symmetric difference is at most
0.2 U <= 0.25 n. Look at the one of the two prefixes that ends first in the common order: every common shingle in
it lies in the other prefix too.
  * A short prefix is the first E + 1 shingles, all rare: one of them at least is common, so a single is shared.
  * A long prefix has E + floor(n / 4) + 2 shingles. If no rare one is common, at least floor(n / 4) + 2 common
    frequent ones remain, with floor(n / 4) + 1 gaps; each of the at most floor(n / 4) differing shingles lies in
    one gap at most, so some two common shingles are neighbours in both documents: a combination is shared.
Sets of up to three shingles can only be linked with equal sets. The frequent class may be any set of shingles
without changing the result; it only decides how many candidates arise.

Equal sets are collapsed first (a class of equal sets is one node of the graph). Candidates are first taken between a
node and the smallest node of its index entries; entries whose nodes then fall in one component are done. In each of the
others the nodes are compared with its smallest one, and then only nodes of different components in one entry are compared further.

Hot entries. An entry of more than HOT nodes is not compared by pairs. The nodes of all such entries are indexed again
by whole sets, rare shingles first as counted among them, and by sizes: a linked pair of sizes n, m has I >= 4 (n + m) / 9,
so the first common shingle is at a place p of the one with 9 p <= 5 n - 4 m, and at a place q of the other with
9 q <= 5 m - 4 n. Each shingle is entered once for every cell of partner sizes that its place allows. Sets that share a
large core but are not linked differ in more shingles than that, so their core is entered for no partner they have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .store import drop, release, written

SHINGLE = 5
PERCENT = 80
#: Shingles of the frequent class at most (1 MB broadcast), occurrences that make one frequent, and what a task reports at most.
FREQUENT_MOST, FREQUENT_FROM, TASK_MOST = 1 << 17, 8, 1 << 15
#: Different shingles that a task counts at once; the rarest give way beyond it (about 60 MB).
TABLE_MOST = 1 << 19
#: An index entry of more nodes is split by the sizes of partners (measured with one entry of 4000 unlinked sets, comparing all by bitmaps took 26 s
#: and indexing whole sets again 24 s; below that, comparing is cheaper); ids that a filter holds, at most (8 to 16 MB), beyond which they are joined.
HOT, FILTER_IDS = 4096, 1 << 22
#: Entries of a node by which a pair that meets in several of them is told to have met before; more are told apart afterwards.
FIRST_SIGS = 64
BITS = 512
_FIELDS = [f"b{i}" for i in range(BITS // 64)]
_PREFIX_SCHEMA = "doc_id long, n int, d1 long, d2 long, " + ", ".join(f"{b} long" for b in _FIELDS) + ", bits array<long>, sigs array<long>"


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part, data, offsets in W.chunks(batch):
        hashes, rows, _, _ = W.words(data, offsets)
        shingles, of, _ = W.grams(hashes, rows, part.num_rows, SHINGLE)
        yield part, list(W.distinct_by_row(shingles, of, part.num_rows))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the shingles that a task sees more than once; lossy counting keeps the memory bounded."""
    tokens, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held, size, floor = [], 0, 1

    def merge() -> None:
        nonlocal tokens, counts, held, size, floor
        new, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        both = np.concatenate([tokens, new])
        tokens, place = np.unique(both, return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate([counts, times]), minlength=len(tokens)).astype(np.int64)
        while len(tokens) > TABLE_MOST:
            keep = counts > floor
            tokens, counts, floor = tokens[keep], counts[keep], floor + 1
        held, size = [], 0

    for batch in batches:
        for _, sets in _sets(batch):
            held += sets
            size += sum(map(len, sets))
            if size > TABLE_MOST // 2:
                merge()
    merge()
    keep = np.flatnonzero(counts > 1)
    keep = keep[np.argsort(-counts[keep], kind="stable")[:TASK_MOST]]
    yield pa.RecordBatch.from_pydict({"token": tokens[keep].view(np.int64), "times": counts[keep]})


def frequent_class(docs: DataFrame) -> np.ndarray:
    """The frequent shingles, ascending; counted over all documents, at most FREQUENT_MOST of them."""
    found = docs.select("text").mapInArrow(_count, "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))
    top = found.where(F.col("times") >= FREQUENT_FROM).orderBy(F.desc("times"), "token").limit(FREQUENT_MOST).select("token").toPandas()["token"]
    return np.sort(top.to_numpy(dtype=np.int64).view(np.uint64))


def _bitmap(u: np.ndarray) -> np.ndarray:
    """Parity bitmap of fixed size: a shingle flips the bit that its upper hash bits name."""
    parity = np.bincount((u >> np.uint64(64 - 9)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def _wide_bitmap(u: np.ndarray) -> np.ndarray:
    """For large sets a second one, by the lower hash bits, of as many bits as shingles (the next power of two)."""
    if len(u) <= BITS:
        return np.zeros(0, np.int64)
    size = 1 << (len(u) - 1).bit_length()
    parity = np.bincount((u & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)


def signatures(u: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The index entries of one set: single rare shingles, and combinations of two neighbouring frequent ones."""
    n = len(u)
    if n < 4:
        return np.zeros(0, np.uint64)
    may_miss = n - (PERCENT * n + 99) // 100
    rare = u[~frequent]
    if len(rare) > may_miss:
        return rare[: may_miss + 1]
    often = u[frequent][: min(n, may_miss + n // 4 + 2) - len(rare)]
    pairs = W.mix(often[:-1] * np.uint64(0x2545F4914F6CDD1D) + W.mix(often[1:] + np.uint64(7)))
    return np.concatenate([rare, pairs])


def _prefixes(frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.zeros(1 << 20, dtype=bool)
        maybe[(frequent >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            for part, sets in _sets(batch):
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                often = maybe[(every >> np.uint64(44)).astype(np.int64)]
                at = np.flatnonzero(often)
                if len(at):
                    place = np.searchsorted(frequent, every[at])
                    often[at] = frequent[np.minimum(place, len(frequent) - 1)] == every[at]
                ends = np.cumsum(sizes)
                sigs = [signatures(u, often[e - len(u) : e]) for u, e in zip(sets, ends, strict=True)]
                bits = np.stack([_bitmap(u) for u in sets])
                digests = _digests(every, sizes)
                wide = [_wide_bitmap(u) for u in sets]
                lists = []
                for x in (wide, sigs):
                    offsets = np.concatenate([[0], np.cumsum([len(s) for s in x])]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).view(np.int64))))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes.astype(np.int32)), pa.array(digests[0]), pa.array(digests[1]), *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(BITS // 64)), *lists],
                    names=["doc_id", "n", "d1", "d2", *_FIELDS, "bits", "sigs"],
                )

    return run


def _id_places(ids: np.ndarray, bits: int) -> np.ndarray:
    h = W.mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x51ED))
    return np.stack([h >> np.uint64(64 - (bits.bit_length() - 1)), h & np.uint64(bits - 1)]).astype(np.int64)


def _id_filter(ids: DataFrame, n: int) -> np.ndarray:
    """A filter of n long ids, 16 to 32 bits an id; false hits only add sets that no pair asks for."""
    bits = max(1 << 16, 1 << (16 * n - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(bits, dtype=bool)
        for b in batches:
            mask[_id_places(b.column(0).to_numpy(zero_copy_only=False), bits)] = True
        yield pa.RecordBatch.from_pydict({"mask": [np.packbits(mask).tobytes()]})

    mask = np.zeros(bits // 8, dtype=np.uint8)
    for row in ids.coalesce(8).mapInArrow(run, "mask binary").toLocalIterator():
        mask |= np.frombuffer(row["mask"], np.uint8)
    return mask


def _digests(every: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Two order-free digests of each set (the sets lie one after another): sums of its differently mixed shingles."""
    ends = np.cumsum(sizes)
    run = np.zeros((2, len(every) + 1), np.uint64)
    np.cumsum(W.mix(every + np.uint64(11)), out=run[0, 1:])
    np.cumsum(W.mix(every ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=run[1, 1:])
    return (run[:, ends] - run[:, ends - sizes]).view(np.int64)


def _whole_sets(mask: np.ndarray | None):
    """The sets of a batch's rows, of those whose id is in the filter where there is one; one Python worker does both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if mask is None else np.unpackbits(mask).astype(bool)
        for batch in batches:
            if bits is not None:
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(bits[_id_places(ids, len(bits))].all(axis=0)))
            for part, sets in _sets(batch):
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                d1, d2 = _digests(every, sizes)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(d1), pa.array(d2), pa.ListArray.from_arrays(offsets, pa.array(every.view(np.int64)))], names=["doc_id", "d1", "d2", "h"])

    return run


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, d1, d2, h of the rows of docs whose doc_id is among ids (and of a few more): through a filter of checked size, or else a join."""
    n, given = ids.count(), docs.where("doc_id is not null")
    mask = _id_filter(ids, n) if n <= FILTER_IDS else None
    if mask is None:
        given = given.join(ids.distinct(), "doc_id", "left_semi")
    return given.mapInArrow(_whole_sets(mask), "doc_id long, d1 long, d2 long, h array<long>")


@dataclass
class _Corpus:
    """The texts, the class of each node (node, doc_id, d1, d2 of one of its rows), and whether ids repeat."""

    docs: DataFrame
    nodes: DataFrame
    repeated: bool

    def sets(self, wanted: DataFrame) -> DataFrame:
        """wanted (node) -> node, h: whole sets, made again for these nodes alone and written. That costs a scan and saves
        keeping every set on disk."""
        keys = written(self.nodes.select("node", "doc_id", "d1", "d2").join(wanted, "node", "left_semi"), "wanted")
        made = _sets_of(self.docs, keys.select("doc_id"))
        if self.repeated:  # rows that repeat id and text have one set
            made = made.dropDuplicates(["doc_id", "d1", "d2"])
        out = written(made.join(keys, ["doc_id", "d1", "d2"]).select("node", "h"), "sets")
        drop(keys)
        return out

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) whose whole sets overlap enough, written."""
        pairs = written(pairs, "pairs")
        sets = self.sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        left = sets.select(F.col("node").alias("a"), F.col("h").alias("ha"))
        right = sets.select(F.col("node").alias("b"), F.col("h").alias("hb"))
        both = F.size(F.array_intersect("ha", "hb"))
        joined = pairs.join(left, "a").join(right, "b")
        links = written(joined.where(100 * both >= PERCENT * (F.size("ha") + F.size("hb") - both)).select("a", "b"), "links")
        drop(pairs)
        drop(sets)
        release(self.docs.sparkSession)
        return links


def _cell(m: str) -> str:
    """SQL of the cell of a size: sizes below 64 have one each, larger ones go by their six leading bits."""
    high = f"(length(bin({m})) - 6)"
    return f"if({m} < 64, int({m}), int({high} * 32 + shiftright({m}, {high})))"


def _by_sizes(sets: DataFrame, comps: DataFrame) -> DataFrame:
    """sets (node, h), comps (node, comp) -> a, b: pairs of different components that the index by whole sets and sizes admits."""
    tokens = sets.select("node", F.size("h").alias("n"), F.explode("h").alias("t"))
    often = written(tokens.groupBy("t").agg(F.count("*").alias("c")).where("c > 1"), "often")
    # Shingles that one set alone has come first and are never entered: p counts them.
    ranked = tokens.join(often, "t").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("c", "t"))).alias("o"))
    first = ranked.select("node", "n", (F.col("n") - F.size("o")).alias("alone"), "o").where("5 * alone <= n")
    placed = first.select("node", "n", "alone", F.posexplode(F.expr("slice(o, 1, int(n / 5) - alone + 1)")).alias("i", "s"))
    placed = placed.selectExpr("node", "bigint(n) as n", "s.t as t", "bigint(least((5 * n - 9 * (alone + i)) / 4, 5 * n / 4)) as most", "bigint(ceil(4 * n / 5)) as least_").where("most >= least_")
    cells = placed.selectExpr("node", "t", f"{_cell('n')} as own", f"explode(sequence({_cell('least_')}, {_cell('most')})) as other")
    entries = cells.join(comps, "node").selectExpr("node", "comp", "t", "own", "least(own, other) as lo", "greatest(own, other) as hi")
    entries = written(entries, "entries")
    low, high = entries.where("own = lo"), entries.where("own = hi")
    key = ["t", "lo", "hi"]
    # Most entries hold one component alone: only the others are joined.
    met = low.groupBy(*key).agg(F.min("comp").alias("x0"), F.max("comp").alias("x1")).join(high.groupBy(*key).agg(F.min("comp").alias("y0"), F.max("comp").alias("y1")), key)
    met = written(met.where("x0 <> x1 or y0 <> y1 or x0 <> y0").select(*key), "met")
    x = low.join(met, key, "left_semi").select(*key, F.col("node").alias("a"), F.col("comp").alias("ca"))
    y = high.join(met, key, "left_semi").select(*key, F.col("node").alias("b"), F.col("comp").alias("cb"))
    pairs = x.join(y, key).where("ca <> cb and (lo < hi or a < b)").selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct()
    out = written(pairs, "pairs")
    for t in (often, entries, met):
        drop(t)
    return out


def _differ(x: str, y: str):
    """Bits in which two bitmaps differ: each stands for a differing shingle at least."""
    return sum((F.bit_count(F.col(f"{x}{b}").bitwiseXOR(F.col(f"{y}{b}"))) for b in _FIELDS), F.lit(0))


def _may_link(x: str, y: str):
    """The exact bounds: a linked pair's sizes differ by a quarter at most, and it has at most (n_x + n_y) / 9 differing shingles."""
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * _differ(x, y) <= n + m)


def _may_link_wide(x: str, y: str):
    """The second bound again on the wide bitmaps; the larger of two folds to the size of the smaller (after _may_link, half of it)."""
    p, q = F.col(f"{x}bits"), F.col(f"{y}bits")

    def folded(a, b):
        half = (F.size(a) / 2).cast("int")
        fold = F.zip_with(F.slice(a, 1, half), F.slice(a, half + 1, half), lambda u, v: u.bitwiseXOR(v))
        return F.when(F.size(a) > F.size(b), fold).otherwise(a)

    differ = F.aggregate(F.zip_with(folded(p, q), folded(q, p), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda a, b: a + b)
    return F.when((F.size(p) == 0) | (F.size(q) == 0), F.lit(True)).otherwise(9 * differ <= F.col(f"{x}n") + F.col(f"{y}n"))


def one_of_each(entries: DataFrame) -> DataFrame:
    """entries (sig, node) -> those of one sig for each different set of nodes: near copies share most of their entries, and each would give the same pairs again.

    A set of nodes is known by its size and two 64-bit digests of its nodes.
    """
    h = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    sets = entries.groupBy("sig").agg(F.count("*").alias("c"), *h)
    kept = sets.groupBy("c", "h1", "h2").agg(F.min("sig").alias("sig")).select("sig")
    return entries.join(kept, "sig", "left_semi")


def spokes(rest: DataFrame) -> DataFrame:
    """rest (sig, node, comp, n, bitmaps) -> a, b: the smallest node of each entry with those of other components there that the bounds admit.

    As many rows as the entries have at most. Near copies are mostly linked with each other, so these join a group that all its pairs would join by its square.
    """
    hubs = rest.groupBy("sig").agg(F.min("node").alias("node"))
    x, y = rest.alias("x"), rest.join(hubs, ["sig", "node"], "left_semi").alias("y")
    met = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.comp") != F.col("y.comp")) & _may_link("x.", "y."))
    return met.select(F.col("y.node").alias("a"), F.col("x.node").alias("b")).distinct()


def _first_shared(x: str, y: str):
    """Whether no smaller sig than this one is among the first FIRST_SIGS of both: a pair is taken where it meets first, and its first meeting always holds this."""
    return F.coalesce(F.array_min(F.array_intersect(f"{x}first", f"{y}first")), F.col(f"{x}sig")) >= F.col(f"{x}sig")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, more) -> doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    A null or blank text has the empty set and is linked with nothing; its component is its own id. Rows that repeat a
    doc_id are each placed by their own text, and a link of one of them is no link of the other. Rows whose doc_id is
    null come back with the size of their set and a null component. Equal texts, and texts with equal sets, always
    share a component. A very long text is one set, held whole in one task. Sets are compared by 64-bit hashes of their
    shingles: two different shingles of one pair of documents agree with a chance of about sizes / 2^64. Other columns
    are ignored. An empty table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.select("doc_id", "text")
    frequent = frequent_class(docs)
    # The number of a row of the written table names it from here on, since ids may repeat.
    prefixes = written(docs.mapInArrow(_prefixes(frequent), _PREFIX_SCHEMA).withColumn("row", F.monotonically_increasing_id()), "prefixes")
    release(spark)
    full = prefixes.where("n > 0 and doc_id is not null")
    rows = full.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    classes = written(full.groupBy("d1", "d2").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")), "classes")
    kept = full.where("n >= 4").join(classes.select("node"), F.col("row") == F.col("node"), "left_semi")
    indexed = written(kept.select(F.col("row").alias("node"), "doc_id", "d1", "d2", "n", *_FIELDS, "bits", "sigs"), "indexed")
    release(spark)
    entries = indexed.select("node", F.explode("sigs").alias("sig"))
    shared = written(entries.groupBy("sig").agg(F.count("*").alias("c"), F.min("node").alias("hub")).where("c > 1"), "shared")
    release(spark)
    alive = written(entries.join(shared, "sig").select("sig", "node", "hub", (F.col("c") > HOT).alias("hot")), "alive")
    drop(shared)
    release(spark)
    nodes = written(indexed.drop("sigs").join(alive.select("node").distinct(), "node", "left_semi"), "nodes")
    drop(indexed)
    corpus = _Corpus(docs, nodes, rows["n"] > rows["ids"])

    def bounded(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that the bounds admit, with `far`, how much their bitmaps differ."""
        fields = ["n", *_FIELDS, "bits"]
        x, y = (nodes.select(F.col("node").alias(k), *(F.col(c).alias(f"{p}{c}") for c in fields)) for k, p in (("a", "x_"), ("b", "y_")))
        far = (_differ("x_", "y_") / (F.col("x_n") + F.col("y_n"))).alias("far")
        return pairs.join(x, "a").join(y, "b").where(_may_link("x_", "y_") & _may_link_wide("x_", "y_")).select("a", "b", far)

    star = alive.where("node <> hub").groupBy(F.col("node").alias("a")).agg(F.min("hub").alias("b"))
    links = corpus.verified(bounded(star).select("a", "b"))
    comps = components(links)
    release(spark)
    # What the stars leave: entries that still hold nodes of several components.
    fields = nodes.select("node", "n", *_FIELDS)
    labelled = fields.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = alive.select("sig", "node", "hot").join(labelled.select("node", "comp"), "node")
    open_ = written(placed.groupBy("sig", "hot").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig", "hot"), "open")
    few = written(one_of_each(alive.select("sig", "node").join(open_.where("not hot").select("sig"), "sig", "left_semi")), "few")
    firsts = few.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("sig")), 1, FIRST_SIGS).alias("first"))
    rest = written(few.join(firsts, "node").join(labelled, "node"), "rest")
    drop(few)
    near_hubs = written(spokes(rest), "spokes")
    if not near_hubs.isEmpty():
        more = corpus.verified(bounded(near_hubs).select("a", "b"))
        links_all = written(links.union(more), "links")
        for t in (links, more, comps):
            drop(t)
        links = links_all
        comps = components(links)
        labelled = fields.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        named = written(rest.drop("comp").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "rest")
        drop(rest)
        rest = named
    drop(near_hubs)
    release(spark)
    x, y = rest.alias("x"), rest.alias("y")
    met = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.comp") < F.col("y.comp")) & _may_link("x.", "y.") & _first_shared("x.", "y."))
    pairs = met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    hot = written(alive.where("hot").join(open_.where("hot"), "sig", "left_semi").select("node").distinct(), "hot")
    split = []
    if not hot.isEmpty():
        sets = corpus.sets(hot)
        split = [_by_sizes(sets, labelled.select("node", "comp"))]
        drop(sets)
        pairs = pairs.union(split[0])
    near = written(bounded(pairs.distinct()), "near")
    release(spark)
    for t in (alive, open_, rest, hot, *split):
        drop(t)
    # One link joins two components, so the nearest pair of each two goes first; in the last round all that are left.
    for last in (False, False, True):
        ca, cb = comps.select(F.col("node").alias("a"), F.col("comp").alias("ca")), comps.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        apart = near.join(ca, "a", "left").join(cb, "b", "left").withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).where("ca <> cb")
        if last:
            tried = apart.select("a", "b")
        else:
            lo, hi = F.least("ca", "cb"), F.greatest("ca", "cb")
            tried = apart.groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.min(F.struct("far", "a", "b")).alias("p")).select("p.a", "p.b")
        tried = written(tried, "tried")
        if tried.isEmpty():
            drop(tried)
            break
        more = corpus.verified(tried)
        near_left = written(near.join(tried, ["a", "b"], "left_anti"), "near")
        links_all = written(links.union(more), "links")
        for t in (near, tried, links, more, comps):
            drop(t)
        near, links = near_left, links_all
        comps = components(links)
    # The smallest id of each component; a class without a link is its own.
    linked = classes.join(comps, "node")
    lows = linked.groupBy("comp").agg(F.min("least").alias("low"))
    placed = linked.join(lows, "comp").select("node", "low")
    class_comps = written(classes.join(placed, "node", "left").select("d1", "d2", F.coalesce("low", "least").alias("component_id")), "classes")
    for t in (nodes, near, links, comps, classes):
        drop(t)
    found = full.select("doc_id", "n", "d1", "d2").join(class_comps, ["d1", "d2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = prefixes.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.union(empty)
