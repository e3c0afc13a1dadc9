"""Whole searches: many questions in one job."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from ..functions import text as X
from ..operators import asks, code, judge, lines, links, names, probe, rank, report, segment, survey
from ..operators.asks import Verdicts

_settled: list[tuple[SparkSession, str]] = []


def heuristic(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """docs(rel, size, body), asked(qid, part, plain) -> the ranked files of each question, by local evidence alone."""
    every = lines.lines_of(docs)
    hits = code.grep(every, asked)
    return code.score_files(docs, asked, hits, lines.all_defs(every))


def probe_route(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """docs, terms(qid, term) -> ranked documents of each question by literal terms."""
    found = probe.match_docs(docs, terms).withColumn("peak", F.lit(0.0))
    return rank.rank_docs(found.select("qid", "rel", "peak", "weight", "matched_share"))


def settled(df: DataFrame) -> DataFrame:
    """df, computed once, as a Parquet table in the shared folder that the session names; a folder of this process only where it names none and all runs here.

    The tables are compressed and tell their true size, which checkpoints of rows don't. They go when the process ends.
    """
    spark = df.sparkSession
    jsc = spark.sparkContext._jsc.sc()
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and jsc.getCheckpointDir().isDefined():
        named = jsc.getCheckpointDir().get()
    if not named:
        if not jsc.isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="siftwright-")
        spark.sparkContext.setCheckpointDir(named)
    path = f"{named.rstrip('/')}/siftwright/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _settled:
        atexit.register(_clean)
    _settled.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for spark, path in _settled:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session has ended; the folder is the cluster's to empty
            return


class Asked:
    """Verdicts, each asked for once: what a provider said is checkpointed, and the asks and their problems are kept for the report."""

    def __init__(self, verdicts_of: Verdicts) -> None:
        self.verdicts_of, self.said = verdicts_of, []

    def __call__(self, asked: DataFrame) -> DataFrame:
        found = self.verdicts_of(asked)
        problem = F.col("problem") if "problem" in found.columns else F.lit(None).cast("string")
        found = settled(found.select("qid", "tag", "probability", problem.alias("problem")))
        self.said.append(found)
        return found.where("probability is not null").select("qid", "tag", "probability")

    def asks(self, questions: DataFrame) -> DataFrame:
        """(qid, tag, problem) of all that was asked."""
        none = questions.select("qid", F.lit("").alias("tag"), F.lit("").alias("problem")).limit(0)
        return reduce(DataFrame.unionByName, (x.select("qid", "tag", "problem") for x in self.said), none)

    def problems(self, questions: DataFrame) -> DataFrame:
        """(qid, seq, code, times, note): one for each ask that failed, by the code before its colon."""
        bad = self.asks(questions).where("problem is not null")
        return bad.select("qid", F.xxhash64("tag").alias("seq"), F.substring_index("problem", ":", 1).alias("code"), F.lit(1).alias("times"), F.trim(F.substr("problem", F.locate(":", F.col("problem")) + 1)).alias("note"))


SECTION = ["qid", "rel", "key", "title", "from", "to", "body", "opening", "weight", "matched_share"]


def pieces_of(docs: DataFrame) -> DataFrame:
    """(rel, key, title, from, to, body, opening) of every segment of docs."""
    cut = segment.segments(docs).join(docs.select("rel", asks.opening_of(F.col("body")).alias("opening")), "rel")
    return cut.select("rel", F.concat("rel", F.lit(":"), F.col("from"), F.lit("-"), F.col("to")).alias("key"), "title", "from", "to", "body", "opening")


def probe_hops(docs: DataFrame, questions: DataFrame, verdicts_of: Verdicts, hops: int = P.HOPS) -> DataFrame:
    """questions(qid, body) -> sections: SECTION, probability, quoted, via.

    The documents of the questions' terms are judged; then, twice at most, the documents that share a new id with what was found last.
    All questions go through each hop together; what a hop found is checkpointed, so that plans don't grow from hop to hop.
    """
    terms = settled(names.terms_in(questions))
    picks = settled(probe.match_docs(docs, terms.select("qid", F.col("value").alias("term"))).select("qid", "rel", "weight", "matched_share"))
    known = terms.where("form = 'id'").select("qid", F.col("key").alias("id_key"))
    pieces = pieces_of(docs)
    seen, found, via = picks, None, "probe"
    for hop in range(hops + 1):
        judged = settled(judge.two_passes(picks.join(pieces, "rel").select(SECTION), verdicts_of).withColumn("via", F.lit(via)))
        found = judged if found is None else found.unionByName(judged)
        if hop == hops:
            return found
        ids = settled(names.fresh_ids(judge.donors(judged), known))
        known, via = known.union(ids.select("qid", "id_key")), "chain"
        picks = settled(probe.chain(ids, docs, seen=seen).select("qid", "rel", "weight", F.lit(None).cast("double").alias("matched_share")))
        seen = seen.union(picks)


def docs_route(docs: DataFrame, questions: DataFrame, verdicts_of: Verdicts, thorough: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """docs, questions(qid, body) -> ranked(qid, rel, rank, place, listed, via), sections, problems and routes(qid, route).

    By terms and ids first. A question without a quote after that (every one, if thorough) also walks the tree, and the files that
    the walk picks and that were not judged yet are judged in their turn.
    """
    probed = probe_hops(docs, questions, verdicts_of)
    enough = probed.where("quoted").select("qid").distinct()
    open_ = settled(questions if thorough else questions.join(enough, "qid", "left_anti"))
    problems = questions.select("qid", F.lit("").alias("code"), F.lit("").alias("note")).limit(0)
    sections = probed
    if not open_.isEmpty():
        picked, problems = survey.survey(docs, open_, asks.with_sketches(verdicts_of, docs), settled)
        fresh = picked.join(probed.select("qid", "rel").distinct(), ["qid", "rel"], "left_anti").select("qid", "rel", "weight", F.lit(None).cast("double").alias("matched_share"))
        walked = judge.two_passes(settled(fresh).join(pieces_of(docs), "rel").select(SECTION), verdicts_of).withColumn("via", F.lit("survey"))
        sections = probed.unionByName(settled(walked))
    hits = sections.groupBy("qid", "rel").agg(F.max("probability").alias("peak"), F.max("weight").alias("weight"), F.max("matched_share").alias("matched_share"), F.min("via").alias("via"))
    ranked = rank.rank_docs(hits).join(hits.select("qid", "rel", "via"), ["qid", "rel"])
    routes = questions.select("qid").join(open_.select("qid", F.lit("survey").alias("route")), "qid", "left").fillna("probe", ["route"])
    return ranked, sections, problems, routes


def search(docs: DataFrame, questions: DataFrame, verdicts_of: Verdicts, mode: str = "auto", thorough: bool = False, top_k: int = P.TOP_K, where: str = "", changed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """docs, questions(qid, body) -> report.reports(): every question from its route to its report, all together.

    verdicts_of takes asks(qid, tag, and stage and state) and gives verdicts(qid, tag, probability, and problem): a table, a
    test's function, or a model by way of asks.as_model. changed takes the listed files (docs' columns) and gives the
    rel of those whose bytes are others by now.
    """
    said = Asked(verdicts_of)
    questions = settled(questions.select("qid", "body"))
    named = names.code_names(questions).select("qid").distinct()
    code_like = {"code": questions.select("qid"), "docs": questions.select("qid").limit(0)}.get(mode, named if pick_route(docs, True, mode) == "code" else named.limit(0))
    about_code = settled(questions.join(code_like, "qid", "left_semi"))
    others = settled(questions.join(about_code, "qid", "left_anti"))
    columns = ["qid", "rel", "rank", "place", "listed", "via"]
    section = ["qid", "rel", "key", "title", "from", "to", "body", "probability", "quoted"]
    ranked, sections, routes = [], [], []
    problems = said.problems(questions).limit(0)
    if not others.isEmpty():
        found, parts, stops, route = docs_route(docs, others, said, thorough)
        ranked.append(found.withColumn("listed", F.col("place") <= top_k).select(columns))
        sections.append(parts.select(section))
        routes.append(route)
        problems = problems.unionByName(stops.select("qid", F.lit(0).cast("long").alias("seq"), "code", F.lit(1).alias("times"), "note"))
    if not about_code.isEmpty():
        found, parts = code_route(docs, about_code, said)
        via = parts.groupBy("qid", "rel").agg(F.min("via").alias("via"))
        found = found.join(via, ["qid", "rel"], "left").select("qid", "rel", F.col("value").alias("rank"), "place", (F.col("place") <= top_k).alias("listed"), F.coalesce("via", F.lit("grep")).alias("via"))
        ranked.append(found)
        sections.append(parts.select(section))
        routes.append(about_code.select("qid", F.lit("code").alias("route")))
    if not ranked:
        return report.reports(questions.withColumn("route", F.lit("probe")), *_nothing(questions), problems, report.tally(questions, docs), where)
    ranked, sections = settled(reduce(DataFrame.unionByName, ranked)), reduce(DataFrame.unionByName, sections)
    stale = ranked.select("rel").limit(0) if changed is None else changed(docs.join(ranked.where("listed").select("rel").distinct(), "rel", "left_semi")).select("rel")
    problems = problems.unionByName(said.problems(questions))
    counts = report.tally(questions, docs, said.asks(questions))
    return report.reports(questions.join(reduce(DataFrame.unionByName, routes), "qid"), ranked, sections, stale, problems, counts, where)


def _nothing(questions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    spark = questions.sparkSession
    qid = f"qid {questions.schema['qid'].dataType.simpleString()}"
    ranked = spark.createDataFrame([], f"{qid}, rel string, rank double, place int, listed boolean, via string")
    return ranked, spark.createDataFrame([], f"{qid}, rel string, key string, title string, `from` int, `to` int, body string, probability double, quoted boolean"), ranked.select("rel")


def link_hops(docs: DataFrame, sections: DataFrame, verdicts_of: Verdicts, hops: int = P.HOPS, defs: DataFrame | None = None) -> DataFrame:
    """sections(qid, rel, key, title, from, to, body, probability, quoted) -> these and the ones that links lead to, with via.

    From the quoted sections, and then from what they led to, twice at most: the best linked files not judged yet, of each the segments around
    the linked lines, judged once beside the quotes that led there. Definitions are those of all files; every hop is checkpointed.
    """
    every = lines.lines_of(docs)
    defs = settled(lines.all_defs(every)) if defs is None else defs
    kin = settled(links.kin_of(defs))
    columns = ["qid", "rel", "key", "title", "from", "to", "body", "probability", "quoted", "via"]
    frontier = sections.withColumn("via", F.lit("grep")).select(columns)
    found, judged = frontier, settled(sections.select("qid", "rel").distinct())
    for _ in range(hops):
        chosen = frontier.where("quoted")
        others = settled(links.other_links(chosen, docs, every, defs))
        linked = links.leading_siblings(chosen, docs, defs, others, judged, kin=kin).unionByName(others)
        targets = settled(links.link_targets(linked, docs, judged))
        pieces = segment.segments(docs.join(targets.select("rel").distinct(), "rel", "left_semi"))
        around = settled(links.segments_around(pieces, targets).withColumn("key", F.concat("rel", F.lit("#"), F.col("from"), F.lit("-"), F.col("to"))))
        told = around.withColumn("body", asks.trimmed(F.col("body"))).join(asks.chosen_text(chosen, P.CODE_CHOSEN_BYTES), "qid", "left")
        told = asks.segment_content(told, F.col("chosen")).select("qid", F.lit("link").alias("stage"), F.concat(F.lit("s:"), "key").alias("tag"), F.col("content").alias("state"))
        kept = judge.judge_sections(around, verdicts_of(told).select("qid", "tag", "probability"))
        frontier = settled(kept.join(around.drop("pos"), ["qid", "rel", "key"]).withColumn("via", F.lit("link")).select(columns))
        found, judged = found.unionByName(frontier), judged.union(targets.select("qid", "rel"))
    return found


def code_route(docs: DataFrame, questions: DataFrame, verdicts_of: Verdicts) -> tuple[DataFrame, DataFrame]:
    """docs, questions(qid, body) -> files(qid, rel, value, place) and sections(qid, rel, key, ..., via) of questions about code.

    Names of the question and its plain words that are defined somewhere; names that verdicts keep; files by local evidence (a question
    without any takes the directory walk's); the best by verdicts; their declarations, judged; two hops along links; ranks, fused with the scores.
    """
    every = lines.lines_of(docs)
    defs = settled(lines.all_defs(every))
    plain = names.defined_words(questions, defs).select("qid", "text", F.array("text").alias("parts"), F.lit("plain").alias("origin"), F.lit(None).cast("string").alias("file"))
    named = settled(names.code_names(questions).drop("pos").unionByName(plain))
    spread = named.select("qid", "text", "origin", F.explode("parts").alias("part"))
    hits = settled(code.grep(every, spread))
    mentioned = settled(code.mentions(named, hits))
    sent = lambda t, stage, tag, state: t.select("qid", F.lit(stage).alias("stage"), tag.alias("tag"), state.alias("state"))
    origins = named.groupBy("qid", F.col("text").alias("name")).agg(F.min("origin").alias("found_as"))
    cards = mentioned.where("mentioned > 0").join(origins, ["qid", "name"]).withColumn("state", F.to_json(F.struct("name", "found_as", F.col("mentioned").alias("mentioned_in_files"))))
    kept = judge.filter_names(mentioned, verdicts_of(sent(cards, "names", F.concat(F.lit("n:"), "name"), F.col("state"))).select("qid", "tag", "probability"))
    kept = settled(named.join(kept.select("qid", F.col("name").alias("text")), ["qid", "text"], "left_semi"))
    parts = kept.select("qid", "origin", F.explode("parts").alias("part")).groupBy("qid", "part").agg(F.min((F.col("origin") == "plain").cast("int")).cast("boolean").alias("plain"))
    parts = settled(parts)
    scored = settled(code.score_files(docs, parts, hits, defs, hints=code.hints_of(kept)))
    silent = questions.join(scored.select("qid").distinct(), "qid", "left_anti")
    walked, _ = survey.survey(docs, settled(silent), asks.with_sketches(verdicts_of, docs), settled, P.SURVEY_VISITS)
    kinds = docs.select("rel", X.file_kind(F.col("rel"), F.col("body"), F.col("size")).alias("kind"))
    walked = walked.join(kinds, "rel").select("qid", "rel", "kind", (F.col("weight") * X.kind_weight(F.col("kind"))).alias("heuristic"))
    scored = settled(scored.unionByName(lines.top(walked, ["qid"], [F.desc("heuristic"), "rel"], P.SCORE_KEEP)))
    own = scored.select("qid", "rel").join(parts.select("qid", "part"), "qid").join(defs.select("rel", F.col("name").alias("part")).distinct(), ["rel", "part"]).groupBy("qid", "rel").agg(F.collect_set("part").alias("defines"))
    near = code.match_windows(hits, code.rarity(hits.select("rel", "part").distinct(), docs.agg(F.count("*").alias("n_docs"))))
    near = near.groupBy("rel").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("windows"))
    cards = scored.select("qid", "rel", "kind").join(own, ["qid", "rel"], "left").join(near, "rel", "left")
    cards = cards.withColumns({"defines": F.coalesce("defines", F.array().cast("array<string>")), "windows": F.coalesce("windows", F.array().cast("array<struct<from:int,to:int>>"))})
    cards = asks.file_cards(cards, docs, defs)
    triaged = settled(judge.triage(scored.select("qid", "rel", "heuristic"), verdicts_of(sent(cards, "triage", F.concat(F.lit("t:"), "rel"), F.col("content"))).select("qid", "tag", "probability")))
    pieces = judge.declaration_segments(segment.segments(docs), triaged.select("qid", "rel"), hits, parts.select("qid", "part"))
    pieces = settled(pieces.withColumn("key", F.concat("rel", F.lit("#"), F.col("from"), F.lit("-"), F.col("to"))))
    told = asks.segment_content(pieces.withColumn("body", asks.trimmed(F.col("body"))))
    said = verdicts_of(sent(told, "judge", F.concat(F.lit("s:"), "key"), F.col("content"))).select("qid", "tag", "probability")
    first = settled(judge.judge_sections(pieces, said).join(pieces.drop("pos"), ["qid", "rel", "key"]))
    sections = settled(link_hops(docs, first, verdicts_of, defs=defs))
    peaks = sections.groupBy("qid", "rel").agg(F.max("probability").alias("peak")).join(triaged.select("qid", "rel", "triage"), ["qid", "rel"], "left").join(kinds, "rel")
    ranked = rank.rank_code(peaks.select("qid", "rel", "peak", F.coalesce("triage", F.lit(P.LINK_TRIAGE)).alias("triage"), X.kind_weight(F.col("kind")).alias("kind_weight")))
    return rank.fuse(ranked.select("qid", "rel", F.col("score").alias("rank")), scored.select("qid", "rel", "heuristic", "place")), sections


def survey_route(docs: DataFrame, questions: DataFrame, verdicts_of: Verdicts) -> tuple[DataFrame, DataFrame]:
    """docs, questions(qid, body) -> picks(qid, rel, weight, via) of the directory walk, and its problems."""
    return survey.survey(docs, questions, verdicts_of, settled)


def pick_route(docs: DataFrame, named: bool, mode: str = "auto", share: float = 0.15) -> str:
    """code where 15 % of the front files are source and the question names code, else probe."""
    if mode in ("code", "docs"):
        return "code" if mode == "code" else "probe"
    front = docs.where(~F.col("rel").rlike(P.BACK_DIRS))
    found = front.agg(F.avg(F.col("rel").rlike(P.SOURCE_EXT).cast("int")).alias("share")).first()["share"] or 0.0
    return "code" if named and found >= share else "probe"


def grams(questions: DataFrame, words: int = 4) -> DataFrame:
    """questions(qid, body) -> terms(qid, term): all runs of four words, one after another, of the whole question; fewer words at its end make none."""
    split = F.split(X.squash(F.col("body")), " ")
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(split) - 1) / words).cast("int")), lambda i: F.slice(split, i * words + 1, words))
    return questions.select("qid", F.explode(F.filter(runs, lambda r: F.size(r) == words)).alias("run")).select("qid", F.array_join("run", " ").alias("term"))
