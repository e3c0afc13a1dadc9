"""Reports: of each question its files, their sections and quotes, what went wrong and what it took."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from .judge import fold_problems
from .rank import kept_quotes

_SECTION = "array<struct<segment:string,title:string,`from`:int,`to`:int,probability:double>>"
_QUOTE = "array<struct<`from`:int,`to`:int,body:string>>"


def tally(questions: DataFrame, docs: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(qid, asked, docs_read): how many verdicts were asked for (asked(qid, tag, ...), one row each) and how many documents were read."""
    read = docs.agg(F.count("*").alias("docs_read"))
    counts = asked.groupBy("qid").agg(F.count("*").alias("asked")) if asked is not None else questions.select("qid").limit(0).withColumn("asked", F.lit(0).cast("long"))
    # One row of read: a count.
    return questions.select("qid").join(counts, "qid", "left").join(F.broadcast(read)).select("qid", F.coalesce("asked", F.lit(0)).cast("long").alias("asked"), "docs_read")


def outcome_of(problems: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, outcome): partial where a question has a problem, else done."""
    bad = problems.select("qid").distinct().withColumn("bad", F.lit(True))
    return questions.select("qid").join(bad, "qid", "left").select("qid", F.when(F.col("bad"), "partial").otherwise("done").alias("outcome"))


def reports(questions: DataFrame, ranked: DataFrame, sections: DataFrame, stale: DataFrame, problems: DataFrame, counts: DataFrame, where: str = "") -> DataFrame:
    """One row for each question, found or not: qid, question, dir, route, outcome, hits, also, problems, tally.

    questions(qid, body, route), ranked(qid, rel, rank, place, listed, via), sections(qid, rel, key, title, from, to, body, probability,
    quoted), stale(rel), problems(qid, seq, code, times, note), counts(qid, asked, docs_read). hits are the listed files in order, with their sections, up
    to three quotes of probability .6 or more, and whether the file has changed since; also the files behind them.
    """
    files = sections.groupBy("qid", "rel").agg(F.array_sort(F.collect_list(F.struct("from", "to", "key", "title", "probability"))).alias("s"))
    files = files.select("qid", "rel", F.transform("s", lambda x: F.struct(x["key"].alias("segment"), x["title"].alias("title"), x["from"].alias("from"), x["to"].alias("to"), x["probability"].alias("probability"))).cast(_SECTION).alias("sections"))
    quotes = kept_quotes(sections.where("quoted").select("qid", "rel", "from", "to", "body"), sections)
    quotes = quotes.groupBy("qid", "rel").agg(F.array_sort(F.collect_list(F.struct("from", "to", "body"))).cast(_QUOTE).alias("quotes"))
    changed = stale.select("rel").distinct().withColumn("stale", F.lit(True))
    rows = ranked.join(files, ["qid", "rel"], "left").join(quotes, ["qid", "rel"], "left").join(changed, "rel", "left")
    hit = F.struct("place", "rel", "rank", "via", F.coalesce("sections", F.array().cast(_SECTION)).alias("sections"), F.coalesce("quotes", F.array().cast(_QUOTE)).alias("quotes"), F.coalesce("stale", F.lit(False)).alias("stale"))
    found = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.when(F.col("listed"), hit))).alias("hits"), F.array_sort(F.collect_list(F.when(~F.col("listed"), F.struct("place", "rel", "rank")))).alias("also"))
    wrong = fold_problems(problems).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("code", "times", "note"))).alias("problems"))
    out = questions.join(found, "qid", "left").join(wrong, "qid", "left").join(outcome_of(problems, questions), "qid").join(counts, "qid", "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType))
    hits = F.transform(empty("hits"), lambda h: F.struct(*(h[k].alias(k) for k in ("rel", "rank", "via", "sections", "quotes", "stale"))))
    also = F.transform(empty("also"), lambda h: F.struct(h["rel"].alias("rel"), h["rank"].alias("rank")))
    return out.select("qid", F.col("body").alias("question"), F.lit(where).alias("dir"), "route", "outcome", hits.alias("hits"), also.alias("also"), empty("problems").alias("problems"), F.struct("asked", "docs_read").alias("tally"))


def report_json(found: DataFrame) -> DataFrame:
    """reports() -> (qid, report): each as one line of JSON."""
    return found.select("qid", F.to_json(F.struct(*(c for c in found.columns if c != "qid"))).alias("report"))


def report_text(found: DataFrame) -> DataFrame:
    """reports() -> (qid, report): the head, the listed files with their quotes, the files behind, the problems."""
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    quote = lambda q: F.concat(line("\nquote ", q["from"], "-", q["to"], "\n"), q["body"])
    mark = lambda h: F.when(h["stale"], F.lit("  stale")).otherwise(F.lit(""))
    hit = lambda h: F.concat(line("\n## ", h["rel"], "  rank=", F.round(h["rank"], 6), "  via=", h["via"]), mark(h), F.array_join(F.transform(h["quotes"], quote), ""))
    head = line("# siftwright\nquestion: ", F.col("question"), "\nroute: ", F.col("route"), "\noutcome: ", F.col("outcome"), "\nshown: ", F.size("hits"), "  also: ", F.size("also"), "\n")
    also = F.array_join(F.transform("also", lambda a: line("- ", a["rel"], "  rank=", F.round(a["rank"], 6), "\n")), "")
    wrong = F.array_join(F.transform("problems", lambda p: line("- ", p["code"], " x", p["times"], "\n")), "")
    return found.select("qid", F.concat(head, F.array_join(F.transform("hits", hit), "\n"), F.lit("\n\n## also\n"), also, F.lit("\n## problems\n"), wrong).alias("report"))
