"""Search a directory tree from the command line: python -m siftwright.cli "question" [root]."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import params as P
from .operators import asks, names, report
from .operators.asks import Verdicts
from .plans import search
from .sources.provider import Endpoint, http_verdicts
from .sources.tree import open_corpus, stale

VERSION = "0.1.0"


def positive(text: str) -> int:
    if not text.isascii() or not text.isdigit() or str(int(text)) != text or int(text) < 1:
        raise argparse.ArgumentTypeError("expects a positive integer")
    return int(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftwright", description="Find the files of a tree that answer a question, by local evidence or by a model's verdicts.", allow_abbrev=False)
    p.add_argument("question")
    p.add_argument("root", nargs="?", default=os.getcwd())
    p.add_argument("--json", action="store_true", help="print the report as JSON")
    p.add_argument("--top", type=positive, default=P.TOP_K, help="files listed first (%(default)s)")
    p.add_argument("--mode", choices=("auto", "code", "docs"), default="auto")
    p.add_argument("--concurrency", type=positive, default=8, help="tasks at once (%(default)s)")
    p.add_argument("--thorough", action="store_true", help="walk the tree even where the terms found a quote")
    p.add_argument("--url", help="a model that gives verdicts; its key is read from SIFTWRIGHT_KEY. Without one, local evidence alone")
    p.add_argument("--stats", action="store_true", help="print the tally as JSON on stderr")
    p.add_argument("--version", action="version", version=VERSION)
    return p


def answer(docs: DataFrame, question: str, mode: str = "auto", top: int = P.TOP_K) -> tuple[str, DataFrame]:
    """The route, and ranked(qid, rel, rank, place, listed) of one question over docs."""
    asked = docs.sparkSession.createDataFrame([(0, question)], "qid long, body string")
    found = names.code_names(asked)
    route = search.pick_route(docs, bool(found.limit(1).count()), mode)
    if route == "code":
        parts = found.select("qid", F.explode("parts").alias("part"), (F.col("origin") == "plain").alias("plain")).distinct()
        ranked = search.heuristic(docs, parts).select("qid", "rel", F.col("heuristic").alias("rank"), "place").where(F.col("place") <= max(top, P.LIST_CAP))
    else:
        terms = names.terms_in(asked).select("qid", F.col("value").alias("term"))
        ranked = search.probe_route(docs, terms).select("qid", "rel", "rank", "place")
    return route, ranked.withColumn("listed", F.col("place") <= top)


def report_of(docs: DataFrame, question: str, mode: str = "auto", top: int = P.TOP_K, where: str = "", thorough: bool = False, model: Verdicts | None = None, now: DataFrame | None = None) -> DataFrame:
    """reports() of one question over docs. model takes asks(qid, tag, prompt, state); without one the files are ranked by local
    evidence, without sections. now are the documents as they are when the report is written."""
    asked = docs.sparkSession.createDataFrame([(0, question)], "qid long, body string")
    changed = (lambda listed: stale(listed, now)) if now is not None else None
    if model is not None:
        return search.search(docs, asked, asks.as_model(model, asked), mode, thorough, top, where, changed)
    route, ranked = answer(docs, question, mode, top)
    ranked = search.settled(ranked.withColumn("via", F.lit("grep" if route == "code" else "probe")))
    files, sections, none = search._nothing(asked)
    old = changed(docs.join(ranked.where("listed").select("rel"), "rel", "left_semi")).select("rel") if changed else none
    problems = sections.select("qid", F.lit(0).alias("seq"), F.lit("").alias("code"), F.lit(1).alias("times"), F.lit("").alias("note"))
    return report.reports(asked.withColumn("route", F.lit(route)), ranked, sections, old, problems, report.tally(asked, docs), where)


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: the arguments, the tree or the key can't be used; 2: done in part, with problems; 130: interrupted."""
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    if not args.question.strip() or not os.path.isdir(args.root):
        print("a question and a directory are needed", file=sys.stderr)
        return 1
    key = os.environ.get("SIFTWRIGHT_KEY", "").strip()
    if args.url and not key:
        print("SIFTWRIGHT_KEY is not set", file=sys.stderr)
        return 1
    spark = SparkSession.builder.master(f"local[{args.concurrency}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    model = (lambda asked: http_verdicts(asked, Endpoint(args.url, key), width=args.concurrency)) if args.url else None
    try:
        docs = open_corpus(spark, args.root).persist()
        found = report_of(docs, args.question, args.mode, args.top, os.path.abspath(args.root), args.thorough, model, open_corpus(spark, args.root)).persist()
        print((report.report_json if args.json else report.report_text)(found).first()["report"])
        row = found.select("outcome", "route", F.to_json("tally").alias("tally")).first()
        if args.stats:
            print(json.dumps({"route": row["route"]} | json.loads(row["tally"])), file=sys.stderr)
        return 0 if row["outcome"] == "done" else 2
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
