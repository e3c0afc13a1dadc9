"""Requests, whole searches and reports, with a transport in the place of the network."""

import json

import pytest
from pyspark.sql import functions as F

from siftwright import cli
from siftwright.operators import asks, report
from siftwright.plans import search
from siftwright.sources import provider
from siftwright.sources.tables import as_docs

FILES = [
    ("pay/acme/invoice.md", "# Invoice INV-20391\nAcme Tools, total 410.50\n"),
    ("pay/acme/receipt.md", "# Receipt\nPaid INV-20391 by RC-77812\n"),
    ("pay/bolt/bank.md", "# Bank\nTransfer RC-77812 booked\n"),
    ("notes/todo.md", "# Todo\nnothing here\n"),
]
CODE = [
    ("lib/core.py", "class Base:\n    def total(self):\n        return 1\n\n    def name_of(self):\n        return 'x'\n"),
    ("lib/pay.py", "from lib.core import Base\n\nclass Pay(Base):\n    def total(self):\n        return Base().total() + 2\n"),
    ("lib/other.py", "def unrelated():\n    return 3\n"),
]


def docs_of(spark, files):
    return as_docs(spark.createDataFrame(files, "rel string, body string"))


def asked(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "qid long, body string")


def answering(high, log=None):
    """A transport that answers .9 where a prompt or state holds one of the words, else .1."""

    def send(request):
        out = {}
        for tag, q in request["questions"].items():
            out[tag] = {"probability": 0.9 if any(w in tag for w in high) else 0.1}
        if log:
            with open(log, "a") as f:
                f.write(json.dumps(request) + "\n")
        return 200, {}, {"answers": out}

    return send


def model(send):
    endpoint = provider.Endpoint(transport=send, pause=0.0)
    return lambda a: provider.http_verdicts(a, endpoint, width=2)


def test_openings_and_clips(spark):
    body = "\n".join(["a" * 500, "b" * 500, "c" * 500, "d"])
    row = spark.createDataFrame([(body,), ("x\ny",), ("",)], "b string").select(asks.opening_of(F.col("b")).alias("o"), asks.clip(F.lit("z" * 201)).alias("c"), asks.span_text(F.col("b"), F.lit(2), F.lit(3)).alias("s")).collect()
    assert [len(r.o) for r in row] == [1001, 3, 0] and row[0].c == "z" * 200 + "…" and row[1].s == "y" and row[0].s == "b" * 200 + "…\n" + "c" * 200 + "…"


def test_prompts_name_what_is_asked(spark):
    rows = [(0, "1", "s:a.md:1-3", '{"text":"x"}'), (0, "2", "s:a.md:1-3", '{"text":"x"}'), (0, "link", "s:b.py#1-2", ""), (0, "", "d:pay", ""), (0, "", "f:pay/x", ""), (0, "", "n:np.mean", ""), (0, "", "t:lib/x.py", "")]
    made = asks.prompted(spark.createDataFrame(rows, "qid long, stage string, tag string, state string"), asked(spark, 'What "total"?')).collect()
    assert len({r.prompt for r in made}) == 7 and all('What "total"?' in r.prompt for r in made)
    for r in made:
        state = json.loads(r.state)
        assert state["query"] == 'What "total"?' and state["guidance"] and (state["about"] == {"text": "x"} if r.tag.startswith("s:a") else state["about"] is None)
        assert r.tag[2:] in r.prompt


def test_chosen_text_is_bounded(spark):
    rows = [(0, f"f{i:02}", "k", "é" * 100) for i in range(50)]
    text = asks.chosen_text(spark.createDataFrame(rows, "qid long, rel string, key string, body string"), 1000).first().chosen
    assert 400 < len(text) <= 1000


def test_sketches(spark):
    got = {r.rel: json.loads(r.content) for r in asks.sketches(docs_of(spark, FILES)).collect()}
    assert got["pay"]["names"] == ["acme", "bolt"] and got["pay"]["descendants"] == ["pay/acme/invoice.md", "pay/acme/receipt.md", "pay/bolt/bank.md"]
    assert ":: pay/bolt/bank.md\n# Bank" in got["pay"]["sketch"] and got["notes/todo.md"]["sketch"].startswith("# Todo") and set(got[""]["names"]) == {"notes", "pay"}


def test_a_records_search_with_a_model(spark, tmp_path):
    log = str(tmp_path / "log")
    found = search.search(docs_of(spark, FILES), asked(spark, "What is the total of INV-20391?"), asks.as_model(model(answering(["invoice", "receipt", "bank"], log)), asked(spark, "What is the total of INV-20391?")), where="/x")
    r = found.first()
    assert (r.route, r.outcome, r.dir) == ("probe", "done", "/x")
    assert [h.rel for h in r.hits] == ["pay/acme/invoice.md", "pay/acme/receipt.md", "pay/bolt/bank.md"]
    assert [h.via for h in r.hits] == ["probe", "probe", "chain"] and r.hits[0].quotes[0].body.startswith("# Invoice")
    requests = [json.loads(x) for x in open(log)]
    assert all(q["instructions"] for x in requests for q in x["questions"].values()) and r.tally.asked == sum(len(x["questions"]) for x in requests) and r.tally.docs_read == 4
    text = report.report_text(found).first().report
    assert text.startswith("# siftwright\nquestion: What is the total") and "## pay/acme/invoice.md  rank=1.0  via=probe\nquote 1-3" in text
    assert json.loads(report.report_json(found).first().report)["hits"][0]["rel"] == "pay/acme/invoice.md"


def test_a_search_without_quotes_walks(spark):
    docs = docs_of(spark, FILES)
    question = asked(spark, "which transfer was booked")
    found = search.search(docs, question, asks.as_model(model(answering(["d:", "bank"])), question), changed=lambda listed: listed.select("rel")).first()
    assert found.route == "survey" and [(h.rel, h.via, h.stale) for h in found.hits] == [("pay/bolt/bank.md", "survey", True)]


def test_a_code_search_with_a_model(spark):
    docs, question = docs_of(spark, CODE), asked(spark, "`Pay.total` returns the wrong sum")
    found = search.search(docs, question, asks.as_model(model(answering(["n:", "t:", "pay.py", "core.py"])), question)).first()
    assert found.route == "code" and found.outcome == "done" and [h.rel for h in found.hits][:2] == ["lib/pay.py", "lib/core.py"]
    assert {s.title for h in found.hits for s in h.sections} >= {"total"}


def test_problems_make_it_partial(spark):
    def send(request):
        return 400, {}, {"message": "no"}

    question = asked(spark, "What is INV-20391?")
    found = search.search(docs_of(spark, FILES), question, asks.as_model(model(send), question))
    r = found.first()
    assert r.outcome == "partial" and [(p.code, p.note) for p in r.problems] == [("provider", "no")] and r.hits == []
    assert "- provider x" in report.report_text(found).first().report


def test_refused_keys_stop(spark):
    question = asked(spark, "What is INV-20391?")
    with pytest.raises(Exception, match="auth|refused"):
        search.search(docs_of(spark, FILES), question, asks.as_model(model(lambda r: (401, {}, {"message": "refused"})), question)).collect()


def test_large_states_lose_what_was_chosen_first():
    sizes = []

    def send(request):
        text = json.dumps(request)
        sizes.append(len(text))
        return (422, {}, {"message": "too many tokens"}) if "CHOSEN" in text or len(text) > 900 else (200, {}, {"answers": {t: {"probability": 0.5} for t in request["questions"]}})

    state = lambda i: json.dumps({"query": "q", "about": {"text": f"{i}" * 300, "chosen": "CHOSEN" * 50}})
    got = provider.ask(provider.Endpoint(transport=send), [(f"s:{i}", "p", state(i)) for i in range(3)])
    assert got == [(0.5, None)] * 3 and sizes[1] < sizes[0]
    assert provider.without_chosen("no json") == "no json"


def test_retry_after_dates():
    assert provider.retry_after("3", 1.0) == 3.0 and provider.retry_after(None, 1.0) == 1.0 and provider.retry_after("soon", 2.0) == 2.0
    assert provider.retry_after("Wed, 21 Oct 2015 07:28:00 GMT", 1.0) == 0.0


def test_nothing_found_is_a_report(spark):
    found = cli.report_of(docs_of(spark, FILES), "zzz qqq", mode="docs", where="/y")
    r = found.first()
    assert (r.outcome, r.hits, r.also, r.route) == ("done", [], [], "probe") and json.loads(report.report_json(found).first().report)["dir"] == "/y"


def test_the_command_line_needs_a_key(monkeypatch, tmp_path):
    monkeypatch.delenv("SIFTWRIGHT_KEY", raising=False)
    assert cli.main(["q", str(tmp_path), "--url", "http://localhost:1/x"]) == 1
