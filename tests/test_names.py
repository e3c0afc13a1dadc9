import pytest
from pyspark.sql import functions as F

from siftwright import cli
from siftwright.operators import judge, lines, names
from siftwright.plans import search
from siftwright.sources import provider
from siftwright.sources.tables import as_docs


def _ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, body string")


def test_capital_names(spark):
    q = _ask(spark, "Ask Acme Corp of Ohio, about Jane Doe & Sons.", "Nothing here of Note", "", "See Big (Red Barn) and Tall Tree and", None)
    got = [(r.qid, r.value) for r in names.capital_names(q).orderBy("qid", "pos").collect()]
    assert got == [(0, "Acme Corp of Ohio"), (0, "Jane Doe & Sons"), (3, "Tall Tree")]


def test_terms_keep_the_first_of_equals(spark):
    q = _ask(spark, 'why "INV-20391" or INV-20391 for Jane Doe in 2024-07')
    assert [(r.form, r.value) for r in names.terms_in(q).orderBy("pos").collect()] == [("phrase", "INV-20391"), ("name", "Jane Doe")]


def test_code_names(spark):
    q = _ask(spark, "In `np.mean(x)` a ValueError; see https://a.com/foo_bar and me@x_y.org, fooBar, v1.2.3, --dry-run, deadbeef01, e.g. DataArray.quantile")
    got = [(r.text, r.parts, r.origin) for r in names.code_names(q).orderBy("pos").collect()]
    assert got == [("np.mean", ["mean"], "backtick"), ("ValueError", ["ValueError"], "error"), ("DataArray.quantile", ["DataArray.quantile", "DataArray", "quantile"], "dotted"), ("fooBar", ["fooBar"], "ident"), ("DataArray", ["DataArray"], "ident"), ("--dry-run", ["--dry-run"], "flag")]


def test_script_defs_close_with_their_brace(spark):
    body = "class A {\n  f() {\n  }\n  if (x) {\n  }\n}\nfunction g() {\n  const h = 1;\n}\n  m() {\nclass B extends x.A { }\n"
    found = lines.script_defs(lines.lines_of(spark.createDataFrame([("a.ts", body), ("a.py", body), ("e.js", "")], "rel string, body string")))
    assert [(r.name, r.line, r.form, r.owner, r.bases) for r in found.orderBy("line").collect()] == [("A", 1, "class", None, []), ("f", 2, "def", "A", None), ("g", 7, "function", None, None), ("h", 8, "def", None, None), ("B", 11, "class", None, ["A"])]


def test_second_pass_only_without_a_quote(spark):
    rows = [(1, "a", "a:1", "x"), (1, "a", "a:2", "y"), (1, "b", "b:1", "z"), (1, "b", "b:2", "w")]
    table = spark.createDataFrame([("1", "s:a:1", 0.9), ("1", "s:a:2", 0.3), ("2", "s:a:2", 0.0), ("1", "s:b:1", 0.4), ("2", "s:b:1", 0.1), ("1", "s:b:2", 0.1), ("2", "s:b:2", 0.7)], "stage string, tag string, probability double")
    out = judge.two_passes(spark.createDataFrame(rows, "qid long, rel string, key string, body string"), lambda asks: asks.join(table, ["stage", "tag"]))
    assert sorted((r.key, r.probability, r.quoted) for r in out.collect()) == [("a:1", 0.9, True), ("a:2", 0.3, False), ("b:2", 0.7, True)]
    assert [r.body for r in judge.donors(out).collect()] == ["x\nw"]


def test_hops_follow_new_ids(spark):
    docs = as_docs(spark.createDataFrame([("a.txt", "about order INV-20391 and case C-40017"), ("b.txt", "case C-40017 led to box B-50023"), ("c.txt", "box B-50023"), ("d.txt", "none of it")], "rel string, body string"))
    sure = lambda asks: asks.select("qid", "tag", F.lit(0.9).alias("probability"))
    found = search.probe_hops(docs, _ask(spark, "what of INV-20391?"), sure)
    assert sorted((r.rel, r.via) for r in found.collect()) == [("a.txt", "probe"), ("b.txt", "chain"), ("c.txt", "chain")]


def _served(script):
    def send(request):
        step = script.pop(0) if script else None
        if step and step != 200:
            return step if isinstance(step, tuple) else (step, {}, {})
        return 200, {}, {"answers": {t: {"probability": 0.5} for t in request["questions"]}}

    return provider.Endpoint(transport=send, pause=0.0)


def test_provider_tries_again(spark):
    asks = [("t1", "p", "abcd"), ("t2", "p", "s")]
    assert provider.ask(_served([(429, {"retry-after": "0"}, {}), 500, 408, 200]), asks) == [(0.5, None)] * 2
    assert provider.ask(_served([500] * 5), asks)[0][1].startswith("provider")
    limit = (422, {}, {"detail": "too many tokens"})
    assert provider.ask(_served([limit]), asks) == [(0.5, None)] * 2
    assert provider.ask(_served([limit, limit]), asks[:1])[0][1].startswith("token-limit")
    with pytest.raises(provider.ProviderError):
        provider.ask(_served([401]), asks)
    with pytest.raises(provider.ProviderError):
        provider.read_answers({"answers": {"t": {"probability": 1.5}}}, ["t"], "probability")


def test_provider_over_a_table(spark):
    def always(request):
        return 200, {}, {"answers": {t: {"probability": 0.25} for t in request["questions"]}}

    asks = spark.createDataFrame([(i % 3, f"t{i}", "p", "s") for i in range(60)], "qid long, tag string, prompt string, state string")
    out = provider.http_verdicts(asks, provider.Endpoint(transport=always), width=2)
    assert out.where("probability = 0.25 and problem is null").count() == 60


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["q", "--top", "0"])
    assert cli.main([]) == 1 and cli.main(["--version"]) == 0 and cli.main(["q", "/nowhere/at/all"]) == 1
    (tmp_path / "a.py").write_text("def make_part():\n    return 1\n")
    (tmp_path / "b.txt").write_text("the invoice INV-20391 is here")
    capsys.readouterr()
    docs = cli.open_corpus(spark, str(tmp_path))
    route, ranked = cli.answer(docs, "why does make_part fail?")
    assert route == "code" and [r.rel for r in ranked.collect()] == ["a.py"]
    route, ranked = cli.answer(docs, "where is INV-20391?", mode="docs")
    assert route == "probe" and [r.rel for r in ranked.collect()] == ["b.txt"]
