import re

import pytest
from pyspark.sql import functions as F

from siftwright.operators import code, judge, lines, links, names, segment, survey
from siftwright.plans import search
from siftwright.sources.tables import as_docs

FILES = {
    "core/base.py": "import os\n\nclass Base:\n    def run(self):\n        return 1\n",
    "core/impl_a.py": "from .base import Base as Root\nfrom core import tools\n\nclass A(Root):\n    def run(self):\n        return tools.help_me(self.window_size, LIMIT_MAX)\n",
    "core/impl_b.py": "from core.base import Base\n\nclass B(Root):\n    def run(self):\n        return 2\n",
    "core/tools.py": "LIMIT_MAX = 3\n\ndef help_me(x, y):\n    return x\n",
    "other/free.py": "class C:\n    def run(self):\n        return 3\n",
    "app/main.py": "from core.tools import help_me\n\ndef start():\n    return help_me(1, 2)\n",
}
FILES |= {f"kin/{d}/{n}.py": f"def {n}_of_{d}():\n    pass\n" for d in ("one", "two", "three") for n in ("load", "save", "conf")}
FILES["kin/two/conf.py"] = "window_width = 4\n"
FILES["kin/one/load.py"] = "def load_of_one(x):\n    return x.window_width\n"


def _docs(spark, files=FILES):
    return as_docs(spark.createDataFrame(list(files.items()), "rel string, body string"))


def _chosen(spark, rel, a, b, title="t"):
    body = "\n".join(FILES[rel].split("\n")[a - 1 : b])
    return spark.createDataFrame([(1, f"{rel}#{a}-{b}", rel, title, a, b, body)], "qid int, key string, rel string, title string, from int, to int, body string")


def _rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_uses_and_own_functions(spark):
    chosen = _chosen(spark, "core/impl_a.py", 5, 6)
    assert _rows(links.name_uses(chosen), "name", "form") == [("LIMIT_MAX", "constant"), ("window_size", "attribute")]
    assert _rows(links.own_functions(_chosen(spark, "core/tools.py", 3, 4)), "name", "home") == [("help_me", "core/tools.py")]
    assert _rows(links.own_functions(chosen), "name") == []


def test_imports_count_where_used(spark):
    docs = _docs(spark)
    every = lines.lines_of(docs)
    assert _rows(links.import_links(_chosen(spark, "core/impl_a.py", 4, 6), docs, every), "rel", "name", "line") == [("core/base.py", "Base", 3), ("core/tools.py", "tools", 1)]
    assert _rows(links.import_links(_chosen(spark, "core/impl_a.py", 5, 5), docs, every), "rel") == []
    assert _rows(links.import_links(_chosen(spark, "app/main.py", 3, 4), docs, every), "rel", "name", "line") == [("core/tools.py", "help_me", 3)]


def test_siblings_share_kin(spark):
    defs = lines.all_defs(lines.lines_of(_docs(spark)))
    assert _rows(links.sibling_links(_chosen(spark, "core/impl_a.py", 5, 6), defs), "rel", "name", "line") == [("core/impl_b.py", "B.run", 4)]


def test_family(spark):
    docs = _docs(spark)
    assert _rows(links.family_links(_chosen(spark, "kin/one/load.py", 1, 2), docs, lines.lines_of(docs)), "rel", "name", "line") == [("kin/two/conf.py", "window_width", 1)]


def test_targets_and_callers(spark):
    docs = _docs(spark)
    every = lines.lines_of(docs)
    defs = lines.all_defs(every)
    found = links.all_links(_chosen(spark, "core/tools.py", 3, 4), docs, every, defs)
    assert _rows(found, "rel", "name", "line", "reason") == [("app/main.py", "help_me", 4, "caller"), ("core/impl_a.py", "help_me", 6, "caller")]
    found = links.all_links(_chosen(spark, "core/impl_a.py", 4, 6), docs, every, defs)
    seen = spark.createDataFrame([(1, "core/impl_b.py")], "qid int, rel string")
    got = _rows(links.link_targets(found, docs, seen), "place", "rel", "at", "weight")
    assert got == [(1, "core/tools.py", [1, 3], 7.0), (2, "core/base.py", [3], 3.0)]


def test_link_hops(spark):
    docs = _docs(spark)
    first = _chosen(spark, "core/impl_a.py", 4, 6).withColumns({"probability": F.lit(0.9), "quoted": F.lit(True)})
    got = search.link_hops(docs, first, lambda asks: asks.select("qid", "tag", F.lit(0.7).alias("probability")))
    assert {(r.rel, r.via) for r in got.collect()} == {("core/impl_a.py", "grep"), ("core/base.py", "link"), ("core/impl_b.py", "link"), ("core/tools.py", "link"), ("app/main.py", "link")}
    none = search.link_hops(docs, first, lambda asks: asks.select("qid", "tag", F.lit(0.1).alias("probability")))
    assert {r.rel for r in none.collect()} == {"core/impl_a.py"}


def test_defined_words(spark):
    q = spark.createDataFrame([(1, "How does start call help_me, and what does start return?"), (2, ""), (3, None)], "qid int, body string")
    assert _rows(names.defined_words(q, lines.all_defs(lines.lines_of(_docs(spark)))), "qid", "pos", "text") == [(1, 1, "start")]


def _tree(files):
    root = {}
    for rel in files:
        node = root
        *dirs, name = rel.split("/")
        for d in dirs:
            node = node.setdefault(d, {})
        node[name] = None
    return root


def _model(files, p, fits, leads, visits, picks, lexical):
    """The walk one directory at a time."""
    queue, found, spent, by_words = [("", _tree(files))], [], 0, 0
    while queue and len(found) < picks and spent < visits:
        wave, queue = queue[: visits - spent], []
        spent += len(wave)
        for at, node in wave:
            for name in sorted(node):
                rel = f"{at}/{name}".lstrip("/")
                if node[name] is not None:
                    if p("d:" + rel) >= 0.5 or rel in leads:
                        queue.append((rel, node[name]))
                    continue
                sure = p("f:" + rel) >= 0.25
                word = not sure and by_words < lexical and rel in fits
                if (sure or word) and len(found) < picks:
                    found.append(rel)
                    by_words += word
    return found


def test_walk_against_a_sequential_model(spark):
    import hashlib

    p = lambda tag: int(hashlib.md5(tag.encode()).hexdigest()[:4], 16) / 65535
    files = {f"d{i % 5}/e{i % 3}/{'alpha_beta' if i % 4 == 0 else 'x'}_{i}.txt": "t" for i in range(60)} | {"alpha beta.txt": "", "y.txt": ""}
    docs = _docs(spark, files)
    lex = spark.createDataFrame([(1, "alpha", False), (1, "beta", False)], "qid int, token string, strong boolean")
    fits = {f for f in files if "alpha" in f}
    # An underscore is no letter, so both words stand alone in a path.
    leads = {"/".join(f.split("/")[:i]) for f in fits for i in range(1, len(f.split("/")))}
    from siftwright.operators import judge

    for visits, picks, lexical in ((200, 80, 16), (200, 80, 3), (6, 80, 16), (200, 12, 4), (1, 80, 16)):
        got, problems = survey.walk(docs, lex, judge.hash_verdicts, search.settled, visits, picks, lexical)
        assert [r.rel for r in got.orderBy("at").collect()] == _model(files, p, fits, leads, visits, picks, lexical)
        assert bool(problems.count()) == ((visits, picks) != (200, 80))


def test_survey_falls_back_to_paths(spark):
    files = {f"a/b/{'/'.join('cdefg')}/red lorry {i}.txt": "t" for i in range(30)}
    q = spark.createDataFrame([(1, "where is the lorry painted in red colour, lorry please"), (2, "red lorry"), (3, None), (4, "")], "qid int, body string")
    empty = lambda asks: asks.select("qid", "tag", F.lit(0.0).alias("probability"))
    got, _ = search.survey_route(_docs(spark, files), q, empty)
    assert {r.qid for r in got.collect()} <= {1, 2}
    nothing, problems = search.survey_route(_docs(spark, {"x.txt": ""}).where("false"), q, empty)
    assert nothing.count() == 0 and problems.count() == 0


def test_scores_by_path_traceback_and_owner(spark):
    from siftwright.operators import code

    files = {"pkg/core/base.py": "class Frame:\n    def size(self):\n        pass\n", "pkg/other.py": "def size():\n    pass\n# Frame.size\n", "run/job.py": "x = Frame.size\n", "c.test.py": "Frame.size\n"}
    docs = _docs(spark, files)
    every = lines.lines_of(docs)
    q = spark.createDataFrame([(1, "why does `core.base.Frame.size` fail?"), (2, 'see `Frame.size` in File "/home/me/run/job.py", line 1, in main_part')], "qid int, body string")
    named = names.code_names(q)
    parts = named.select("qid", F.explode("parts").alias("part"), F.lit(False).alias("plain")).distinct()
    defs = lines.all_defs(every)
    assert _rows(code.definers(spark.createDataFrame([("Frame.size",), ("size",), ("Frame",)], "part string"), defs), "rel", "part") == [("pkg/core/base.py", "Frame"), ("pkg/core/base.py", "Frame.size"), ("pkg/core/base.py", "size"), ("pkg/other.py", "size")]
    got = code.score_files(docs, parts, code.grep(every, parts), defs, hints=code.hints_of(named)).where("place = 1")
    assert _rows(got, "qid", "rel", "heuristic") == [(1, "pkg/core/base.py", 1.0), (2, "run/job.py", 1.0)]


def test_code_route(spark):
    docs = _docs(spark)
    q = spark.createDataFrame([(1, "How does `help_me` work?"), (2, "nothing known"), (3, None)], "qid int, body string")
    sure = lambda asks: asks.select("qid", "tag", F.when(F.col("tag").rlike("^[df]:"), 0.0).otherwise(0.8).alias("probability"))
    ranked, sections = search.code_route(docs, q, sure)
    got = [r.rel for r in ranked.where("qid = 1").orderBy("place").collect()]
    assert got[0] == "core/tools.py" and {"app/main.py", "core/impl_a.py"} <= set(got)
    assert {r.via for r in sections.where("rel = 'core/tools.py'").collect()} == {"grep"}
    assert {r.qid for r in ranked.collect()} == {1}


def test_slots_follow_rate_limits():
    from siftwright.sources.provider import Slots

    now = [0.0]
    slots = Slots(8, clock=lambda: now[0])

    def wave(n, limited=False, good=True):
        for _ in range(n):
            slots.take()
        for _ in range(n):
            slots.give(limited, good, 5.0)

    wave(8, limited=True, good=False)
    assert slots.limit == 4  # once for the whole wave
    now[0] = 6.0
    wave(2, limited=True, good=False)
    assert slots.limit == 2
    for _ in range(2):
        wave(2)
    assert slots.limit == 3  # two answers while both slots were taken
    for _ in range(47):
        wave(3)
    assert slots.limit == 3  # beside the limit met before it takes 48
    wave(3)
    assert slots.limit == 4 and slots.busy == 0
    wave(1)
    slots.take()
    slots.give(False, False, 0.0)
    assert slots.limit == 4


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("side", ["module_files", "link_targets", "declaration_segments", "score_files"])
def test_corpus_sides_are_not_broadcast(spark, side):
    """A side that grows with the corpus is joined by sorting, whatever its estimate: as a broadcast it goes through the driver."""
    docs = spark.createDataFrame([("a/b.py", 9, "x = f(1)\n")], "rel string, size long, body string")
    names = spark.createDataFrame([(1, "f", False)], "qid long, part string, plain boolean")
    picks = spark.createDataFrame([(1, "a/b.py")], "qid long, rel string")
    if side == "module_files":
        found = code.module_files(spark.createDataFrame([("a.b",)], "module string"), docs)
    elif side == "link_targets":
        found = links.link_targets(spark.createDataFrame([(1, "a/b.py", "f", 1, "call")], "qid long, rel string, name string, line int, reason string"), docs, picks.limit(0))
    elif side == "declaration_segments":
        hits = spark.createDataFrame([("a/b.py", "f", 1)], "rel string, part string, n int")
        found = judge.declaration_segments(segment.segments(docs), picks, hits, names)
    else:
        hits = spark.createDataFrame([("a/b.py", "f", 1)], "rel string, part string, n int")
        found = code.score_files(docs, names, hits, lines.all_defs(lines.lines_of(docs)))
    merged = [x for x in _plan(found).splitlines() if "SortMergeJoin [rel#" in x or "SortMergeJoin [suffix#" in x]
    assert merged, side


def test_link_hops_cut_linked_files_alone(spark, monkeypatch):
    """Segments are cut of the files that links lead to, not of the whole corpus."""
    docs = as_docs(spark.createDataFrame([*FILES.items(), *((f"z/free{i}.py", f"x{i} = 1\n") for i in range(9))], "rel string, body string"))
    first = spark.createDataFrame([(1, "app/main.py", "app/main.py#3-4", "start", 3, 4, "def start():\n    return help_me(1, 2)", 0.9, True)], "qid int, rel string, key string, title string, `from` int, `to` int, body string, probability double, quoted boolean")
    linked = spark.createDataFrame([(1, "core/tools.py", "help_me", 3, "call")], "qid int, rel string, name string, line int, reason string")
    monkeypatch.setattr(links, "other_links", lambda *_: linked)
    monkeypatch.setattr(links, "leading_siblings", lambda *_, **__: linked.limit(0))
    cut, whole = [], segment.segments
    monkeypatch.setattr(segment, "segments", lambda d: cut.extend(r.rel for r in d.select("rel").collect()) or whole(d))
    got = search.link_hops(docs, first, judge.hash_verdicts, 1)
    assert cut == ["core/tools.py"] and got.where("via = 'grep'").count() == 1


@pytest.mark.parametrize("made,keys", [("sibling", ["rel", "owner"]), ("call", ["name"]), ("caller", ["name"]), ("family", ["dir"]), ("family", ["rel", "name"]), ("import", ["rel", "name"])])
def test_links_broadcast_no_corpus(spark, made, keys):
    """Definitions and declared names of all files are joined by sorting too."""
    docs = spark.createDataFrame([("a/c/b.py", 9, "x = f(1)\n")], "rel string, size long, body string")
    every = lines.lines_of(docs)
    defs = lines.all_defs(every)
    chosen = spark.createDataFrame([(1, "a/c/b.py#1-1", "a/c/b.py", "f", 1, 1, "f(1)")], "qid long, key string, rel string, title string, from int, to int, body string")
    found = {
        "sibling": lambda: links.sibling_links(chosen, defs),
        "call": lambda: links.call_links(chosen.select("qid", F.col("title").alias("name"), F.lit(True).alias("called")), defs),
        "caller": lambda: links.caller_links(links.own_functions(chosen), docs, every, defs),
        "family": lambda: links.family_links(chosen, docs, every),
        "import": lambda: links.import_links(chosen, docs, every),
    }[made]()
    assert re.search(r"SortMergeJoin \[" + ", ".join(rf"{k}#\d+" for k in keys) + r"\], \[", _plan(found))


def test_settled_tables_are_files(spark):
    """What a route keeps between steps is compressed and tells its size; empty tables keep their columns."""
    kept = search.settled(spark.createDataFrame([(1, ["a"])], "qid long, parts array<string>"))
    assert kept.inputFiles() and [tuple(r) for r in kept.collect()] == [(1, ["a"])]
    assert search.settled(kept.limit(0)).schema == kept.schema
