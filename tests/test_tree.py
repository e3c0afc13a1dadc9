"""The directory source: ignore patterns, limits and parts."""

from siftwright.operators import code, lines
from siftwright.sources import tree


def test_ignore_patterns():
    rules = tree.ignore_rules("# c\n*.log\n!keep.log\n/build/\nsrc/**/gen\ndocs/*.txt\n**/tmp\nfoo/**\na[0-9].py\n\\#x\nq?z\n\n!")
    yes = [("a/b.log", False), ("build", True), ("src/gen", False), ("src/a/b/gen", True), ("docs/a.txt", False), ("z/tmp", False), ("tmp", True), ("foo/x/y", False), ("b/a1.py", False), ("#x", False), ("qaz", False)]
    no = [("keep.log", False), ("build", False), ("x/build", True), ("docs/x/a.txt", False), ("foo", True), ("ab.py", False), ("q/z", False), ("# c", False)]
    assert all(tree.ignored(p, d, rules) for p, d in yes) and not any(tree.ignored(p, d, rules) for p, d in no)


def test_limits_and_parts(spark, tmp_path, monkeypatch):
    for i in range(30):
        (tmp_path / f"d{i % 3}").mkdir(exist_ok=True)
        (tmp_path / f"d{i % 3}" / f"f{i:02}.txt").write_text("x" * 100)
    reader = tree.TreeReader(str(tmp_path), 1000, 10)
    assert len(reader.listed()) == 10 and reader.clipped
    whole = tree.TreeReader(str(tmp_path), 1000)
    names = [rel for rel, _ in whole.listed()]
    assert names == sorted(names) and len(names) == 30 and not whole.clipped
    monkeypatch.setattr(tree, "PART_BYTES", 10_000)
    parts = whole.partitions()
    assert len(parts) == 10 and [rel for p in parts for rel in p.files] == names and max(len(p.files) for p in parts) <= 3
    assert tree.open_corpus(spark, str(tmp_path)).count() == 30
    (tmp_path / "none").mkdir()
    assert tree.open_corpus(spark, str(tmp_path / "none")).count() == 0


def test_outgoing_links_of_scripts_and_python(spark):
    files = [("a.ts", "import { Alpha as A, type2 } from './x'\nimport type { Gamma } from 'y'\nexport class Own extends core.Base {\n  $run(go) { call$it(1); ok(2) }\n}"), ("b.py", "import os.path, numpy\nfrom m.n import (one_a as two,\nclass K(m.Base, metaclass=Meta):\n    def f(self): return helper(len(x))")]
    got = {}
    for r in code.outgoing_links(lines.lines_of(spark.createDataFrame(files, "rel string, body string"))).collect():
        got.setdefault(r.rel, {})[r.name] = r.weight
    assert got["a.ts"] == {"Base": 3, "Alpha": 2, "type2": 2, "Gamma": 2, "$run": 1, "call$it": 1}
    assert got["b.py"] == {"Base": 3, "path": 2, "numpy": 2, "one_a": 2, "helper": 1, "import": 1}
