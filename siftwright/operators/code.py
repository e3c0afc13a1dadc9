"""Code names in files: mentions, definitions, rarity, scores, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import text as X
from .lines import split_common, top, wide


def grep(lines: DataFrame, parts: DataFrame) -> DataFrame:
    """lines(rel, n, line), parts(part) -> (rel, part, n): lines that hold a part as a whole word.

    Parts that are one ASCII word join by equality with the line's words; the others join on their first word and are verified by pattern.
    """
    words = lines.select("rel", "n", "line", F.explode(X.identifiers(F.col("line"))).alias("word"))
    parts = parts.select("part").distinct().withColumn("word", F.regexp_extract("part", r"([0-9A-Za-z_]+)", 1)).where("word <> ''")
    single = F.col("part") == F.col("word")
    return words.join(parts, "word").where(single | F.rlike(F.col("line"), X.word_pattern(F.col("part")))).select("rel", "part", "n").distinct()


def rarity(hits: DataFrame, total: DataFrame) -> DataFrame:
    """hits(rel, part), total(n_docs) -> (part, df, idf)."""
    found = hits.select("rel", "part").distinct().groupBy("part").agg(F.count("*").alias("df"))
    return found.crossJoin(F.broadcast(total.agg(F.max("n_docs").alias("n_docs")))).select("part", "df", (F.ln((F.col("n_docs") + 1) / (F.col("df") + 1)) + 0.1).alias("idf"))


def name_stats(hits: DataFrame, defs: DataFrame) -> DataFrame:
    """(part, mentioned, defined): files that mention a part, and those of them that define it."""
    files = hits.select("rel", "part").distinct()
    own = defs.select("rel", F.col("name").alias("part")).distinct().withColumn("own", F.lit(1))
    return files.join(own, ["rel", "part"], "left").groupBy("part").agg(F.count("*").alias("mentioned"), F.count("own").alias("defined"))


def definers(names: DataFrame, defs: DataFrame) -> DataFrame:
    """names(part), defs -> (rel, part): files that define a part; a dotted part by its last word, in a class of the word before or as a class itself."""
    parts = names.select("part").distinct().withColumn("leaf", F.substring_index("part", ".", -1)).withColumn("within", F.try_element_at(F.split("part", r"\."), F.lit(-2)))
    found = parts.join(defs.select("rel", F.col("name").alias("leaf"), "form", "owner"), "leaf")
    return found.where(F.col("within").isNull() | (F.col("owner") == F.col("within")) | (F.col("form") == "class")).select("rel", "part").distinct()


def mentions(named: DataFrame, hits: DataFrame) -> DataFrame:
    """named(qid, text, parts), hits(rel, part) -> (qid, name, mentioned): files that mention any part of a name; names without any are left out.

    Counted once for each set of parts. The files of a set's common parts are counted for all sets that share them; to these come the files
    of its other parts that hold none of them.
    """
    files = hits.select("rel", "part").distinct()
    whole = named.select("qid", F.col("text").alias("name"), F.explode("parts").alias("part")).groupBy("qid", "name").agg(F.sort_array(F.collect_set("part")).alias("whole"))
    wanted = whole.select("whole").distinct().select("whole", F.explode("whole").alias("part"))
    rare, of, heads = split_common(wanted, "whole", files.groupBy("part").agg(F.count("*").alias("files")), P.COMMON_FILES)
    many = heads.join(files, "part").select("head", "rel").distinct()
    few = rare.join(files, "part").select("whole", "rel").distinct().join(of, "whole", "left").join(many, ["head", "rel"], "left_anti")
    counts = of.join(many.groupBy("head").agg(F.count("*").alias("n")), "head").select("whole", "n").unionByName(few.groupBy("whole").agg(F.count("*").alias("n")))
    return whole.join(counts.groupBy("whole").agg(F.sum("n").alias("mentioned")), "whole").select("qid", "name", "mentioned")


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.\w+$", "")


def _in_module(low: Column, module: Column) -> Column:
    return F.contains(low, F.concat(module, F.lit("/"))) | F.endswith(low, F.concat(module, F.lit(".py")))


def in_modules(modules: DataFrame, docs: DataFrame) -> DataFrame:
    """modules(module) of two words or more -> (module, rel): files below a directory, or at a path, that ends as the module does.

    An equi-join on what follows the module's first word, which may be the end of a longer one; then verified.
    """
    tail = F.substr("module", F.locate("/", F.col("module")) + 1)
    wanted = modules.distinct().select("module", F.explode(F.array(tail, F.concat(tail, F.lit(".py")))).alias("run"))
    bits, n = F.split(F.lower("rel"), "/"), F.size(F.split("rel", "/"))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.array_join(F.slice(bits, i, j - i + 1), "/"))))
    return docs.select("rel", F.explode(F.array_distinct(runs)).alias("run")).join(wanted, "run").where(_in_module(F.lower("rel"), F.col("module"))).select("module", "rel").distinct()


def traced_files(traces: DataFrame, docs: DataFrame) -> DataFrame:
    """traces(trace) -> (trace, rel): files whose last two words of a path end the trace; an equi-join on the trace's ends."""
    last = F.substring_index("trace", "/", -2)
    ends = traces.distinct().where("trace <> ''").select("trace", F.explode(F.transform(F.sequence(F.lit(1), F.length(last)), lambda i: F.substr(last, i))).alias("end"))
    return docs.select("rel", F.substring_index("rel", "/", -2).alias("end")).join(ends, "end").select("trace", "rel")


def _leading(rows: DataFrame, by: list[str], keep: int) -> DataFrame:
    """rows(by, rel, held, kind, raw) -> (by, rel): what can be among the first `keep` of a group, whatever is added alike to equal rows.

    Files that hold the same parts in the same way score the same, so the first by path stand for the rest; those go that enough others
    surpass by more than rounding.
    """
    first = top(rows, [*by, "held", "kind"], ["rel"], keep)
    above = Window.partitionBy(*by).orderBy(-F.col("raw") / P.SCORE_SLACK).rangeBetween(Window.unboundedPreceding, -1)
    return first.withColumn("above", F.count("*").over(above)).where(F.col("above") < keep).select(*by, "rel")


def hints_of(named: DataFrame) -> DataFrame:
    """named(qid, text, file) -> hints(qid, modules, traces): dotted names as paths of two words or more, and files of tracebacks."""
    bits = F.split(F.lower("text"), r"\.")
    paths = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(bits))), lambda n: F.array_join(F.slice(bits, F.lit(1), n), "/"))
    dotted = F.contains("text", F.lit(".")) & ~F.contains("text", F.lit("/"))
    per = named.select("qid", F.when(dotted, paths).alias("paths"), F.replace("file", F.lit("\\"), F.lit("/")).alias("file"))
    return per.groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list("paths"))).alias("modules"), F.collect_set("file").alias("traces"))


def score_files(docs: DataFrame, names: DataFrame, hits: DataFrame, defs: DataFrame, keep: int = P.SCORE_KEEP, hints: DataFrame | None = None) -> DataFrame:
    """docs, names(qid, part, plain), hits(rel, part, n), defs -> (qid, rel, kind, heuristic, place).

    A file's score sums the rarity of the parts it mentions (half for plain words, threefold where it defines them), doubled where a
    dotted name of the question is its path, times 1.5 where its stem is the last word of a part and times the weight of its kind, over the
    best score of the question. A file that a traceback names comes before all others. hints(qid, modules, traces) hold the names of a question.

    Parts that stand in many files are summed once for all questions that share them (a head); of a head's files a question takes those that
    can be among its first `keep`: the leading ones, those among its stems and its modules, and those that a traceback names.
    """
    files = hits.select("rel", "part").distinct()
    idf = rarity(files, docs.agg(F.count("*").alias("n_docs")))
    own = definers(names, defs).withColumn("own", F.lit(1))
    worth = F.col("idf") * F.when(F.col("plain"), P.PLAIN).otherwise(1.0) * F.when(F.col("own") == 1, P.DEFINES).otherwise(1.0)
    rare, of, heads = split_common(names.select("qid", "part", "plain"), "qid", idf.select("part", F.col("df").alias("files")), P.COMMON_FILES)
    met = lambda t: t.join(files, "part").join(idf, "part").join(own, ["rel", "part"], "left").withColumn("worth", worth)
    few = met(rare).groupBy("qid", "rel").agg(F.sum("worth").alias("raw"))
    many = met(heads).groupBy("head", "rel").agg(F.sum("worth").alias("raw"), F.sort_array(F.collect_set(F.struct("part", "own"))).alias("held"))
    stems = names.groupBy("qid").agg(F.collect_set(F.lower(F.substring_index("part", ".", -1))).alias("stems"))
    kinds = docs.select("rel", X.file_kind(F.col("rel"), F.col("body"), F.col("size")).alias("kind"))
    led = many.join(wide(kinds), "rel").withColumns({"raw": F.col("raw") * X.kind_weight(F.col("kind")), "stem": _stem(F.lower("rel"))})
    asked = of.join(stems, "qid").select("qid", "head", F.explode("stems").alias("stem"))
    stemmed = _leading(led.join(asked.select("head", "stem").distinct(), ["head", "stem"]), ["head", "stem"], keep)
    more = [of.join(_leading(led, ["head"], keep), "head"), asked.join(stemmed, ["head", "stem"])]
    if hints is not None:
        dotted = of.join(hints, "qid").select("qid", "head", F.explode("modules").alias("module"))
        inside = in_modules(dotted.select("module"), docs)
        below = led.join(dotted.select("head", "module").distinct().join(inside, "module"), ["head", "rel"])
        both = dotted.join(asked, ["qid", "head"]).join(inside.withColumn("stem", _stem(F.lower("rel"))), ["module", "stem"])
        named = of.join(hints, "qid").select("qid", F.explode("traces").alias("trace"))
        more += [dotted.join(_leading(below, ["head", "module"], keep), ["head", "module"]), both, named.join(traced_files(named.select("trace"), docs), "trace")]
    every = few
    for t in more:
        every = every.unionByName(t.select("qid", "rel", F.lit(None).cast("double").alias("raw")))
    every = every.groupBy("qid", "rel").agg(F.sum("raw").alias("few")).join(of, "qid", "left").join(many.select("head", "rel", F.col("raw").alias("many")), ["head", "rel"], "left")
    raw = every.where("few is not null or many is not null").select("qid", "rel", (F.coalesce("few", F.lit(0.0)) + F.coalesce("many", F.lit(0.0))).alias("raw"))
    scored = raw.join(wide(kinds), "rel").join(stems, "qid")
    low = F.lower("rel")
    boost = F.when(F.array_contains("stems", _stem(low)), P.STEM).otherwise(1.0)
    traced = F.lit(False)
    if hints is not None:
        scored = scored.join(hints, "qid", "left")
        boost = boost * F.when(F.exists("modules", lambda m: _in_module(low, m)), P.MODULE).otherwise(1.0)
        traced = (X.kind_weight(F.col("kind")) > 0) & F.coalesce(F.exists("traces", lambda f: F.endswith(f, F.substring_index("rel", "/", -2))), F.lit(False))
    scored = scored.withColumn("raw", F.col("raw") * boost * X.kind_weight(F.col("kind"))).withColumn("traced", traced)
    question = Window.partitionBy("qid")
    scored = scored.withColumn("raw", F.when(F.col("traced"), P.TRACED * F.max("raw").over(question)).otherwise(F.col("raw")))
    best = F.max("raw").over(question)
    scored = scored.withColumn("heuristic", F.when(best > 0, F.col("raw") / best).otherwise(0.0))
    return top(scored.select("qid", "rel", "kind", "heuristic"), ["qid"], [F.desc(F.round("heuristic", 9)), "rel"], keep)


def match_windows(hits: DataFrame, idf: DataFrame) -> DataFrame:
    """(rel, from, to): up to three windows of two lines either way around the rarest mentions of each file."""
    rows = hits.join(idf.select("part", "idf"), "part").groupBy("rel").agg(F.array_sort(F.collect_list(F.struct((-F.col("idf")).alias("k"), "part", "n"))).alias("rows"))
    none = F.array().cast("array<struct<from:int,to:int>>")
    step = lambda acc, r: F.when((F.size(acc) < P.WINDOWS) & ~F.exists(acc, lambda w: r["n"].between(w["from"], w["to"])), F.concat(acc, F.array(F.struct(F.greatest(F.lit(1), r["n"] - P.REACH).cast("int").alias("from"), (r["n"] + P.REACH).cast("int").alias("to"))))).otherwise(acc)
    return rows.select("rel", F.explode(F.array_sort(F.aggregate("rows", none, step))).alias("w")).select("rel", "w.*")


def module_files(modules: DataFrame, docs: DataFrame) -> DataFrame:
    """modules(module) -> (module, rel): a/b.py or a/b/__init__.py, whole or at the end of a path; an equi-join on path suffixes."""
    path = F.replace(F.col("module"), F.lit("."), F.lit("/"))
    wanted = modules.select("module").distinct().select("module", F.explode(F.array(F.concat(path, F.lit(".py")), F.concat(path, F.lit("/__init__.py")))).alias("suffix"))
    bits = F.split("rel", "/")
    suffixes = docs.select("rel", F.explode(F.transform(F.sequence(F.lit(1), F.size(bits)), lambda i: F.array_join(F.slice(bits, i, F.size(bits)), "/"))).alias("suffix"))
    return wanted.join(wide(suffixes), "suffix").select("module", "rel")


def imports(lines: DataFrame) -> DataFrame:
    """(rel, module): modules that Python files import."""
    plain, many = r"^\s*import\s+([\w.]+(?:\s*,\s*[\w.]+)*)", r"^\s*from\s+([\w.]+)\s+import\s"
    found = F.concat(F.split(F.regexp_extract("line", plain, 1), r"\s*,\s*"), F.array(F.regexp_extract("line", many, 1)))
    return lines.where(F.col("rel").rlike(r"\.pyi?$")).select("rel", F.explode(found).alias("module")).where((F.col("module") != "") & ~F.col("module").startswith(".")).distinct()


def call_sites(lines: DataFrame, names: DataFrame) -> DataFrame:
    """names(name) -> (name, rel, n): lines that call a name and don't declare it."""
    calls = lines.select("rel", "n", "line", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"([A-Za-z_][0-9A-Za-z_]*)\s*\("), 1))).alias("name"))
    declared = F.regexp_extract("line", r"^\s*(?:async\s+)?(?:def|class|function)\s+([A-Za-z_][0-9A-Za-z_]*)", 1)
    return calls.where(declared != F.col("name")).join(names.select("name").distinct(), "name", "left_semi").select("name", "rel", "n")


def sibling_overrides(defs: DataFrame) -> DataFrame:
    """(rel, name, other, line): methods of the same name in other files whose classes share a base.

    Joined on (base, name), so a common method name alone pairs nothing.
    """
    classes = defs.where("form = 'class'").select("rel", F.col("name").alias("owner"), F.explode("bases").alias("base"))
    methods = defs.where("form = 'def' and owner is not null").select("rel", "owner", "name", "line").join(classes, ["rel", "owner"])
    return methods.select("base", "name", "rel", "line")


# Patterns of calls, imports and bases, with the weight of each.
_OUTGOING = (
    (r"(?<![\w$])([A-Za-z_$][\w$]*)\s*\(", 1),
    (r"^\s*from\s+[\w.]+\s+import\s+\(?([^#\n]+)", 2),
    (r"^\s*import\s+([\w.]+(?:\s*,\s*[\w.]+)*)", 2),
    (r"^\s*import\s+(?:type\s+)?\{([^}]*)\}\s+from", 2),
    (r"^\s*class\s+\w+\s*\(([^)]*)\)", 3),
    (r"\bextends\s+([\w$.]+)", 3),
)
_DECLARED = r"^\s*(?:async\s+)?(?:def|class|function)\s+([A-Za-z_$][\w$]*)"


def _weighed(names: Column, weight: int) -> Column:
    return F.transform(names, lambda m: F.struct(m.alias("said"), F.lit(weight).alias("w")))


def outgoing_links(lines: DataFrame, most: int = 30) -> DataFrame:
    """(rel, name, weight, place): names a file calls (1), imports (2) or derives from (3), summed, without its own and common ones.

    Of a dotted or renamed one the last part of what it was; names of under three letters don't count.
    """
    said = lambda pattern: F.flatten(F.transform(F.regexp_extract_all("line", F.lit(pattern), 1), lambda m: F.split(F.regexp_replace(m, r"[()\\]", ""), ",")))
    each = F.flatten(F.array(*(_weighed(said(p), w) for p, w in _OUTGOING)))
    found = lines.select("rel", F.explode(each).alias("x")).select("rel", "x.*").where(~F.contains("said", F.lit("=")))
    last = F.substring_index(F.trim(F.substring_index(F.trim("said"), " as ", 1)), ".", -1)
    own = lines.select("rel", F.regexp_extract("line", _DECLARED, 1).alias("name")).where("name <> ''").distinct()
    every = found.select("rel", last.alias("name"), "w").where(F.col("name").rlike(r"^[A-Za-z_$][\w$]{2,}$") & ~F.col("name").isin(*P.COMMON)).join(own, ["rel", "name"], "left_anti")
    return top(every.groupBy("rel", "name").agg(F.sum("w").alias("weight")), ["rel"], [F.desc("weight"), "name"], most)
