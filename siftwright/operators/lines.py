"""Lines of documents and of definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P


def lines_of(docs: DataFrame) -> DataFrame:
    """lines(rel, n from 1, line); lines end at \\n alone."""
    return docs.select("rel", F.posexplode(F.split("body", "\n", -1)).alias("p", "line")).select("rel", (F.col("p") + 1).alias("n"), "line")


def python_defs(lines: DataFrame) -> DataFrame:
    """defs(rel, name, line, form, owner, bases) of Python files: classes, functions, top-level assignments.

    The owner is the last class line before, of less indent, with no line of that or less indent between; blank lines
    and comments don't count. As the nearest such class above is the one on top of the indent stack, it is the latest
    class whose block is still open.
    """
    solid = lines.where(F.col("rel").rlike(r"\.pyi?$") & ~F.col("line").rlike(r"^\s*(#.*)?$"))
    indent = F.length(F.regexp_extract("line", r"^(\s*)", 1))
    # Patterns of Python definitions.
    cls, fun, var = r"^\s*class\s+([A-Za-z_]\w*)\s*(?:\(([^)]*)\)?)?", r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)", r"^([A-Za-z_]\w*)\s*(?::[^=]+)?=(?!=)"
    form = F.when(F.col("line").rlike(cls), "class").when(F.col("line").rlike(fun), "def").when(F.col("line").rlike(var), "assign")
    t = solid.select("rel", F.col("n").alias("line_no"), "line", indent.alias("indent"), form.alias("form"))
    # Open classes as a fold along each file's definition and dedent lines.
    row = F.struct("line_no", "indent", "form", F.regexp_extract("line", cls, 1).alias("cname"), F.regexp_extract("line", fun, 1).alias("fname"), F.regexp_extract("line", var, 1).alias("vname"), F.regexp_extract("line", cls, 2).alias("raw"))
    files = t.groupBy("rel").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    none = F.array().cast("array<struct<name:string,indent:int>>")
    out = F.array().cast("array<struct<name:string,line:int,form:string,owner:string,raw:string>>")

    def step(acc, r):  # noqa: ANN001, ANN202
        open_ = F.filter(acc["open"], lambda c: c["indent"] < r["indent"])
        owner = F.try_element_at(open_, F.lit(-1))["name"]
        name = F.when(r["form"] == "class", r["cname"]).when(r["form"] == "def", r["fname"]).otherwise(r["vname"])
        found = F.struct(name.alias("name"), r["line_no"].cast("int").alias("line"), r["form"].alias("form"), F.when(r["form"] != "assign", owner).alias("owner"), r["raw"].alias("raw"))
        opened = F.when(r["form"] == "class", F.concat(open_, F.array(F.struct(r["cname"].alias("name"), r["indent"].cast("int").alias("indent"))))).otherwise(open_)
        return F.struct(opened.alias("open"), F.when(r["form"].isNotNull(), F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"))

    defs = files.select("rel", F.explode(F.aggregate("rows", F.struct(none.alias("open"), out.alias("out")), step, lambda acc: acc["out"])).alias("d")).select("rel", "d.*")
    bases = F.transform(F.filter(F.split("raw", ","), lambda b: (F.trim(b) != "") & ~F.contains(b, F.lit("="))), lambda b: F.substring_index(F.regexp_replace(F.trim(b), r"\[.*$", ""), ".", -1))
    bases = F.filter(bases, lambda b: b.rlike(r"^[A-Za-z_$][\w$]*$") & (b != "object"))
    return defs.select("rel", "name", "line", "form", "owner", F.when(F.col("form") == "class", bases).alias("bases"))


def script_defs(lines: DataFrame) -> DataFrame:
    """defs(rel, name, line, form, owner, bases) of JavaScript and TypeScript files, by line: classes, functions, variables, exported types, methods.

    A fold along the lines that declare something or begin with a closing brace; such a brace closes the classes of its indent or more.
    Variables at the margin are assign, others def; a method needs an open class.
    """
    # Patterns of script definitions.
    name, export = r"([A-Za-z_$][\w$]*)", r"^\s*(?:export\s+)?(?:default\s+)?"
    cls = rf"{export}(?:abstract\s+)?class\s+{name}(?:\s*<[^>]*>)?(?:\s+extends\s+([\w$.]+))?"
    shapes = {
        "class": cls,
        "function": rf"{export}(?:async\s+)?function\s*\*?\s*{name}",
        "var": rf"^\s*(?:export\s+)?(?:const|let|var)\s+{name}\s*(?::[^=]+)?=",
        "type": rf"^\s*export\s+(?:declare\s+)?(?:type|interface|enum)\s+{name}",
        "method": rf"^\s+(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*{name}\s*\([^)]*\)?\s*(?::[^{{]*)?\{{\s*$",
    }
    form, found = F.when(F.col("line").rlike(r"^\s*\}"), "close"), F.lit("")
    for k, p in shapes.items():
        form = form.when(F.col("line").rlike(p), k)
    t = lines.where(F.col("rel").rlike(r"\.[cm]?[jt]sx?$")).withColumn("form", form).where("form is not null")
    for k, p in shapes.items():
        found = F.when(F.col("form") == k, F.regexp_extract("line", p, 1)).otherwise(found)
    indent = F.length(F.regexp_extract("line", r"^(\s*)", 1))
    base = F.when(F.col("form") == "class", F.substring_index(F.regexp_extract("line", cls, 2), ".", -1)).otherwise("")
    t = t.select("rel", F.struct("n", "form", found.alias("name"), indent.alias("indent"), base.alias("base"), F.col("line").rlike(r"\}\s*$").alias("ends")).alias("row"))
    files = t.groupBy("rel").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    none = F.array().cast("array<struct<name:string,indent:int>>")
    out = F.array().cast("array<struct<name:string,line:int,form:string,owner:string,base:string>>")

    def step(acc, r):  # noqa: ANN001, ANN202
        open_ = acc["open"]
        inner = F.coalesce(F.array_max(F.transform(open_, lambda c, i: F.when(c["indent"] < r["indent"], i + 1).otherwise(0))), F.lit(0))
        owner = F.try_element_at(open_, F.lit(-1))["name"]
        kind = F.when(r["form"].isin("class", "function"), r["form"]).when(r["form"] == "type", "assign").when((r["form"] == "var") & (r["indent"] == 0), "assign").otherwise("def")
        row = F.struct(r["name"].alias("name"), r["n"].cast("int").alias("line"), kind.alias("form"), F.when(r["form"] != "type", owner).alias("owner"), r["base"].alias("base"))
        counts = (r["form"] != "close") & ((r["form"] != "method") | (owner.isNotNull() & ~r["name"].isin(*P.SCRIPT_KEYWORDS)))
        opened = F.when(r["form"] == "close", F.slice(open_, F.lit(1), inner)).when((r["form"] == "class") & ~r["ends"], F.concat(open_, F.array(F.struct(r["name"].alias("name"), r["indent"].cast("int").alias("indent"))))).otherwise(open_)
        return F.struct(opened.alias("open"), F.when(counts, F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"))

    defs = files.select("rel", F.explode(F.aggregate("rows", F.struct(none.alias("open"), out.alias("out")), step, lambda acc: acc["out"])).alias("d")).select("rel", "d.*")
    return defs.select("rel", "name", "line", "form", "owner", F.when(F.col("form") == "class", F.filter(F.array("base"), lambda b: b != "")).alias("bases"))


def all_defs(lines: DataFrame) -> DataFrame:
    """Definitions of Python and of script files."""
    return python_defs(lines).unionByName(script_defs(lines))


def wide(df: DataFrame) -> DataFrame:
    """df as a side of a join that grows with the corpus: joined by sorting.

    Its size is estimated from compressed files and shrinks with every column cut off, so that Spark would send whole corpora through the driver.
    """
    return df.hint("merge")


def split_common(wanted: DataFrame, by: str, counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """wanted(by, key columns), counts(some of them, files) -> rare(by, key columns), of(by, head), heads(head, key columns).

    What stands in more than `most` files is not joined for each `by`: `by` with the same set of such keys share a head, and their files are
    joined once for it. What stands in none is left out.
    """
    keys = [c for c in wanted.columns if c != by]
    counted = wanted.join(counts, [c for c in counts.columns if c != "files"])
    of = counted.where(F.col("files") > most).groupBy(by).agg(F.sort_array(F.collect_set(F.struct(*keys))).alias("head"))
    return counted.where(F.col("files") <= most).select(by, *keys), of, of.select("head").distinct().select("head", F.inline("head"))


def top(df: DataFrame, by: list, order: list, k: int) -> DataFrame:
    """The first k rows of each group, with their place from 1."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)
