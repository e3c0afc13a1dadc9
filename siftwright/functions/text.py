"""Column expressions over text, paths and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P


def squash(text: Column) -> Column:
    """Lower case, every run of other than letters and digits one space, trimmed. (Texts are taken as NFKC.)"""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def wrapped(text: Column) -> Column:
    """squash() between spaces, for whole-token substring tests."""
    return F.when(squash(text) == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), squash(text), F.lit(" ")))


def strip_edges(text: Column) -> Column:
    return F.regexp_replace(text, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def chunks(text: Column) -> Column:
    """Pieces between white space, brackets and quotes."""
    return F.filter(F.split(text, "[\\s|()\\[\\]{}<>\"'`“”‘’*;]+"), lambda x: x != "")


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.coalesce(F.regexp_extract(text, pattern, group).try_cast("int"), F.lit(-1))


def is_calendar_noise(token: Column) -> Column:
    """Years, year-months and dates in the usual shapes, with plausible parts."""
    t = token
    year = lambda c: c.between(1900, 2099)
    month, day = (lambda c: c.between(1, 12)), (lambda c: c.between(1, 31))
    ym, my = r"^([0-9]{4})[-/.]([0-9]{1,2})$", r"^([0-9]{1,2})[-/.]([0-9]{4})$"
    out = t.rlike("^(19|20)[0-9]{2}$")
    out = out | (year(_number(t, ym, 1)) & month(_number(t, ym, 2))) | (year(_number(t, my, 2)) & month(_number(t, my, 1)))
    for sep in ("-", "/", r"\."):
        ymd = rf"^([0-9]{{4}}){sep}([0-9]{{1,2}}){sep}([0-9]{{1,2}})(T.*)?$"
        mdy = rf"^([0-9]{{1,2}}){sep}([0-9]{{1,2}}){sep}([0-9]{{2}}|[0-9]{{4}})$"
        out = out | (year(_number(t, ymd, 1)) & month(_number(t, ymd, 2)) & day(_number(t, ymd, 3)))
        out = out | (month(_number(t, mdy, 1)) & day(_number(t, mdy, 2)) & F.regexp_extract(t, mdy, 3).rlike("^([0-9]{2}|(19|20)[0-9]{2})$"))
    dmy = r"^([0-9]{1,2})[-/. ]([A-Za-z]{3,9})[-/. ]([0-9]{4})$"
    return out | (day(_number(t, dmy, 1)) & F.lower(F.regexp_extract(t, dmy, 2)).isin(*P.CALENDAR) & year(_number(t, dmy, 3)))


def qualifies_as_id(token: Column) -> Column:
    """Three ASCII digits at least, and no date."""
    return (F.length(F.regexp_replace(token, "[^0-9]", "")) >= 3) & ~is_calendar_noise(token)


def phrases(text: Column) -> Column:
    """Double-quoted spans; an open quote runs to the end."""
    return F.filter(F.regexp_extract_all(text, F.lit('["“”]([^"“”]*)(?:["“”]|$)'), 1), lambda x: F.trim(x) != "")


def head_lines(body: Column, n: int, most: int) -> Column:
    """The first n lines that aren't blank, at most `most` characters."""
    lines = F.slice(F.filter(F.split(body, r"\r?\n", -1), lambda x: ~x.rlike(r"^\s*$")), 1, n)
    return F.substring(F.array_join(lines, "\n"), 1, most)


def word_pattern(part: Column) -> Column:
    """A pattern for the part as a whole ASCII word."""
    return F.concat(F.lit(r"(?<![\w])\Q"), part, F.lit(r"\E(?![\w])"))


def identifiers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([0-9A-Za-z_]+)"), 1))


def digit_share(body: Column) -> Column:
    head = F.substring(body, 1, 200_000)
    solid = F.length(F.regexp_replace(head, r"[\x00-\x20]", ""))
    return F.when(solid > 0, F.length(F.regexp_replace(head, "[^0-9]", "")) / solid).otherwise(0.0)


def file_kind(rel: Column, body: Column, size: Column) -> Column:
    """source, test, example, docs, changelog or data, by the first rule that fits."""
    low = F.lower(rel)
    name, dirs = F.regexp_extract(low, r"([^/]*)$", 1), F.regexp_replace(low, r"[^/]*$", "")
    within = lambda words: dirs.rlike(rf"(^|/)({words})/")
    code = low.rlike(r"\.(py|pyx|pxd|pyi|js|jsx|ts|tsx|mjs|cjs|c|h|cc|cpp|hpp|rs|go|java|rb)$")
    return (
        F.when(name.rlike("^(changes|changelog|history|news|release[-_]?notes)"), "changelog")
        .when(name.rlike("^(issue_template|pull_request_template)") | F.contains(low, F.lit(".github/issue_template")), "changelog")
        .when(within("announce|releases?|whatsnew|release[-_]?notes|changelog|changes|upcoming_changes"), "changelog")
        .when(name.rlike(r"\.(svg|ai|eps|pdf|png|jpe?g|gif|ico)$"), "data")
        .when(name.rlike(r"\.(json|csv|tsv|dat)$") & (size > 20_000), "data")
        .when((F.length(body) > 2000) & (digit_share(body) > 0.3), "data")
        .when(within("tests|test|testing"), "test")
        .when(name.rlike(r"^test_.*\.py$|_test\.py$|^conftest\.py$|\.(test|spec)\.[jt]sx?$"), "test")
        .when(within("examples?|galleries|gallery|benchmarks?|asv_bench|tutorials?"), "example")
        .when(within("docs?"), F.when(code, "example").otherwise("docs"))
        .when(name.rlike(r"\.(rst|md|txt)$"), "docs")
        .otherwise("source")
    )


def kind_weight(kind: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in P.KIND_WEIGHTS.items() for x in kv))[kind]
