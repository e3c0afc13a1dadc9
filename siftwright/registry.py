"""The search operators' queries over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import params as P
from .functions import text as X
from .operators import code, judge, lines, links, names, probe, rank, report, segment, survey
from .plans import search
from .sources import tables as T
from .sources.tree import stale

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _docs(s: SparkSession, d: str) -> DataFrame:
    return T.corpus(s, d, T.DOCS_SQL, "documents")


def _code(s: SparkSession, d: str) -> DataFrame:
    return T.corpus(s, d, T.CODE_SQL, "part")


def _convs(s: SparkSession, d: str) -> DataFrame:
    return T.corpus(s, d, T.CONV_SQL, "conversations")


def _questions(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("body"))


def _names(s: SparkSession, d: str) -> DataFrame:
    """One question for each part size: its method and its base class."""
    sizes = s.read.parquet(f"{d}/part.parquet").select(F.col("p_size").alias("qid")).distinct()
    name = lambda head: F.concat(F.lit(head), F.col("qid").cast("string"))
    return sizes.select("qid", F.explode(F.array(F.struct(name("price_").alias("part"), F.lit(False).alias("plain")), F.struct(name("Base").alias("part"), F.lit(True).alias("plain")))).alias("x")).select("qid", "x.*")


_PARTS = "with m as (select 'src/' || lower(replace(p_type, ' ', '_')) || '/m' || p_partkey || '.py' as rel, p_size as z, p_partkey as k, p_type from part) "
_D = f"with docs as ({T.DOCS_SQL}) "
_C = f"with docs as ({T.CODE_SQL}), lines as (select rel, unnest(string_split(body, chr(10))) as line, generate_subscripts(string_split(body, chr(10)), 1) as n from docs) "
_SQUASH = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_NAMES = "names as (select distinct p_size as qid, 'price_' || p_size as part, 1.0 as w from part union all select distinct p_size, 'Base' || p_size, 0.5 from part)"
_DEFS = r"""defs as (select rel, n as line, case when line like 'class %' then 'class' when line like '%def %' then 'def' else 'assign' end as form,
 case when line like 'class %' then regexp_extract(line, '^class\s+(\w+)', 1) when line like '%def %' then regexp_extract(line, '^\s*def\s+(\w+)', 1) else regexp_extract(line, '^(\w+) =', 1) end as name,
 case when line like '    def %' then 'Part' || regexp_extract(rel, 'm([0-9]+)[.]py$', 1) end as owner from lines where regexp_matches(line, '^(class |\s*def |\w+ =)'))"""
_HITS = "hits as (select distinct rel, part, n from (select rel, n, unnest(regexp_extract_all(line, '[0-9A-Za-z_]+')) as part from lines) join (select distinct part from names) using (part))"


@_query(_D + "select rel, strlen(body)::bigint as size, sha256(body) as sha from docs")
def scan_docs(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("rel", "size", "sha")


@_query(_D + "select rel from docs where body <> replace(body, '%%%', '')")
def verify_stale(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d)
    return stale(docs, T.as_docs(docs.select("rel", F.replace("body", F.lit("%%%"), F.lit("")).alias("body"))))


@_query(_D + r"select rel, substr(array_to_string(list_filter(string_split(replace(body, chr(13) || chr(10), chr(10)), chr(10)), lambda x: not regexp_matches(x, '^\s*$'))[1:30], chr(10)), 1, 2000) as outline from docs")
def outline_preview(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("rel", X.head_lines(F.col("body"), 30, 2000).alias("outline"))


@_query(_D.replace("with docs", "with docs_").rstrip() + f", code_ as ({T.CODE_SQL}) select rel, 'docs' as kind, 0.3::double as weight from docs_ where not (length(body) > 2000 and length(regexp_replace(substr(body, 1, 200000), '[^0-9]', '', 'g')) / greatest(1, length(regexp_replace(substr(body, 1, 200000), '[\\x00-\\x20]', '', 'g'))) > 0.3) union all select rel, 'source', 1.0 from code_")
def file_kind(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d).unionByName(_code(s, d))
    return docs.select("rel", X.file_kind(F.col("rel"), F.col("body"), F.col("size")).alias("kind")).select("rel", "kind", X.kind_weight(F.col("kind")).alias("weight"))


@_query(_D.replace("with docs", "with docs_").rstrip() + f", code_ as ({T.CODE_SQL}) select round((select count(*) from code_) / ((select count(*) from code_) + (select count(*) from docs_)), 6) as share")
def source_share(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d).select("rel").union(_code(s, d).select("rel"))
    return docs.where(~F.col("rel").rlike(P.BACK_DIRS)).agg(F.round(F.coalesce(F.avg(F.col("rel").rlike(P.SOURCE_EXT).cast("int")), F.lit(0.0)), 6).alias("share"))


@_query(_D + f"select rel, {_SQUASH.format('body')} as field from docs")
def squash_fields(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("rel", X.squash(F.col("body")).alias("field"))


@_query(_D + "select rel, generate_subscripts(string_split(body, chr(10)), 1)::int as n, unnest(string_split(body, chr(10))) as line from docs")
def line_explode(s: SparkSession, d: str) -> DataFrame:
    return lines.lines_of(_docs(s, d))


@_query()
def probe_ids(s: SparkSession, d: str) -> DataFrame:
    return probe.ids_in(_docs(s, d), "rel").select("rel", "value", "id_key", probe.id_rank(F.col("value")).alias("id_rank"))


_TERMS = f"q as (select item_id as qid, string_split({_SQUASH.format('text')}, ' ') as w from benchmark), terms as (select distinct qid, array_to_string(w[i * 4 + 1:i * 4 + 4], ' ') as key from (select qid, w, unnest(range(0, (len(w) - 1) // 4 + 1)) as i from q) where len(w[i * 4 + 1:i * 4 + 4]) = 4)"
_MATCH = _D.rstrip() + f""", {_TERMS}, fields as (select rel, ' ' || {_SQUASH.format('body')} || ' ' as field from docs),
held as (select key, rel from (select distinct key from terms) k join fields on contains(field, ' ' || key || ' ')), active as (select key from held group by key having count(*) <= 50),
live as (select * from terms join active using (key)), per as (select qid, count(*) as of_ from live group by qid),
hits as (select qid, rel, count(*) / any_value(of_) as matched_share from live join held using (key) join per using (qid) group by qid, rel),
ranked as (select *, 0.6 + 0.4 * matched_share as weight, row_number() over (partition by qid order by matched_share desc, rel) as place from hits) """


@_query(_MATCH + "select qid, rel, round(matched_share, 6) as matched_share, round(weight, 6) as weight, place::int as place from ranked where place <= 50")
def probe_match(s: SparkSession, d: str) -> DataFrame:
    found = probe.match_docs(_docs(s, d), search.grams(_questions(s, d)))
    return found.select("qid", "rel", F.round("matched_share", 6).alias("matched_share"), F.round("weight", 6).alias("weight"), "place")


@_query(_MATCH + "select qid, rel, round(weight, 6) as rank, place::int as place, place <= 6 as listed from ranked where place <= 50")
def probe_route(s: SparkSession, d: str) -> DataFrame:
    found = search.probe_route(_docs(s, d), search.grams(_questions(s, d)))
    return found.select("qid", "rel", F.round("rank", 6).alias("rank"), "place", "listed")


def _asked(s: SparkSession, d: str) -> DataFrame:
    s.read.parquet(f"{d}/part.parquet").createOrReplaceTempView("part")
    return s.sql(T.ASKED_SQL)


@_query(f"""with k as (select p_partkey as k, p_name, p_size as z from part), t as (
select k as qid, 1 as o, 'phrase' as form, p_name || ' now' as value, {_SQUASH.format("p_name || ' now'")} as key from k union all
select k, 2, 'phrase', 'src/core/m' || k || '.py', 'src core m' || k || ' py' from k union all
select k, 3, 'id', 'Part' || k || '.price_' || z, 'part' || k || ' price ' || z from k where length(k::varchar || z::varchar) >= 3 union all
select k, 4, 'id', 'INV-' || (10000 + k), 'inv ' || (10000 + k) from k union all
select k, 5, 'name', 'Acme Tools & Sons', 'acme tools sons' from k) select qid, row_number() over (partition by qid order by o)::int as pos, form, value, key from t""")
def probe_terms(s: SparkSession, d: str) -> DataFrame:
    return names.terms_in(_asked(s, d))


@_query("""with k as (select p_partkey as k, p_size as z from part)
select k as qid, 1::int as pos, 'src/core/m' || k || '.py' as text, 'make_part' || case when length('m' || k) >= 3 then '|m' || k else '' end as parts, 'traceback' as origin from k union all
select k, 2, 'Part' || k || '.price_' || z, 'Part' || k || '.price_' || z || '|Part' || k || '|price_' || z, 'backtick' from k union all
select k, 3, 'Size' || z || 'Error', 'Size' || z || 'Error', 'error' from k union all
select k, 4, 'm' || k || '.py', 'm' || k || '.py' || case when length('m' || k) >= 3 then '|m' || k else '' end, 'dotted' from k union all
select k, 5, 'price_' || z, 'price_' || z, 'ident' from k union all
select k, 6, 'make_part', 'make_part', 'ident' from k union all
select k, 7, '--dry-run', '--dry-run', 'flag' from k""")
def code_names(s: SparkSession, d: str) -> DataFrame:
    return names.code_names(_asked(s, d)).select("qid", "pos", "text", F.array_join("parts", "|").alias("parts"), "origin")


@_query("""with k as (select 'web/' || lower(replace(p_type, ' ', '_')) || '/w' || p_partkey || '.ts' as rel, p_partkey as k, p_size as z from part)
select rel, 'Part' || k as name, 1::int as line, 'class' as form, null as owner, 'Base' || z as base from k union all
select rel, 'price' || z, 2, 'def', 'Part' || k, null from k union all select rel, 'twice', 4, 'def', 'Part' || k, null from k union all
select rel, 'Shape' || k % 11, 8, 'assign', null, null from k union all select rel, 'make' || k % 7, 9, 'function', null, null from k union all
select rel, 'limit' || z, 12, 'assign', null, null from k""")
def script_defs(s: SparkSession, d: str) -> DataFrame:
    found = lines.script_defs(lines.lines_of(T.corpus(s, d, T.SCRIPT_SQL, "part")))
    return found.select("rel", "name", "line", "form", "owner", F.try_element_at("bases", F.lit(1)).alias("base"))


@_query()
def probe_chain(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d)
    ids = probe.ids_in(docs, "rel").withColumnRenamed("rel", "qid").select("qid", "value", "id_key")
    return probe.chain(ids, docs).select("qid", "rel", F.round("weight", 6).alias("weight"))


@_query(_C + f", {_NAMES}, {_HITS} select * from hits")
def grep_words(s: SparkSession, d: str) -> DataFrame:
    return code.grep(lines.lines_of(_code(s, d)), _names(s, d)).select("rel", "part", F.col("n").cast("long").alias("n"))


@_query(_C + f", {_NAMES}, {_HITS} select part, count(distinct rel)::bigint as df, round(ln(((select count(*) from docs) + 1) / (count(distinct rel) + 1)) + 0.1, 6) as idf from hits group by part")
def doc_frequency_idf(s: SparkSession, d: str) -> DataFrame:
    docs = _code(s, d)
    return code.rarity(code.grep(lines.lines_of(docs), _names(s, d)), docs.agg(F.count("*").alias("n_docs"))).select("part", "df", F.round("idf", 6).alias("idf"))


@_query(_C + f", {_NAMES}, {_HITS}, {_DEFS} select part, count(distinct rel)::bigint as mentioned, count(distinct case when own then rel end)::bigint as defined from (select h.rel, h.part, d.name is not null as own from hits h left join (select distinct rel, name from defs) d on d.rel = h.rel and d.name = h.part) group by part")
def name_stats(s: SparkSession, d: str) -> DataFrame:
    every = lines.lines_of(_code(s, d))
    return code.name_stats(code.grep(every, _names(s, d)), lines.python_defs(every))


@_query(_C + f", {_DEFS} select rel, name, line::int as line, form, owner from defs")
def python_defs(s: SparkSession, d: str) -> DataFrame:
    return lines.python_defs(lines.lines_of(_code(s, d))).select("rel", "name", "line", "form", "owner")


@_query(_C + f", {_NAMES}, {_DEFS} select rel, name, line::int as line, form from defs where name in (select part from names)")
def find_defs(s: SparkSession, d: str) -> DataFrame:
    wanted = _names(s, d).select(F.col("part").alias("name")).distinct()
    return lines.python_defs(lines.lines_of(_code(s, d))).join(wanted, "name", "left_semi").select("rel", "name", "line", "form")


_SCORE = _C + f""", {_NAMES}, {_HITS}, {_DEFS}, files as (select distinct rel, part from hits), idf as (select part, ln(((select count(*) from docs) + 1) / (count(*) + 1)) + 0.1 as idf from files group by part),
raw as (select qid, f.rel, sum(idf * w * case when o.name is not null then 3 else 1 end) as raw from names join files f using (part) join idf using (part) left join (select distinct rel, name from defs) o on o.rel = f.rel and o.name = f.part group by qid, f.rel),
scored as (select qid, rel, raw / max(raw) over (partition by qid) as heuristic from raw), placed as (select *, row_number() over (partition by qid order by round(heuristic, 9) desc, rel) as place from scored) """


@_query(_SCORE + "select qid, rel, 'source' as kind, round(heuristic, 6) as heuristic, place::int as place from placed where place <= 30")
def heuristic_score(s: SparkSession, d: str) -> DataFrame:
    return search.heuristic(_code(s, d), _names(s, d)).select("qid", "rel", "kind", F.round("heuristic", 6).alias("heuristic"), "place")


@_query(_PARTS + "select rel, 1::int as \"from\", 4::int as \"to\" from m union all select rel, 3, 7 from m union all select rel, 7, 11 from m")
def match_windows(s: SparkSession, d: str) -> DataFrame:
    docs = _code(s, d)
    hits = code.grep(lines.lines_of(docs), _names(s, d))
    return code.match_windows(hits, code.rarity(hits, docs.agg(F.count("*").alias("n_docs"))))


@_query(f"with docs as ({T.CODE_SQL}) select 'src/' || p_type_ || '/m' || k || '.py' as rel, 'm' || k as module from (select lower(replace(p_type, ' ', '_')) as p_type_, p_partkey as k from part)")
def module_resolve(s: SparkSession, d: str) -> DataFrame:
    docs = _code(s, d)
    modules = docs.select(F.regexp_extract("rel", r"([^/]*)\.py$", 1).alias("module"))
    return code.module_files(modules, docs)


@_query("with m as (select 'src/' || lower(replace(p_type, ' ', '_')) || '/m' || p_partkey || '.py' as rel, p_size from part) select rel, 'base' as module from m union all select rel, 'core.b' || p_size from m")
def header_imports(s: SparkSession, d: str) -> DataFrame:
    return code.imports(lines.lines_of(_code(s, d)))


@_query("with m as (select 'src/' || lower(replace(p_type, ' ', '_')) || '/m' || p_partkey || '.py' as rel, p_size from part) select 'helper' as name, rel, 6::int as n from m")
def call_sites(s: SparkSession, d: str) -> DataFrame:
    every = lines.lines_of(_code(s, d))
    return code.call_sites(every, s.createDataFrame([("helper",)], "name string"))


@_query("with m as (select 'src/' || lower(replace(p_type, ' ', '_')) || '/m' || p_partkey || '.py' as rel, p_size, p_partkey from part) select 'Base' || p_size as base, 'price_' || p_size as name, rel, 5::int as line from m union all select 'Base' || p_size, 'name_' || p_partkey % 7, rel, 8 from m")
def sibling_overrides(s: SparkSession, d: str) -> DataFrame:
    return code.sibling_overrides(lines.python_defs(lines.lines_of(_code(s, d))))


@_query("with m as (select 'src/' || lower(replace(p_type, ' ', '_')) || '/m' || p_partkey || '.py' as rel, p_size from part), l as (select rel, 'Base' || p_size as name, 5::bigint as weight from m union all select rel, 'helper', 3 from m union all select rel, 'base', 2 from m) select rel, name, weight, row_number() over (partition by rel order by weight desc, name)::int as place from l")
def outgoing_links(s: SparkSession, d: str) -> DataFrame:
    return code.outgoing_links(lines.lines_of(_code(s, d)))


#: Turns are sections of one parent; neighbours join while they hold 2000 bytes at most. No turn of the tables is empty or above 3000 bytes, or has a heading or table of its own.
_TURNS = """with recursive t as (select 'conv/' || conv_id || '.md' as rel, row_number() over (partition by conv_id order by turn) as k, role, '## ' || role || chr(10) || coalesce(text, '') as body from conversations),
 s as (select *, strlen(body) as w, len(string_split(body, chr(10))) as n from t),
 r as (select rel, k, 0 as g, w as used from s where k = 1 union all select s.rel, s.k, case when r.used + 1 + s.w <= 2000 then r.g else r.g + 1 end, case when r.used + 1 + s.w <= 2000 then r.used + 1 + s.w else s.w end from r join s on s.rel = r.rel and s.k = r.k + 1),
 e as (select rel, k, g, role, body, n, sum(n) over (partition by rel order by k) as upto from r join s using (rel, k)),
 pieces as (select rel, g::int as pos, string_agg(role, '; ' order by k) as title, (min(upto - n) + 1)::int as "from", max(upto)::int as "to", 'heading' as shape, string_agg(body, chr(10) order by k) as body from e group by rel, g) """


@_query(_TURNS + "select * from pieces")
def segments_prose(s: SparkSession, d: str) -> DataFrame:
    return segment.segments(_convs(s, d))


@_query(_D + "select rel, 0::int as pos, '' as title, 1::int as \"from\", len(string_split(body, chr(10)))::int as \"to\", 'fallback' as shape, body from docs where trim(body) <> ''")
def segments_fallback(s: SparkSession, d: str) -> DataFrame:
    return segment.segments(_docs(s, d))


@_query("with m as (select 'src/' || lower(replace(p_type, ' ', '_')) || '/m' || p_partkey || '.py' as rel, p_size, p_partkey from part) select rel, 0::int as pos, 'Part' || p_partkey as title, 4::int as \"from\", 4::int as \"to\" from m union all select rel, 1, 'price_' || p_size, 5, 6 from m union all select rel, 2, 'name_' || p_partkey % 7, 8, 9 from m union all select rel, 3, 'make_' || p_partkey % 11, 11, 12 from m")
def segments_python(s: SparkSession, d: str) -> DataFrame:
    return segment.segments(_code(s, d)).select("rel", "pos", "title", "from", "to")


@_query(_PARTS + "select rel, 0::int as pos, 'Part' || k as title, 1::bigint as score, 1::int as place from m union all select rel, 1, 'price_' || z, 1, 2 from m union all select rel, 2, 'name_' || k % 7, 1, 3 from m")
def decl_pick(s: SparkSession, d: str) -> DataFrame:
    docs = _code(s, d)
    return judge.declarations(segment.segments(docs), code.grep(lines.lines_of(docs), _names(s, d)))


def _verdict(tag: str) -> str:
    return f"(('0x' || substr(md5({tag}), 1, 4))::int / 65535.0::double)"


@_query(_SCORE + f", t as (select qid, rel, 0.6 * {_verdict("'t:' || rel")} + 0.4 * heuristic as triage from placed where place <= 30), p as (select *, row_number() over (partition by qid order by round(triage, 9) desc, rel) as place from t) select qid, rel, round(triage, 6) as triage, place::int as place from p where place <= 12")
def triage_files(s: SparkSession, d: str) -> DataFrame:
    scored = search.heuristic(_code(s, d), _names(s, d))
    verdicts = judge.hash_verdicts(scored.select("qid", F.concat(F.lit("t:"), "rel").alias("tag")))
    return judge.triage(scored.select("qid", "rel", "heuristic"), verdicts).select("qid", "rel", F.round("triage", 6).alias("triage"), "place")


@_query(_C + f", {_NAMES}, {_HITS} select qid, part as name, count(distinct rel)::bigint as mentioned from names join hits using (part) where {_verdict("'n:' || part")} >= 0.4 group by qid, part")
def name_filter(s: SparkSession, d: str) -> DataFrame:
    names = _names(s, d)
    every = lines.lines_of(_code(s, d))
    stats = code.name_stats(code.grep(every, names), lines.python_defs(every))
    asked = names.join(stats, "part").select("qid", F.col("part").alias("name"), "mentioned")
    return judge.filter_names(asked, judge.hash_verdicts(asked.select("qid", F.concat(F.lit("n:"), "name").alias("tag"))))


_PEAK = _verdict("'f:' || rel")


@_query(_MATCH + f", k as (select qid, rel, {_PEAK} as peak, weight, matched_share from ranked where place <= 50), r as (select *, greatest(peak, weight) as rank from k), p as (select *, row_number() over (partition by qid order by rank desc, peak desc, matched_share desc, rel) as place from r) select qid, rel, round(rank, 6) as rank, place::int as place, place <= 6 as listed from p")
def rank_docs(s: SparkSession, d: str) -> DataFrame:
    found = probe.match_docs(_docs(s, d), search.grams(_questions(s, d))).withColumn("tag", F.concat(F.lit("f:"), "rel"))
    judged = found.join(judge.hash_verdicts(found.select("qid", "tag")).distinct(), ["qid", "tag"]).withColumnRenamed("probability", "peak")
    return rank.rank_docs(judged).select("qid", "rel", F.round("rank", 6).alias("rank"), "place", "listed")


@_query(_SCORE + f", t as (select qid, rel, {_PEAK} * (0.5 + 0.5 * heuristic) as score, {_PEAK} as peak from placed where place <= 30) select qid, rel, round(score, 6) as score, row_number() over (partition by qid order by round(score, 9) desc, peak desc, rel)::int as place from t")
def rank_code(s: SparkSession, d: str) -> DataFrame:
    return rank.rank_code(_judged_code(s, d)).select("qid", "rel", F.round("score", 6).alias("score"), "place")


def _judged_code(s: SparkSession, d: str) -> DataFrame:
    scored = search.heuristic(_code(s, d), _names(s, d)).withColumn("tag", F.concat(F.lit("f:"), "rel"))
    judged = scored.join(judge.hash_verdicts(scored.select("qid", "tag")), ["qid", "tag"])
    return judged.select("qid", "rel", F.col("probability").alias("peak"), F.col("heuristic").alias("triage"), X.kind_weight(F.col("kind")).alias("kind_weight"), "heuristic", F.col("place").alias("scored_place"))


@_query(_SCORE + f", t as (select qid, rel, {_PEAK} * (0.5 + 0.5 * heuristic) as rank, heuristic, place - 1 as at_ from placed where place <= 30), v as (select qid, rel, 0.75 * rank + 0.25 / (1 + at_) as value from t), p as (select *, row_number() over (partition by qid order by round(value, 9) desc, rel) as place from v) select qid, rel, round(value, 6) as value, place::int as place from p where place <= 15")
def fuse_rank(s: SparkSession, d: str) -> DataFrame:
    t = _judged_code(s, d)
    judged = rank.rank_code(t).select("qid", "rel", F.col("score").alias("rank"))
    return rank.fuse(judged, t.select("qid", "rel", "heuristic", F.col("scored_place").alias("place"))).select("qid", "rel", F.round("value", 6).alias("value"), "place")


@_query(_D + "select case i when 0 then '' when 1 then split_part(rel, '/', 1) else split_part(rel, '/', 1) || '/' || split_part(rel, '/', 2) end as dir, case i when 0 then null when 1 then '' else split_part(rel, '/', 1) end as parent, count(*)::bigint as files from docs, (select unnest([0, 1, 2]) as i) group by all")
def dir_tree(s: SparkSession, d: str) -> DataFrame:
    return survey.dir_tree(_docs(s, d))


@_query(_PARTS + "select a.k as qid, b.rel, 1::bigint as hits from m a join m b on starts_with(lower(b.p_type), lower(a.p_type)) where length(a.p_type) >= 4")
def survey_path_hits(s: SparkSession, d: str) -> DataFrame:
    asked = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("qid"), F.col("p_type").alias("body"))
    return survey.path_hits(_code(s, d), survey.query_tokens(asked))


@_query(_TURNS + """, o as (select rel, pos, row_number() over (partition by rel order by pos, rel || ':' || pos) as k, strlen(body) as w from pieces),
 b as (select rel, pos, k, 0 as batch, 1 as n, w as used from o where k = 1 union all select o.rel, o.pos, o.k, case when b.n = 24 or b.used + o.w > 16000 then b.batch + 1 else b.batch end, case when b.n = 24 or b.used + o.w > 16000 then 1 else b.n + 1 end, case when b.n = 24 or b.used + o.w > 16000 then o.w else b.used + o.w end from b join o on o.rel = b.rel and o.k = b.k + 1)
select rel as qid, rel || ':' || pos as tag, batch::int as batch from b""")
def pack_batches(s: SparkSession, d: str) -> DataFrame:
    parts = segment.segments(_convs(s, d))
    return segment.pack(parts.select(F.col("rel").alias("qid"), "pos", F.concat_ws(":", "rel", "pos").alias("tag"), "body"))


@_query("select p_size::bigint as qid, p_brand as code, count(*)::bigint as times, min_by(p_name, p_partkey) as note from part group by all")
def problems_fold(s: SparkSession, d: str) -> DataFrame:
    part = s.read.parquet(f"{d}/part.parquet")
    return judge.fold_problems(part.select(F.col("p_size").cast("long").alias("qid"), F.col("p_partkey").alias("seq"), F.col("p_brand").alias("code"), F.lit(1).alias("times"), F.col("p_name").alias("note")))


@_query(_MATCH + f""", f as (select qid, rel, round(weight, 6) as rank, row_number() over (partition by qid order by weight desc, matched_share desc, rel) as place from ranked where place <= 50),
 s as (select qid, rel, {_verdict("'s:' || rel || ':1-' || len(string_split(body, chr(10)))")} as p, body from f join docs using (rel) where place <= 6),
 h as (select qid, string_agg(case when place <= 6 then rel end, ' ' order by place) as hits, string_agg(case when place > 6 then rel end, ' ' order by place) as also from f group by qid),
 c as (select qid, count(*) as asked, count(*) filter (p >= 0.25) as sections, count(*) filter (p >= 0.6) as quotes from s group by qid)
select item_id as qid, text as question, 'probe' as route, 'done' as outcome, coalesce(hits, '') as hits, coalesce(also, '') as also, coalesce(sections, 0)::bigint as sections, coalesce(quotes, 0)::bigint as quotes, coalesce(asked, 0)::bigint as asked, (select count(*) from docs) as docs_read from benchmark left join h on h.qid = item_id left join c on c.qid = item_id""")
def report_json(s: SparkSession, d: str) -> DataFrame:
    """What the JSON reports say, read back from them."""
    docs, asked = _docs(s, d), _questions(s, d)
    ranked = search.probe_route(docs, search.grams(asked)).withColumn("via", F.lit("probe"))
    parts = ranked.where("listed").select("qid", "rel").join(search.pieces_of(docs), "rel")
    said = judge.hash_verdicts(parts.select("qid", F.concat(F.lit("s:"), "key").alias("tag")))
    kept = judge.judge_sections(parts, said).join(parts, ["qid", "rel", "key"])
    problems = s.sql("select bigint(0) as qid, bigint(0) as seq, '' as code, 1 as times, '' as note where false")
    made = report.reports(asked.withColumn("route", F.lit("probe")), ranked, kept, ranked.select("rel").where("false"), problems, report.tally(asked, docs, said))
    kind = "question string, route string, outcome string, hits array<struct<rel:string,sections:array<struct<segment:string>>,quotes:array<struct<body:string>>>>, also array<struct<rel:string>>, tally struct<asked:bigint,docs_read:bigint>"
    read = report.report_json(made).select("qid", F.from_json("report", kind).alias("r")).select("qid", "r.*")
    many = lambda c: F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + F.size(h[c]))
    return read.select("qid", "question", "route", "outcome", F.array_join("hits.rel", " ").alias("hits"), F.array_join("also.rel", " ").alias("also"), many("sections").alias("sections"), many("quotes").alias("quotes"), "tally.*")


@_query(_PARTS + "select rel, 'LIMIT_' || z as name, 'constant' as form from m")
def name_uses(s: SparkSession, d: str) -> DataFrame:
    return links.name_uses(_code(s, d).withColumns({"qid": F.lit(1), "key": F.col("rel")})).select("rel", "name", "form")


@_query("select p_partkey as qid, pos::int as pos, text from (select p_partkey, 1 as pos, 'price' || p_size as text from part union all select p_partkey, 2, 'make' || p_partkey % 7 from part union all select p_partkey, 3, 'twice' from part)")
def defined_words(s: SparkSession, d: str) -> DataFrame:
    scripts = T.corpus(s, d, T.SCRIPT_SQL, "part")
    asked = s.sql("select p_partkey as qid, 'Does price' || cast(p_size as string) || ' call make' || cast(p_partkey % 7 as string) || ' twice today?' as body from part")
    return names.defined_words(asked, lines.all_defs(lines.lines_of(scripts)))


def _first_methods(s: SparkSession, d: str) -> DataFrame:
    """For each size, the price method of its first part."""
    docs = _code(s, d)
    own = F.regexp_extract("rel", "m([0-9]+)[.]py$", 1).cast("long")
    pieces = segment.segments(docs).where("pos = 1").withColumn("qid", F.regexp_extract("title", "price_([0-9]+)$", 1).cast("int"))
    firsts = pieces.where("qid is not null").groupBy("qid").agg(F.min_by(F.struct("rel", "pos", "title", "from", "to", "body"), own).alias("x")).select("qid", "x.*")
    return firsts.select("qid", F.concat_ws("#", "rel", "pos").alias("key"), "rel", "title", "from", "to", "body")


@_query(_PARTS + ", f as (select z, min(k) as k, count(*) as n from m group by z), r as (select m.z as qid, rel, case when n <= 2 then 3.0::double else 2.0::double end as weight from m join f on f.z = m.z and f.k <> m.k), p as (select *, row_number() over (partition by qid order by weight desc, rel) as place from r) select qid, rel, 5::int as line, weight, place::int as place from p where place <= 8")
def link_targets(s: SparkSession, d: str) -> DataFrame:
    docs, chosen = _code(s, d), search.settled(_first_methods(s, d))
    every = lines.lines_of(docs)
    found = links.all_links(chosen, docs, every, search.settled(lines.all_defs(every)))
    return links.link_targets(found, docs, chosen.select("qid", "rel")).select("qid", "rel", F.element_at("at", 1).alias("line"), "weight", "place")


@_query(_PARTS + "select 1::int as qid, rel, 1::int as pos, 'price_' || z as title from m union all select 1, rel, 2, 'name_' || k % 7 from m")
def segments_around(s: SparkSession, d: str) -> DataFrame:
    docs = _code(s, d)
    targets = docs.select(F.lit(1).alias("qid"), "rel", F.array(F.lit(5), F.lit(9)).alias("at"))
    return links.segments_around(segment.segments(docs), targets).select("qid", "rel", "pos", "title")


@_query(f"with t as (select conv_id as qid, 'conv/' || conv_id as rel, conv_id || ':' || turn as key from conversations), v as (select *, {_verdict("'s:' || key")} as p from t) select qid, rel, key, round(p, 6) as probability, p >= 0.5 as quoted from v where p >= 0.25")
def judge_two_pass(s: SparkSession, d: str) -> DataFrame:
    s.read.parquet(f"{d}/conversations.parquet").createOrReplaceTempView("conversations")
    turns = s.sql("select conv_id as qid, 'conv/' || cast(conv_id as string) as rel, concat_ws(':', conv_id, turn) as key, text as body from conversations")
    return judge.two_passes(turns, judge.hash_verdicts).select("qid", "rel", "key", F.round("probability", 6).alias("probability"), "quoted")


def _types(s: SparkSession, d: str) -> DataFrame:
    """A question for each type of part: its directory in quotes."""
    part = s.read.parquet(f"{d}/part.parquet")
    return part.groupBy("p_type").agg(F.min("p_partkey").alias("qid")).select("qid", F.concat(F.lit('Show "src '), F.lower("p_type"), F.lit('" parts of 2024')).alias("body"))


_TOKENS = _PARTS + ", q as (select min(k) as qid, lower(p_type) as word from m group by lower(p_type)), lex as (select qid, word as token, true as strong from q union all select qid, 'src', true from q union all select qid, 'parts', false from q)"


@_query(_TOKENS + " select qid, token, strong from lex")
def survey_tokens(s: SparkSession, d: str) -> DataFrame:
    return survey.lexicon(_types(s, d))


@_query(_TOKENS + """, words as (select distinct p_type, unnest(['src', 'py', lower(p_type)]) as word from m), hit as (select qid, p_type, count(distinct token) as hits, count(distinct case when strong then token end) as strong from lex join words on word = token or (length(token) >= 4 and starts_with(word, token)) group by qid, p_type),
 p as (select qid, rel, hits, strong, row_number() over (partition by qid order by strong desc, hits desc, rel) as place from hit join m using (p_type) where strong >= 2 or (strong >= 1 and hits >= 2)) select qid, rel, hits::bigint as hits, round(least(0.45, 0.2 + 0.1 * hits)::double, 6) as weight, place::int as place from p where place <= 24""")
def survey_fallback(s: SparkSession, d: str) -> DataFrame:
    fits = survey.evidence(_code(s, d).select("rel"), survey.lexicon(_types(s, d))).where("fits")
    found = survey.rank_by_query(fits, P.FALLBACK_MOST)
    return found.select("qid", "rel", "hits", F.round(F.least(F.lit(0.45), 0.2 + 0.1 * F.col("hits")).cast("double"), 6).alias("weight"), "place")


@_query(_D + f""", f as (select rel, split_part(rel, '/', 1) as a, split_part(rel, '/', 1) || '/' || split_part(rel, '/', 2) as b, split_part(rel, '/', 3) as name from docs),
 picked as (select rel, {_PEAK} as p, row_number() over (order by a, split_part(b, '/', 2), name) as place from f where {_verdict("'d:' || a")} >= 0.5 and {_verdict("'d:' || b")} >= 0.5 and {_PEAK} >= 0.25)
 select item_id as qid, rel, round(p, 6) as weight, place::int as place from picked, benchmark where place <= 80""")
def survey_walk(s: SparkSession, d: str) -> DataFrame:
    """All questions, by their own words; a verdict depends on the path alone, and few words of the questions stand in a path."""
    found, _ = survey.walk(_docs(s, d), survey.lexicon(_questions(s, d)), judge.hash_verdicts, search.settled)
    return found.select("qid", "rel", F.round("weight", 6).alias("weight"), F.col("at").alias("place"))


@_query()
def link_hops(s: SparkSession, d: str) -> DataFrame:
    first = search.settled(_first_methods(s, d).withColumns({"probability": F.lit(0.9), "quoted": F.lit(True)}))
    return search.link_hops(_code(s, d), first, judge.hash_verdicts).select("qid", "rel", "key", F.round("probability", 6).alias("probability"), "quoted", "via")


@_query("""with m as (select 'web/' || lower(replace(p_type, ' ', '_')) || '/w' || p_partkey || '.ts' as rel, p_size as z, p_partkey as k from part)
select rel, 0::int as pos, 'Part' || k as title, 1::int as "from", 7::int as "to", 'declaration' as shape from m union all select rel, 1, 'price' || z, 2, 6, 'declaration' from m union all select rel, 2, 'make' || k % 7, 9, 12, 'declaration' from m""")
def segments_script(s: SparkSession, d: str) -> DataFrame:
    return segment.segments(T.corpus(s, d, T.SCRIPT_SQL, "part")).select("rel", "pos", "title", "from", "to", "shape")


@_query()
def code_route(s: SparkSession, d: str) -> DataFrame:
    ranked, _ = search.code_route(_code(s, d), _asked(s, d), judge.hash_verdicts)
    return ranked.select("qid", "rel", F.round("value", 6).alias("value"), "place")


@_query(_SCORE + """, p as (select qid, rel, regexp_extract(rel, 'm([0-9]+)[.]py$', 1)::bigint as k from placed where place <= 30), z as (select qid, rel, k, p_size as z from p join part on p_partkey = k)
select qid, rel, 0::int as pos, 'Part' || k as title, 4::int as "from", 4::int as "to" from z union all select qid, rel, 1, 'price_' || z, 5, 6 from z union all select qid, rel, 2, 'name_' || k % 7, 8, 9 from z""")
def declaration_segments(s: SparkSession, d: str) -> DataFrame:
    docs, asked = _code(s, d), _names(s, d)
    hits = code.grep(lines.lines_of(docs), asked)
    picks = search.heuristic(docs, asked).select("qid", "rel")
    return judge.declaration_segments(segment.segments(docs), picks, hits, asked).select("qid", "rel", "pos", "title", "from", "to")
