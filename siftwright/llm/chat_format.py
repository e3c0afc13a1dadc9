"""Operator 7: flatten typed chat messages into one training string per conversation.

Method: a visitor over typed content parts. Each part kind has its own rendering: text is escaped, image, audio and
document parts become ordered placeholders, and their references, places and expanded token counts are recorded.
Turns are marked by control strings; any control string inside a text is escaped so that reading back gives exactly
the text. Spans of the assistant's texts form the loss mask. Parts and turns are rows, and places are running sums over
them, so the work grows in proportion to a conversation's parts. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|turn|>", "<|end|>\n"
PART = "struct<kind:string,text:string,ref:string,tokens:int>"
MEDIA = ("image", "audio", "document")
#: What begins a control string, and what must follow for it to be one: <| <s> </s> [INST] [/INST].
_OPENER, _FOLLOWS = r"([<\[])", r"(\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    """Backslashes double; a control string gets one backslash after its first character."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"{_OPENER}(?={_FOLLOWS})", r"$1\\")


def unescape(text: Column) -> Column:
    """The text that escape() was given."""
    return F.replace(F.regexp_replace(text, rf"(?<=[<\[])\\(?={_FOLLOWS})", ""), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    pieces = F.transform(F.split(role, r"\\\\", -1), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(pieces, "\\\\"))


def _visit(part: Column, place: Column) -> Column:
    """What one part becomes in the string; place counts the conversation's attachments, from 0."""
    kind = F.coalesce(part["kind"], F.lit("text"))
    out = F.when(kind == "text", escape(F.coalesce(part["text"], F.lit(""))))
    for medium in MEDIA:
        out = out.when(kind == medium, F.concat(F.lit(f"<|{medium}:"), place.cast("string"), F.lit("|>")))
    return out.otherwise(F.lit(""))


def format_conversations(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, parts array of PART, more) -> one row per conversation.

    conv_id, n_turns, formatted, attachments (kind, ref, place, turn_place, tokens), expanded_tokens (words of the texts and
    the tokens that the placeholders stand for), loss (spans of the assistant's contents: turn_place, at (in the turn), from
    (in formatted), chars; code points). Turns go by turn, then role and parts, so repeated rows are turns of their own in
    either order; a null turn comes first, a null role is empty, null parts are none, a part of null kind is a text, of
    unknown kind nothing. A null conv_id is a conversation of its own. An empty table gives none. Other columns, whatever
    their names, are ignored. A conversation of any length, its texts included, is one output value: only there do its
    rows meet.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    said = messages.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), parts.alias("parts"))
    conv = Window.partitionBy("conv_id")
    turns = said.withColumn("turn_place", F.row_number().over(conv.orderBy("turn", "role", "parts")) - 1)
    each = turns.select("conv_id", "turn_place", "role", F.posexplode_outer("parts").alias("pos", "part"))
    kind = F.coalesce(F.col("part.kind"), F.lit("text"))
    media = kind.isin(*MEDIA)
    before = conv.orderBy("turn_place", "pos").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("place", F.coalesce(F.sum(media.cast("int")).over(before), F.lit(0)).cast("int"))
    n_words = F.size(F.filter(F.split(F.coalesce(F.col("part.text"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    tokens = F.when(kind == "text", n_words).when(media, F.coalesce("part.tokens", F.lit(0))).otherwise(0).cast("long")
    attachment = F.when(media, F.struct("place", kind.alias("kind"), F.col("part.ref").alias("ref"), "turn_place", F.coalesce("part.tokens", F.lit(0)).alias("tokens")))
    rendered = each.groupBy("conv_id", "turn_place").agg(
        F.first("role").alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", _visit(F.col("part"), F.col("place")).alias("piece")))), lambda x: x["piece"]), "").alias("content"),
        F.collect_list(attachment).alias("attachments"),
        F.sum(tokens).alias("tokens"),
    )
    rendered = rendered.withColumn("head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")))
    rendered = rendered.withColumn("body", F.concat("head", "content", F.lit(END))).withColumn("at", F.length("head").cast("long")).withColumn("chars", F.length("content").cast("long"))
    earlier = conv.orderBy("turn_place").rowsBetween(Window.unboundedPreceding, -1)
    rendered = rendered.withColumn("begin", F.coalesce(F.sum(F.length("body")).over(earlier), F.lit(0)).cast("long"))
    loss = F.when(F.col("role") == "assistant", F.struct("turn_place", "at", (F.col("begin") + F.col("at")).alias("from"), "chars"))
    convs = rendered.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_place", "body"))), lambda x: x["body"]), "").alias("formatted"),
        F.array_sort(F.flatten(F.collect_list("attachments"))).alias("attachments"),
        F.sum("tokens").alias("expanded_tokens"),
        F.array_sort(F.collect_list(loss)).alias("loss"),
    )
    named = F.transform("attachments", lambda a: F.struct(*(a[k].alias(k) for k in ("kind", "ref", "place", "turn_place", "tokens"))))
    return convs.select("conv_id", "n_turns", "formatted", named.alias("attachments"), "expanded_tokens", "loss")


def read_back(formatted: DataFrame) -> DataFrame:
    """The digest of a formatted column, from the string and the loss spans alone: n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars. Placeholders stay as they are in a turn's text."""
    cut = formatted.select("conv_id", "formatted", "loss", F.filter(F.split("formatted", r"<\|end\|>\n", -1), lambda t: t != "").alias("turns"))
    role = lambda t: unescape_role(F.substr(F.substring_index(t, "\n", 1), F.lit(len(START) + 1)))
    text = lambda t: unescape(F.substr(t, F.length(F.substring_index(t, "\n", 1)) + 2))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(role(t), F.lit("\n"), text(t), F.lit("\n"))), "")
    # A span is cut out of its own turn, found by place, and not out of the whole string.
    masked = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.element_at(F.col("turns"), s["turn_place"] + 1), s["at"].cast("int") + 1, s["chars"].cast("int")))), "")
    read = cut.select("conv_id", F.size("turns").cast("long").alias("n_turns"), whole.alias("whole"), masked.alias("masked"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", F.sha2(F.col("whole").cast("binary"), 256).alias("turns_sha256"), F.length("masked").cast("long").alias("loss_chars"), F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


#: The read-back digest as SQL over the input rows.
ORACLE = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, 17 + length(replace(regexp_replace(regexp_replace(replace(role, '\', '\\'), '([<\[])(\||/?s>|/?INST\])', '\1' || chr(1) || '\2', 'g'), chr(10), '__', 'g'), chr(1), '_')) + length(regexp_replace(replace(text, '\', '\\'), '([<\[])(\||/?s>|/?INST\])', '\1_\2', 'g')) as wide from t)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(case when role = 'assistant' then length(text) end), 0)::bigint as loss_chars, sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256, sum(wide)::bigint as formatted_chars
from e group by conv_id
"""
