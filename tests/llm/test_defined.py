"""Defined results of the row-wise operators: nulls, empty tables, repeats, ties, long texts, clashing names."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftwright.llm import chat_format, line_dedup, mix_sources, telephony

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def clashing(docs, *names):
    for name in names:
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


def test_resampling_equals_the_plain_filter():
    taps, rng = telephony.filter_taps().tolist(), np.random.default_rng(4)
    assert 2 * sum(taps) == 1 << telephony.POINT
    for n in (1, 2, 7, 64, 501):
        x = rng.integers(-32768, 32768, n).astype(np.int16)
        at = lambda i: int(x[min(max(i, 0), n - 1)])  # noqa: E731, B023
        want = []
        for i in range(n):
            total = sum(t * (at(i - j) + at(i + 1 + j)) for j, t in enumerate(taps))
            want += [int(x[i]), max(-32768, min(32767, (total + (1 << telephony.POINT - 1)) >> telephony.POINT))]
        assert telephony.resample(x).tolist() == want
    tone = np.round(12000 * np.sin(np.arange(400) * 2 * np.pi * 1000 / 8000)).astype(np.int16)
    true = 12000 * np.sin(np.arange(800) * 2 * np.pi * 1000 / 16000)
    assert np.abs(telephony.resample(tone)[40:-40] - true[40:-40]).max() < 60


def test_media_columns_are_stored_and_read(spark, tmp_path):
    texts = [None, "", "a" * 64, "b" * 65, "tone " * 60_000, "same", "same"]
    docs = clashing(spark.createDataFrame([(None if i == 3 else i, t) for i, t in enumerate(texts)], "doc_id long, text string"), "media", "pcm", "n_bytes", "feature")
    telephony.encode(docs).write.parquet(f"{tmp_path}/media")
    telephony.read(spark.read.parquet(f"{tmp_path}/media"), with_media=True).write.parquet(f"{tmp_path}/pcm")
    rows = spark.read.parquet(f"{tmp_path}/pcm").collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[3 if r.doc_id is None else r.doc_id] or "").encode()
        want = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        coding, _, payload = telephony.unwrap(bytes(r.media))
        assert payload == want and (r.n_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        kind, rate, pcm = telephony.unwrap(bytes(r.pcm))
        assert (kind, rate) == (telephony.PCM, 16000) and pcm == telephony.resample(telephony.decode([coding], [want])[0]).tobytes()
        assert r.feature.endswith(hashlib.sha256(pcm).hexdigest()[:16])
    same = [r for r in rows if r.doc_id in (5, 6)]
    assert same[0].feature == same[1].feature and same[0].media == same[1].media
    assert telephony.store(docs.where("false")).count() == 0
    with pytest.raises(ValueError, match="RIFF"):
        telephony.unwrap(b"no such file")


def part(kind, text=None, ref=None, tokens=None):
    return (kind, text, ref, tokens)


def test_chat_defined_results(spark):
    schema = f"conv_id long, turn long, role string, parts array<{chat_format.PART}>"
    rows = [(None, 0, "user", [part("text", "lost")]), (1, None, None, None), (1, 0, "assistant", []), (1, 0, "assistant", []), (1, 1, "assistant", [part(None, None), part("video", "x"), part("image", ref="a", tokens=None)])]
    messages = clashing(spark.createDataFrame(rows, schema), "formatted", "loss", "turns", "place", "n_turns", "begin")
    got = {r.conv_id: r for r in chat_format.format_conversations(messages).collect()}
    assert set(got) == {None, 1} and got[None].formatted == "<|turn|>user\nlost<|end|>\n"
    assert got[1].formatted == "<|turn|>\n<|end|>\n" + 2 * "<|turn|>assistant\n<|end|>\n" + "<|turn|>assistant\n<|image:0|><|end|>\n"
    assert got[1].n_turns == 4 and [tuple(s) for s in got[1].loss] == [(1, 18, 35, 0), (2, 18, 61, 0), (3, 18, 87, 11)] and got[1].expanded_tokens == 0
    assert chat_format.read_back(chat_format.format_conversations(messages.where("false"))).count() == 0


def test_a_long_conversation_and_many_parts(spark):
    rng = random.Random(7)
    rows = [(1, t, ("user", "assistant")[t % 2], [part("text", f"{t} <|end|> \\ é"), *(part("audio", ref=f"{t}.{i}", tokens=2) for i in range(rng.randrange(3)))]) for t in range(3000)]
    rng.shuffle(rows)
    messages = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    r = chat_format.format_conversations(messages).first()
    refs = [p[2] for _, _, _, parts in sorted(rows) for p in parts[1:]]
    assert [a.ref for a in r.attachments] == refs and [a.place for a in r.attachments] == list(range(len(refs)))
    for t, span in zip(range(1, 3000, 2), r.loss, strict=True):
        assert span.turn_place == t and r.formatted[span["from"] :].startswith(f"{t} <\\|end|> \\\\ é")
        assert r.formatted[span["from"] + span.chars :].startswith("<|end|>\n")
    back = chat_format.read_back(chat_format.format_conversations(messages)).first()
    assert back.n_turns == 3000 and back.formatted_chars == len(r.formatted)


def test_lines_with_clashing_names_and_repeats(spark):
    long = "\n".join(f"line {i}" for i in range(30_000))
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc"), (2, "x\na\nb\nc"), (None, "b\nc\nd"), (3, None), (4, ""), (5, long), (6, long + "\nend"), (7, "q\nq\nq\nq")]
    docs = clashing(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC), "__gone", "gone", "mark", "key", "lines", "stay", "n_lines", "n_removed", "c0")
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*(c for c in docs.columns if c not in ("n_lines", "n_removed")), "n_lines", "n_removed"]
    texts = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=str)
    want = [(1, "a\nb\nc\nd", 4, 0), (2, "x", 4, 3), (2, "x", 4, 3), (None, "", 3, 3), (3, None, 0, 0), (4, "", 1, 0), (5, long, 30_000, 0), (6, "end", 30_001, 30_000), (7, "q", 4, 3)]
    assert texts == sorted(want, key=str)
    kept = corpus_pipeline.dedup_lines(spark, docs, "")
    assert kept.columns == docs.columns and {r.n_lines for r in kept.collect()} == {"clash"} and None not in {r.doc_id for r in kept.collect()}
    assert line_dedup.dedup_lines(docs.where("false")).count() == 0 == corpus_pipeline.dedup_lines(spark, docs.where("false"), "").count()


def test_mix_with_clashing_names(spark):
    docs = clashing(spark.createDataFrame([(i, "two words" * (i % 3), "en", ("a", "b", None)[i % 3], 1) for i in range(40)] + [(1, "two words", "en", "a", 1)] * 2, DOC), "size", "target", "taken", "source_size", "rank", "src", "step", "n")
    assert mix_sources.mix(docs).count() == 42
