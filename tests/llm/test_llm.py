import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftwright.llm import chat_format, decontaminate, jaccard_join, language_mix, license_scan, line_dedup, mix_sources, registry, telephony, toxicity, url_filter
from siftwright.llm import words as W

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t", "en", "s", 3), (4, "one two", "en", None, 7), (5, "one two", None, "s", 7), (None, "three four five six seven eight", "en", "s", 1), (6, "$$$ 12", "en", "s", 6), (7, "word " * 60_000, "en", "s", 300_000)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOC).withColumn("size", F.lit("clash")).withColumn("score", F.lit("clash"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets, up = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_join_equals_brute_force(spark):
    rng = random.Random(6)
    rows, words = [], [f"w{i}" for i in range(400)]
    common = [rng.choice(words) for _ in range(40)]
    for g in range(12):
        base = common + [rng.choice(words) for _ in range(rng.choice([4, 9, 30, 120, 700]))]
        for _ in range(14):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((len(rows), " ".join(t)))
    rows += [(1000, "a b c d e f g h"), (1001, "a b c d e f g h i"), (1002, "a b"), (1003, "A  b"), (1004, ""), (1005, None), (1006, "a b c d e f g h")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_signatures_of_similar_sets_meet():
    rng = np.random.default_rng(1)
    for _ in range(400):
        n = int(rng.integers(4, 120))
        x = rng.integers(0, 2**63, n, dtype=np.uint64)
        y = x.copy()
        k = int(rng.integers(0, max(1, n // 8)))
        y[:k] = rng.integers(0, 2**63, k, dtype=np.uint64)
        x, y = np.unique(x), np.unique(y)
        both = len(np.intersect1d(x, y))
        if 100 * both < 80 * (len(x) + len(y) - both):
            continue
        often = lambda u: (u % np.uint64(5)) < np.uint64(4)  # noqa: E731, B023
        assert len(np.intersect1d(jaccard_join.signatures(x, often(x)), jaccard_join.signatures(y, often(y))))


def test_words_equal_the_pattern():
    texts = ["", "a", " A\tb\nc", "x\x0bY\x0cz\rw", "é É", "a\u00a0b c"]
    import pyarrow as pa

    for part, data, offsets in W.chunks(pa.RecordBatch.from_pydict({"text": pa.array([*texts, None])})):
        hashes, rows, start, end = W.words(data, offsets)
        got = [[data[a:b].tobytes().decode() for r, a, b in zip(rows, start, end, strict=True) if r == i] for i in range(part.num_rows)]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts] + [[]]
    assert hashes[0] == hashes[1]  # a and A


def test_mix_hits_its_targets(spark):
    rows = mix_sources.mix(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    by = {}
    for r in rows:
        t = by.setdefault(r.source, [0, r.target, r.source_size])
        t[0] += r.taken
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    assert sum(t for _, t, _ in by.values()) == pytest.approx(sum(s for _, _, s in by.values()))
    assert all(t <= 3 * s + 1e-6 for _, t, s in by.values())
    off = sum(abs(a - t) for a, t, _ in by.values()) / sum(t for _, t, _ in by.values())
    assert off < 0.1


def test_mix_edges(spark, edge, empty):
    got = {r.doc_id: r for r in mix_sources.mix(edge).collect()}
    assert len(got) == len(EDGE) and got[1].size == 0 and got[7].size == 60_000 and got[2].taken == 0
    assert mix_sources.mix(empty).count() == 0


def test_targets_reshare_the_excess(spark):
    sizes = {"a": 10, "b": 1000, "c": 20, "d": 5, None: 400}
    got = {r.source: r.target for r in mix_sources.source_targets(spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "source string, source_size long, n long")).collect()}
    weight = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}
    want, left, open_ = {}, sum(sizes.values()), set(sizes)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            want |= share
            break
        want |= {s: 3 * sizes[s] for s in over}
        left, open_ = left - sum(3 * sizes[s] for s in over), open_ - over
    assert got == pytest.approx(want)


def brute_lines(rows):
    first, out = {}, {}
    for i, t in sorted(rows):
        lines = t.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            if first.setdefault(tuple(lines[p : p + 3]), (i, p)) != (i, p):
                gone |= {p, p + 1, p + 2}
        out[i] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12)))) for i in range(60)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == brute_lines(rows)
    assert all(r.n_lines - r.n_removed == (len(r.text.split("\n")) if r.text or r.n_removed < r.n_lines else 0) for r in got)


def test_line_dedup_edges(edge, empty):
    got = {r.doc_id: r for r in line_dedup.dedup_lines(edge).collect()}
    assert got[1].text is None and got[1].n_lines == 0 and got[2].text == "" and len(got) == len(EDGE)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_telephony_round_trip(spark):
    texts = [None, "", "a" * 64, "b" * 65, "é" * 500, "x", "tone " * 3000]
    rows = telephony.store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_media=True).collect()
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        want = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert telephony.unwrap(bytes(r.media))[2] == want
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(want), hashlib.sha256(want).hexdigest())
        assert r.tail_crc32 == zlib.crc32(want[-64:]) and r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
        coding, rate, pcm = telephony.unwrap(bytes(r.pcm))
        assert (coding, rate) == (1, 16000) and len(pcm) > 0
    assert {telephony.unwrap(bytes(r.media))[0] for r in rows} <= set(telephony.CODINGS)


def test_adpcm_equals_the_serial_decoder():
    rng = np.random.default_rng(3)
    blocks = rng.integers(0, 256, (9, 64), dtype=np.uint8)
    want = []
    for b in blocks:
        level, index = int(np.array(b[:2]).view("<i2")[0]), min(int(b[2]), 88)
        out = [level]
        for byte in b[4:]:
            for code in (int(byte) & 15, int(byte) >> 4):
                step = telephony.STEPS[index]
                move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                level = max(-32768, min(32767, level - move if code & 8 else level + move))
                index = max(0, min(88, index + telephony.INDEX_MOVES[code & 7]))
                out.append(level)
        want.append(out)
    assert telephony.decode_adpcm(blocks).tolist() == want


def test_law_tables():
    mu, a = telephony.mu_law_table(), telephony.a_law_table()
    assert (mu[0], mu[0x80], mu[0xFF], mu[0x7F]) == (-32124, 32124, 0, 0)
    assert (a[0x2A], a[0xAA], a[0xD5], a[0x55]) == (-32256, 32256, 8, -8)


def test_language_accuracy_and_edges(spark, edge, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_mix.language_mixture(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)
    found = {r.doc_id: r for r in language_mix.language_mixture(edge).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (1, 2, 3, 6)) and len(found) == len(EDGE)
    assert language_mix.language_mixture(empty).count() == 0


def test_mixture_proportions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, table = language_mix.fit(docs)
    one = {r.lang: r.text for r in docs.where("lang in ('en', 'es') and length(text) > 3000").collect()}
    share, _ = language_mix.mixtures([one["en"][:2000] + "\n" + one["es"][:2000], one["en"][:2000]], table)
    en, es = langs.index("en"), langs.index("es")
    assert 0.3 < share[0, en] < 0.7 and 0.3 < share[0, es] < 0.7 and share[1, en] > 0.95


def test_toxicity_held_out(spark, edge, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.toxic == 1 and r.predicted == 1 for r in got)
    assert hit >= 0.6 * sum(r.toxic == 1 for r in got) and hit >= 0.85 * sum(r.predicted for r in got)
    found = toxicity.toxicity(edge, spark.createDataFrame([(4, 1), (4, 0), (99, 1), (5, None)], "doc_id long, toxic int")).collect()
    assert len(found) == len(EDGE) and all(0 <= r.score <= 1 for r in found)
    assert toxicity.toxicity(empty, labels).count() == 0


def test_leaks_equal_brute_force(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    clean = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    texts = [(r.doc_id, clean(r.text)) for r in docs.collect()]
    held = set()
    for item in items.collect():
        words = clean(item.text)
        ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
        a = [ids[w] for w in words]
        for doc, t in texts:
            b = [ids.get(w, -1) for w in t]
            step = 2 * len(words)
            for at in range(0, max(1, len(b)), step // 2):
                part = [x for x in b[at : at + step] if x >= 0]
                if len(part) >= 0.7 * len(a) and decontaminate.lcs(a, part) >= 0.7 * len(a):
                    held.add((doc, item.item_id))
    assert len(got & held) >= 0.9 * len(held) and len(got - held) <= 0.1 * len(got) + 1


def test_paraphrases_are_found(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    rng, rows = random.Random(9), []
    for r in items.collect():
        w = r.text.split()
        for i in rng.sample(range(len(w)), len(w) // 8):
            w[i] = "paraphrased"
        rows.append((10_000 + r.item_id, "lead words here " * 8 + " ".join(w) + " and an end" * 9))
    planted = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(planted, items).collect()}
    assert sum((i, i - 10_000) in got for i, _ in rows) >= 0.9 * len(rows)


def test_leak_edges(spark, edge, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "three four five six seven eight")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(edge, items).collect()} == {(None, 3)}
    assert decontaminate.leaks(empty, items).count() == 0
    assert decontaminate.leaks(edge, items.where("false")).count() == 0


def test_passage_in_a_third_of_the_documents(spark):
    item = "the cat sat by a door and then it went to look for some food in that old house near our river"
    rows = [(i, f"w{i} x{i % 7} y{i % 11} " * 20 + (item if i % 3 == 0 else f"z{i} " * 5)) for i in range(300)]
    items = spark.createDataFrame([(1, item), (2, "quite another passage with its own words for the same corpus here")], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()} == {(i, 1) for i in range(0, 300, 3)}
    assert {r.doc_id for r in decontaminate.without_leaks(docs, items).collect()} == {i for i in range(300) if i % 3}


def _stretches(spark, size, n, seed):
    """Stretches of so many words of n documents of sf0.1, and where they come from."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text is not null").select("doc_id", "text")
    rng, out = random.Random(seed), []
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        w = r.text.split()
        if len(w) >= size + 100 and len(out) < n:
            at = rng.randrange(len(w) - size)
            out.append((r.doc_id, w[at : at + size]))
    return out


def test_long_items_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    own = [x for size in (65, 200, 300, 500) for x in _stretches(spark, size, 10, size)]
    items = spark.createDataFrame([(i, " ".join(w)) for i, (_, w) in enumerate(own)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.lcs_ratio for r in decontaminate.leaks(docs.where(F.col("doc_id").isin([d for d, _ in own]) | (F.col("doc_id") % 10 == 0)), items).collect()}
    assert all(got.get((d, i)) == 1.0 for i, (d, _) in enumerate(own))


def test_benchmark_larger_than_the_rank(spark):
    rng, found = random.Random(5), _stretches(spark, 38, 1000, 5)
    items = spark.createDataFrame([(i, " ".join(w)) for i, (_, w) in enumerate(found)], "item_id long, text string")
    clean = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    rows, sure = [], set()
    for i, (_, w) in enumerate(found):
        changed = list(w)
        for j in rng.sample(range(len(w)), len(w) // 4):
            changed[j] = "changed"
        other = found[(i + 1) % len(found)][1] + found[(i + 2) % len(found)][1]
        ids = {x: k for k, x in enumerate(dict.fromkeys(clean(" ".join(w))))}
        a, b = ([ids.get(x, -1) for x in clean(" ".join(t))] for t in (w, changed))
        if decontaminate.lcs(a, b) >= 0.7 * len(a):
            sure.add(i)
        rows += [(i, " ".join(other + w + other)), (10_000 + i, " ".join(other + changed + other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    assert all((i, i) in got for i in range(len(found)))
    assert len(sure) > 0.9 * len(found) and all((10_000 + i, i) in got for i in sure)


def test_chat_reads_back(spark):
    said = ["", "\\", "<|end|>\n", "<\\|", "</s>[INST] ok [/INST]", "[\\INST]", "\\\\<s>", "a\nb", "<|turn|>user\n", None]
    rows = [(i, t, role, text) for i, text in enumerate(said) for t, role in enumerate(("user", "assistant", "we\\ird\nrole <s>", None))]
    part = F.struct(F.lit("text").alias("kind"), F.col("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens"))
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", F.array(part).alias("parts"))
    for r in chat_format.read_back(chat_format.format_conversations(messages)).collect():
        own = [(role or "", text or "") for i, _, role, text in rows if i == r.conv_id]
        assert r.n_turns == 4 and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(own[1][1].encode()).hexdigest() and r.loss_chars == len(own[1][1])


def test_chat_parts(spark):
    parts = [("text", "see ", None, None), ("image", None, "a.png", 576), ("text", " and", None, None), ("audio", None, "b.wav", 100)]
    messages = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("document", None, "c.pdf", 9), (None, "fine", None, None)]), (1, 2, "user", None)], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    r = chat_format.format_conversations(messages).first()
    assert "see <|image:0|> and<|audio:1|><|end|>" in r.formatted and "<|document:2|>fine" in r.formatted
    assert [(a.ref, a.place, a.turn_place, a.tokens) for a in r.attachments] == [("a.png", 0, 0, 576), ("b.wav", 1, 0, 100), ("c.pdf", 2, 1, 9)]
    assert r.expanded_tokens == 685 + 3


def test_url_rules(spark):
    urls = [None, "nothing", "http://A.Example.com/en/7x?q", "https://x.com/en/1#f", "ftp://com/en/", "http://com/en", "http://example.net/de/8", "http://b.example.net/de/9", "http://notexample.net/de/8", "x://y://z/", "http://org/es/", "http://h?a/b"]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_filter.RULES).collect()}
    assert [(got[i].host, got[i].path) for i in (0, 1, 2, 9, 11)] == [("", ""), ("", ""), ("a.example.com", "/en/7x"), ("y:", "//z/"), ("h", "")]
    assert [got[i].rule for i in range(2, 12)] == ["example.com/en/7", "com/en/", "com/en/", None, "example.net/de/8", "net/de/", "net/de/", None, "org/es/", None]
    assert [got[i].verdict for i in (2, 3, 6, 7)] == ["allow", "block", "block", "allow"] and all(r.verdict in ("allow", "block") for r in got.values())
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string"), url_filter.RULES).count() == 0


def test_isc_is_whole(spark):
    text = license_scan.TEMPLATES["ISC"].partition("IN NO EVENT")[0] + (
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    )
    (r,) = license_scan.scan(spark.createDataFrame([(1, text + " And more.")], "doc_id long, text string")).collect()
    assert (r.license, r.coverage, r.first_byte) == ("ISC", 1.0, 0) and text[: r.end_byte].endswith("THIS SOFTWARE")


def test_changed_notices_are_found(spark):
    rows = []
    for name, text in license_scan.TEMPLATES.items():
        words = text.split()
        for i in range(len(words)) if name.endswith("-notice") else ():
            rows.append((len(rows), "Some words. " + " ".join([*words[:i], "changed", *words[i + 1 :]]) + " And an end.", name))
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, name string")).collect()}
    # A notice whose telling word is changed may as well be another one's copy: then that one matches as many words.
    own = {n: re.findall(r"[0-9a-z]+", t.lower()) for n, t in license_scan.TEMPLATES.items()}
    sure = [(i, n, decontaminate.lcs(own[n], re.findall(r"[0-9a-z]+", t.lower()))) for i, t, n in rows]
    sure = [(i, n, m) for i, n, m in sure if m >= license_scan.COVERAGE * len(own[n])]
    assert len(sure) > 0.9 * len(rows) and all(i in got and got[i].matched >= m for i, n, m in sure)
    assert sum(got[i].license == n for i, n, _ in sure) > 0.8 * len(sure)


def test_license_scan(spark, edge, empty):
    mit = license_scan.TEMPLATES["MIT"]
    broken = " ".join(w for i, w in enumerate(mit.split()) if i % 17)
    rows = [(1, "junk words " * 30 + mit + " more" * 20), (2, broken), (3, "Some text.\nReleased under the MIT License.\nEnd. Released under the MIT license!"), (4, "permission is hereby something else"), (5, "licensed under")]
    got = {}
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault((r.doc_id, r.license), []).append(r)
    assert {k for k in got} == {(1, "MIT"), (2, "MIT"), (3, "MIT-notice")}
    assert got[1, "MIT"][0].coverage == 1.0 and got[1, "MIT"][0].first_word == 60 and len(got[3, "MIT-notice"]) == 2
    assert rows[2][1].encode()[got[3, "MIT-notice"][0].first_byte : got[3, "MIT-notice"][0].end_byte].startswith(b"Released under the MIT License")
    assert license_scan.scan(edge).count() == 0 and license_scan.scan(empty).count() == 0


def test_join_edges(edge, empty):
    got = {r.doc_id: r for r in jaccard_join.jaccard_components(edge).collect()}
    assert got[1].n_shingles == 0 and got[4].component_id == got[5].component_id == 4 and got[None].component_id is None and got[7].n_shingles == 1
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_pipeline_stages(spark, empty, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.toPandas(), DOC) if docs.count() else empty
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * sizes[0]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert all(c == i for i, (n, c) in brute_components(rows).items())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == sizes[-1]


def test_every_operator_is_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES} == set(range(1, 11))
