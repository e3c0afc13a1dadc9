import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftwright.llm import language_mix as L

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def plain_mixture(text, table):
    """The same model in plain Python: EM to the end over all languages, then every k by proportion, each to its end."""
    grams, word, _ = L.trigrams([text])
    n = table.shape[1]
    words = {}
    for g, w in zip(grams.tolist(), word.tolist(), strict=True):
        s = words.setdefault(w, [0.0] * n)
        for j in range(n):
            s[j] += float(table[g, j])
    like = [[math.exp(x - max(s)) for x in s] for s in words.values()]

    def em(pi):
        for _ in range(3000):
            new = [0.0] * n
            for p in like:
                total = sum(a * b for a, b in zip(p, pi, strict=True))
                for j in range(n):
                    new[j] += pi[j] * p[j] / total / len(like)
            if max(abs(a - b) for a, b in zip(pi, new, strict=True)) < 1e-9:
                break
            pi = new
        return pi, sum(math.log(sum(a * b for a, b in zip(p, pi, strict=True))) for p in like)

    full, _ = em([1 / n] * n)
    order = sorted(range(n), key=lambda j: -full[j])
    best = None
    for k in range(1, n + 1):
        pi, fit = em([1 / k if j in order[:k] else 0.0 for j in range(n)])
        worth = fit - 0.5 * (2 * k - 1) * math.log(len(like) + 1)
        if best is None or worth > best[0]:
            best = (worth, pi)
    return best[1]


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, table = L.fit(docs)
    texts = {x: [r.text for r in docs.where((F.col("lang") == x) & (F.length("text") > 1500)).orderBy("doc_id").limit(6).collect()] for x in langs}
    return langs, table, texts


def test_mixtures_equal_the_plain_model(learned):
    langs, table, texts = learned
    rng, cases = random.Random(5), []
    for i in range(24):
        parts = rng.sample(langs, rng.choice([1, 2, 3, 4]))
        cases.append("\n".join(rng.choice(texts[x])[: rng.choice([60, 300, 700])] for x in parts) + f"\nnr {i}")
    share, has = L.mixtures(cases, table)
    assert has.all()
    for got, case in zip(share, cases, strict=True):
        want = plain_mixture(case, table)
        assert np.flatnonzero(got > 0.01).tolist() == [j for j, x in enumerate(want) if x > 0.01]
        assert got == pytest.approx(np.array(want), abs=0.03)


def test_four_languages_are_found(learned):
    langs, table, texts = learned
    share, _ = L.mixtures(["\n".join(t[0][:1000] for t in texts.values())], table)
    assert len(langs) == 4 and (share[0] > 0.15).all()


def test_letters_of_all_planes(spark):
    gothic = lambda seed: " ".join("".join(chr(0x10330 + random.Random(seed * 97 + i * 7 + j).randrange(20)) for j in range(5)) for i in range(30))
    rows = [(i, gothic(i), "got", "s", 1) for i in range(20)] + [(100 + i, "plain words of another language here", "en", "s", 1) for i in range(20)]
    rows += [(200, gothic(99), None, "s", 1), (201, "\U00020000\U00020001", None, "s", 1), (202, "\U0001F600 12", None, "s", 1)]
    found = {r.doc_id: r for r in L.language_mixture(spark.createDataFrame(rows, DOC)).collect()}
    assert found[200].lang_pred == "got" and found[201].lang_pred in ("got", "en") and found[202].lang_pred == "und"


def test_a_hot_text_does_not_fill_the_draw(spark):
    hot = [(i, "always the same words in this one text", "en", "s", 1) for i in range(4000)]
    others = [(10_000 + i, f"another text number{i} about gardens and rivers", "en", "s", 1) for i in range(500)]
    langs, table = L.fit(spark.createDataFrame(hot + others, DOC))
    single, one = L.fit(spark.createDataFrame(hot[:1] + others, DOC))
    assert langs == single == ["en"] and np.allclose(table, one, atol=0.05)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, "words", None, "s", 5), (1, "words", None, "s", 5), (None, "", "en", "s", 0)]])
def test_nothing_to_learn(spark, rows):
    got = L.language_mixture(spark.createDataFrame(rows, DOC)).collect()
    assert len(got) == len(rows) and all(r.lang_pred == "und" and r.score == 0 and not r.proportions for r in got)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(i, "plain words in a row here", "en", "s", 25) for i in range(9)] + [(50, "  ", "en", "s", 2), (51, None, "en", "s", None)], DOC)
    for name in ("score", "lettered", "proportions", "lang_pred", "row", "held_out", "unit", "n", "k0"):
        docs = docs.withColumn(name, F.lit("clash"))
    got = L.language_mixture(docs).collect()
    assert len(got) == 11 and sum(r.lang_pred == "en" for r in got) == 9
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == 9 and {r.score for r in kept.collect()} == {"clash"}
