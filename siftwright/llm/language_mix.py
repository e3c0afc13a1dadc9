"""Operator 5: which languages a document mixes, and in which proportions.

Method: every language has a smoothed distribution over hashed character trigrams of words (word edges count as a
character). A word's likelihood under a language is the product over its trigrams. For each document, expectation
maximisation over its words estimates the proportions of the languages, until no proportions could be likelier by
more than GAP; sets of one, two, ... languages, taken by proportion, are then compared by log-likelihood less a
penalty for each language (as the BIC does), and the best set's proportions are the result. A set is as large as the
penalty lets it be: a document is done once even the likelihood of all languages can't pay for one language more.
All documents of a batch are iterated together in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

BUCKETS = 1 << 15
#: The model is fitted on about so many different labelled texts of each language, drawn by a hash of the text.
SAMPLE_PER_LANG = 2000
#: Expectation maximisation ends when the log-likelihood is within GAP of the greatest, or after so many rounds.
GAP, MOST_ROUNDS = 0.5, 200
_SPAN = 0x10000
_LETTERS: np.ndarray | None = None


def _lower(point: int) -> int:
    """The lower-case letter of a code point, or 0 where it is no letter."""
    c = chr(point)
    low = c.lower()
    return 0 if not c.isalpha() else ord(low) if len(low) == 1 else point


def letters_of(points: np.ndarray) -> np.ndarray:
    """Code points -> lower-case letters, or 0; the table of the basic plane is built once a process, others are looked up."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((_lower(i) for i in range(_SPAN)), np.uint32, _SPAN)
    out = _LETTERS[np.minimum(points, _SPAN - 1)]
    if len(high := np.flatnonzero(points >= _SPAN)):
        different, at = np.unique(points[high], return_inverse=True)
        out[high] = np.fromiter((_lower(int(i)) for i in different), np.uint32, len(different))[at]
    return out


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of all words, the word each belongs to, and the text of each word."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = letters_of(points)
    at = np.flatnonzero(letters)
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    before = np.where(at > 0, letters[at - 1], 0)
    after = letters[np.minimum(at + 1, len(letters) - 1)]
    code = (before * np.uint32(0x9E3779B1)) ^ (letters[at] * np.uint32(0x85EBCA77)) ^ (after * np.uint32(0xC2B2AE3D))
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    grams = ((code ^ (code >> np.uint32(13))) & np.uint32(BUCKETS - 1)).astype(np.int64)
    first = before == 0
    word = np.cumsum(first) - 1
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return grams, word, np.searchsorted(ends, at[first], side="right")


class _Words:
    """The likelihoods of the words of some texts, and one round of expectation maximisation over all of them."""

    def __init__(self, like: np.ndarray, counts: np.ndarray) -> None:
        self.like, self.counts = like, counts
        self.of = np.repeat(np.arange(len(counts)), counts)
        self.bounds = np.cumsum(counts) - counts

    def some(self, keep: np.ndarray) -> _Words:
        return _Words(self.like[keep[self.of]], self.counts[keep])

    def step(self, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next proportions, the log-likelihood of pi, and how much greater that of any proportions of its languages can be."""
        total = np.einsum("ij,ij->i", self.like, pi[self.of])
        pull = np.add.reduceat(self.like / total[:, None], self.bounds, axis=0) / self.counts[:, None]
        gap = self.counts * (np.where(pi > 0, pull, 0.0).max(axis=1) - 1)
        return pi * pull, np.add.reduceat(np.log(total), self.bounds), np.maximum(gap, 0.0)

    def settle(self, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rounds until each text is within GAP: the proportions, their log-likelihood and the gap that is left."""
        out, fit, left = pi.copy(), np.zeros(len(pi)), np.zeros(len(pi))
        own, at = self, np.arange(len(pi))
        for rounds in range(MOST_ROUNDS):
            new, value, gap = own.step(pi)
            out[at], fit[at], left[at] = pi, value, gap
            open_ = gap > GAP
            if not open_.any() or rounds == MOST_ROUNDS - 1:
                break
            if open_.mean() < 0.7:
                own, at, new = own.some(open_), at[open_], new[open_]
            pi = new / new.sum(axis=1, keepdims=True)
        return out, fit, left


def mixtures(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts x languages) over the selected languages, and which texts have words."""
    n_langs = table.shape[1]
    share = np.zeros((len(texts), n_langs))
    grams, word, text = trigrams(texts)
    if not len(grams):
        return share, np.zeros(len(texts), bool)
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    score = np.add.reduceat(table[grams], starts, axis=0).astype(np.float64)
    # A floor under a word's likelihoods keeps every language possible, so that no total is 0.
    like = np.exp(np.maximum(score - score.max(axis=1, keepdims=True), -300.0))
    counts = np.bincount(text, minlength=len(texts))
    has = counts > 0
    rows = np.flatnonzero(has)
    words = _Words(like, counts[rows])
    pi, most, slack = words.settle(np.full((len(rows), n_langs), 1.0 / n_langs))
    order = np.argsort(-pi, axis=1, kind="stable")
    price = 0.5 * np.log(counts[rows] + 1)
    chosen = np.zeros_like(pi)
    worth = np.full(len(rows), -np.inf)
    for k in range(1, n_langs + 1):
        todo = most + slack - (2 * k - 1) * price > worth
        if not todo.any():
            break
        own = np.zeros((int(todo.sum()), n_langs))
        top = order[todo, :k]
        np.put_along_axis(own, top, np.maximum(np.take_along_axis(pi[todo], top, axis=1), 1e-6), axis=1)
        own /= own.sum(axis=1, keepdims=True)
        part = words.some(todo)
        if k > 1:
            own, fit, _ = part.settle(own)
        else:
            _, fit, _ = part.step(own)
        value = fit - (2 * k - 1) * price[todo]
        at = np.flatnonzero(todo)[better := value > worth[todo]]
        chosen[at], worth[at] = own[better], value[better]
    chosen[chosen < 1e-6] = 0
    share[rows] = chosen / chosen.sum(axis=1, keepdims=True)
    return share, has


def fit(train: DataFrame) -> tuple[list[str], np.ndarray]:
    """train (text, lang) -> the languages and the table of log-probabilities (buckets x languages).

    One row for each language comes to the driver, then goes back as a literal map of sampling rates: no join, so no text
    is moved by its language. Copies of a drawn text count once, whatever their number.
    """
    train = train.select(F.col("text"), F.col("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.approx_count_distinct("text").alias("n")).toLocalIterator()}
    if not sizes:
        return [], np.zeros((BUCKETS, 0), np.float32)
    unit = F.xxhash64("text", F.lit(17)).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    rate = F.element_at(F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, SAMPLE_PER_LANG / max(1, n)))), F.col("lang"))
    drawn = train.where(unit < rate).distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                for i in range(0, len(own), 64):
                    grams, _, _ = trigrams(own[i : i + 64])
                    found[lang] = found.get(lang, 0) + np.bincount(grams, minlength=BUCKETS)
        for lang, counts in found.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "gram": at, "n": counts[at]})

    total = drawn.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(total["lang"].unique())
    table = np.full((BUCKETS, len(langs)), 0.2)
    for j, lang in enumerate(langs):
        own = total[total["lang"] == lang]
        table[own["gram"].to_numpy(), j] += own["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=0, keepdims=True)).astype(np.float32)


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """row (a struct of the columns `keep`), lang_pred, score, proportions map: the language of the largest proportion,
    or `und` (score 0) for no letter. The struct keeps names of docs apart from those of the result."""
    names = [f"k{i}" for i in range(len(keep))]
    text = names[keep.index("text")] if "text" in keep else "text"
    given = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, names, strict=True)), *(() if "text" in keep else (F.col("text"),)))
    schema = ", ".join(f"{k} {given.schema[k].dataType.simpleString()}" for k in names) + ", lang_pred string, score double, proportions map<string,double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in W.chunks(batch, text):
                texts = [t or "" for t in part.column(text).to_pylist()]
                if langs:
                    share, has = mixtures(texts, table)
                else:
                    share, has = np.zeros((len(texts), 0)), np.zeros(len(texts), bool)
                top = share.argmax(axis=1) if langs else np.zeros(len(texts), int)
                found = [langs[t] if h else "und" for t, h in zip(top, has, strict=True)]
                score = np.where(has, share.max(axis=1) if langs else 0.0, 0.0)
                maps = [[(langs[j], float(s[j])) for j in np.flatnonzero(s)] if h else [] for s, h in zip(share, has, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in names), pa.array(found, pa.string()), pa.array(np.minimum(score, 1.0)), pa.array(maps, pa.map_(pa.string(), pa.float64()))], names=[*names, "lang_pred", "score", "proportions"])

    return given.mapInArrow(run, schema).select(F.struct(*(F.col(k).alias(c) for k, c in zip(names, keep, strict=True))).alias("row"), "lang_pred", "score", "proportions")


def held_out():
    """Whether a document's labels are kept from training: crc32 of its id as text leaves 0 modulo 5."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def language_mixture(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, more) -> doc_id, held_out, lang_pred, score, proportions.

    Learns from the rows that are not held out and have a text and a lang. A null text, or one without a letter (of any
    plane), is `und` with score 0; so is every text when nothing can be learned. Repeated rows come back repeated; ties
    go to the language first by name. A very long text is one document like any other: its words are held in one task.
    Other columns, whatever their names, are ignored; a null doc_id counts as the empty text for held_out. An empty
    table gives an empty result.
    """
    langs, table = fit(docs.where(~held_out()))
    found = predict(docs, langs, table).select(F.col("row.doc_id").alias("doc_id"), "lang_pred", "score", "proportions")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "proportions")
