"""Operator 8: toxicity scores learned from confirmed toxic documents and unlabelled text.

Method: non-negative positive-unlabelled learning. A numpy logistic model over hashed words (each word of a text once)
minimises  prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)),  with the logistic loss; when the second part would fall
below zero the step goes against it instead, as the estimator's authors propose. A word enters by its lift, the log of
how much more often confirmed texts hold it than all do, shrunk where few texts show it: no word is ruled out, and none
that a few texts hold by chance weighs much. Documents whose label is 0 are used only as unlabelled text. The class
prior is given, or the share of toxic ones among the labelled rows, or, where only confirmed rows are labelled, estimated
from confirmed and unlabelled texts by the best bin of held-out scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .language_mix import held_out

BUCKETS = 1 << 18
#: About so many confirmed documents (by a hash of the id) and unlabelled ones (by a hash of the text) are fitted; copies of a drawn text count once.
SAMPLE_POSITIVE, SAMPLE_UNLABELLED = 3000, 6000
EPOCHS, RATE, BATCHES, DECAY = 30, 0.05, 8, 1e-4
#: Texts that a word's lift is shrunk by, and the limits of a class prior.
SHRINK, LEAST_PRIOR, MOST_PRIOR = 10.0, 0.001, 0.9
#: Where the prior is estimated: that of the models that only rank texts, and their number.
GUESS, FOLDS = 0.1, 4
PREFIXES = (4, 6)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words of each text, and their beginnings of 4 and 6 bytes, as ascending (row, bucket).

    Words are runs of ASCII letters and non-ASCII bytes; the beginnings catch inflected and compounded forms.
    """
    clean = np.where(_LETTER[data], data, np.uint8(0x20))
    whole, rows, start, end = W.words(clean, offsets)
    keys = [rows * BUCKETS + (whole >> np.uint64(64 - 18)).astype(np.int64)]
    for n in PREFIXES:
        long = end - start > n
        hashes = W.mix(W.piece_hashes(clean, start[long], start[long] + n) + np.uint64(n))
        keys.append(rows[long] * BUCKETS + (hashes >> np.uint64(64 - 18)).astype(np.int64))
    key = np.unique(np.concatenate(keys))
    return key // BUCKETS, key % BUCKETS


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in W.chunks(batch):
            rows, buckets = features(data, offsets)
            bounds = np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.ListArray.from_arrays(bounds, pa.array(buckets.astype(np.int32)))], names=["toxic", "bag"])


class _Rows:
    """Sparse rows of ones."""

    def __init__(self, bags: list[np.ndarray], width: int) -> None:
        self.n, self.width = len(bags), width
        self.of = np.repeat(np.arange(self.n), [len(b) for b in bags])
        self.at = np.concatenate(bags) if bags else np.zeros(0, np.int64)

    def times(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.of, weights=w[self.at], minlength=self.n) + b

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=g[self.of], minlength=self.width)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def lifts(positive: _Rows, unlabelled: _Rows) -> np.ndarray:
    """The log of a word's share among confirmed texts over its share among all, both with SHRINK texts added that show nothing."""
    in_p, in_u = (np.bincount(x.at, minlength=x.width) for x in (positive, unlabelled))
    expected = (in_p + in_u + 1) / (positive.n + unlabelled.n + 2) * positive.n
    return np.log((in_p + SHRINK) / (expected + SHRINK))


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the estimated risk: of confirmed texts as positives, and of unlabelled ones as negatives, corrected."""
    return prior * float(np.logaddexp(0, -zp).mean()), float(np.logaddexp(0, zu).mean()) - prior * float(np.logaddexp(0, zp).mean())


def slopes(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """How the risk rises with the scores of confirmed and of unlabelled texts; against the second part where that is below zero."""
    sp, su = _sigmoid(zp), _sigmoid(zu)
    if risk(zp, zu, prior)[1] >= 0:
        return -prior / len(zp) * np.ones(len(zp)), su / len(zu)
    return prior * sp / len(zp), -su / len(zu)


def train_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic model, by Adam over shuffled batches; the same input gives the same model."""
    rng = np.random.default_rng(8)
    scale = lifts(_Rows(positive, BUCKETS), _Rows(unlabelled, BUCKETS))
    w = np.zeros(BUCKETS + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v, t = np.zeros(len(w)), np.zeros(len(w)), 0
    for _ in range(epochs):
        p_parts = np.array_split(rng.permutation(len(positive)), BATCHES)
        u_parts = np.array_split(rng.permutation(len(unlabelled)), BATCHES)
        for ip, iu in zip(p_parts, u_parts, strict=True):
            if not len(ip) or not len(iu):
                continue
            xp, xu = _Rows([positive[i] for i in ip], BUCKETS), _Rows([unlabelled[i] for i in iu], BUCKETS)
            weights = w[:-1] * scale
            gp, gu = slopes(xp.times(weights, w[-1]), xu.times(weights, w[-1]), prior)
            g = np.append((xp.back(gp) + xu.back(gu)) * scale + DECAY * w[:-1], gp.sum() + gu.sum())
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return (w[:-1] * scale).astype(np.float32), float(w[-1])


def best_bin(zp: np.ndarray, zu: np.ndarray, slack: float = 0.1) -> float:
    """The share of positives among the texts of scores zu, given scores zp of positives that the model has not seen.

    Above any threshold, the share of unlabelled texts over the share of positives is that of positives at least; the
    threshold is the one whose ratio has the least upper bound (Hoeffding, for both shares, at a chance of `slack`).
    """
    cuts = np.unique(zp)
    q_p = 1 - np.searchsorted(np.sort(zp), cuts) / len(zp)
    q_u = 1 - np.searchsorted(np.sort(zu), cuts) / len(zu)
    wide = np.sqrt(np.log(4 / slack) / 2) * (1 / np.sqrt(len(zu)) + 1 / np.sqrt(len(zp)))
    at = np.argmin((q_u + wide) / q_p)
    return float(q_u[at] / q_p[at])


def estimate_prior(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> float:
    """The class prior from confirmed and unlabelled texts alone: models of FOLDS parts of them score the part each has
    not seen, and the estimates are averaged."""
    found = []
    for k in range(FOLDS):
        seen, unseen = ([[b for i, b in enumerate(x) if (i % FOLDS == k) == new] for x in (positive, unlabelled)] for new in (False, True))
        if all(seen) and all(unseen):
            weights, bias = train_nnpu(*seen, GUESS)
            found.append(best_bin(*(_Rows(x, BUCKETS).times(weights, bias) for x in unseen)))
    return float(np.mean(found)) if found else GUESS


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> tuple[np.ndarray, float]:
    """Fit on the documents that are not held out; labels (doc_id, toxic), where any 1 of a document counts.

    Counts come from labels alone, so documents are not joined with all labels: only the drawn ids are sent to them.
    """
    none = np.zeros(BUCKETS, np.float32), -2.0
    marks = labels.select("doc_id", "toxic").where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    seen = marks.agg(F.count("*").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("p")).first()
    train = docs.select("doc_id", "text").where(~held_out())
    n = train.count()
    if not seen["p"] or not n:
        return none
    part = lambda c: F.xxhash64(c, F.lit(23)).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    # About SAMPLE_POSITIVE ids, whatever the number of labels: small enough to broadcast.
    drawn = marks.where((F.col("toxic") == 1) & (part("doc_id") < SAMPLE_POSITIVE / seen["p"])).select("doc_id", F.lit(1).alias("hit"))
    # The estimator takes unlabelled text from the whole population, so confirmed documents may be drawn here too.
    uses = F.array_compact(F.array(F.when(F.col("hit") == 1, 1), F.when(part("text") < SAMPLE_UNLABELLED / n, 0)))
    used = train.where("text is not null").join(F.broadcast(drawn), "doc_id", "left").select("text", F.explode(uses).alias("toxic")).distinct()
    found = used.mapInArrow(_bags, "toxic int, bag array<int>").toArrow()
    bags = [np.asarray(b.values, dtype=np.int64) for b in found["bag"]]
    toxic = found["toxic"].to_pylist()
    order = sorted(range(len(bags)), key=lambda i: bags[i].tobytes())  # the same model however the rows arrive
    positive, unlabelled = ([bags[i] for i in order if toxic[i] == t] for t in (1, 0))
    if not positive or not unlabelled:
        return none
    if prior is None:
        prior = seen["p"] / seen["labelled"] if seen["p"] < seen["labelled"] else estimate_prior(positive, unlabelled)
    return train_nnpu(positive, unlabelled, min(MOST_PRIOR, max(LEAST_PRIOR, prior)))


def toxicity(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> DataFrame:
    """docs (doc_id, text, more), labels (doc_id, toxic, more) -> doc_id, held_out, score, predicted.

    prior: the share of toxic documents; if none is given, it is that of the labelled rows, or estimated where all of
    these are toxic.

    A null or blank text has no words and gets the score of the bias alone. Without toxic training rows the model is
    the bias. Labels that are null, or of no document, are ignored; where a document has several, 1 wins. Rows of
    docs come back one for one, repeated ids and null ids included; a very long text counts each of its words once, like
    any other. Equal texts have equal scores. An empty table gives none. Other columns, whatever their names, are ignored.
    """
    weights, bias = fit(docs, labels, prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in W.chunks(batch):
                rows, buckets = features(data, offsets)
                score = _sigmoid(np.bincount(rows, weights=weights[buckets], minlength=part.num_rows) + bias)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")
