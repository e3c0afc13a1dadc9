"""Operator 2: license texts and notices inside documents, with matched coverage and spans.

Method: every template is cut into three-word shingles and winnowed (the least hash of each window of three), which
an inverted index maps to template and place. All shingles of a document are looked up, so every common run of five
words or more is found, and shorter ones where they hold a fingerprint. Templates of up to SHORT words are looked up by
all their pairs of neighbouring words instead: with words replaced or left out as COVERAGE allows, one pair at least is
still there. Hits of one template on neighbouring diagonals make a group; groups that follow one another in the document
and in the template make a chain (words put in or left out between them move the diagonal). A chain's words are aligned
with the template's inside a band that holds all its diagonals, so its parts count together.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W
from .license_texts import TEMPLATES

K, WINDOW, BAND, COVERAGE, SHORT = 3, 3, 12, 0.7, 24

_SOLID = np.zeros(256, dtype=bool)
_SOLID[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _clean(data: np.ndarray) -> np.ndarray:
    return np.where(_SOLID[data], data, np.uint8(0x20))


def _shingles(hashes: np.ndarray, rows: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hash at each word that begins one inside its row, and those words' places."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = sum(W.mix(hashes[i : len(hashes) - k + 1 + i] + np.uint64(2 * i + 1)) * np.uint64(2 * i + 0x9E3779B9) for i in range(k))
    at = np.flatnonzero(rows[: len(total)] == rows[k - 1 :])
    return W.mix(total[at]), at


def winnow(shingles: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Places of the least shingle (the last of equals) of every window; a row of fewer shingles is one window."""
    n = len(shingles)
    chosen = np.zeros(n, dtype=bool)
    if n >= WINDOW:
        best, place = shingles[: n - WINDOW + 1].copy(), np.arange(n - WINDOW + 1)
        for k in range(1, WINDOW):
            other = shingles[k : n - WINDOW + 1 + k]
            less = other <= best
            best[less], place[less] = other[less], np.flatnonzero(less) + k
        chosen[place[of[: n - WINDOW + 1] == of[WINDOW - 1 :]]] = True
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    for a, b in zip(starts, np.append(starts[1:], n), strict=True) if n else ():
        if b - a < WINDOW:
            chosen[a + int(np.argmin(shingles[a:b]))] = True
    return np.flatnonzero(chosen)


@dataclass
class Index:
    """Template words, fingerprint -> (template, place), and the same for the word pairs of short templates."""

    names: list[str]
    words: list[np.ndarray]
    prints: np.ndarray
    where: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    pairs: dict[int, list[tuple[int, int]]] = field(default_factory=dict)


def build(templates: dict[str, str]) -> Index:
    where, pairs, words = defaultdict(list), defaultdict(list), []
    for t, text in enumerate(templates.values()):
        data = _clean(np.frombuffer(text.encode(), np.uint8))
        hashes, rows, _, _ = W.words(data, np.array([0, len(data)]))
        short = len(hashes) <= SHORT
        shingles, at = _shingles(hashes, rows, 2 if short else K)
        for i in range(len(at)) if short else winnow(shingles, rows[at]).tolist():
            (pairs if short else where)[int(shingles[i])].append((t, int(at[i])))
        words.append(hashes)
    return Index(list(templates), words, np.array(sorted(where), dtype=np.uint64), dict(where), dict(pairs))


def band_of(n_words: int) -> int:
    """How far an alignment may drift: a quarter of the template, BAND at most."""
    return max(1, min(BAND, n_words // 4))


_MASK = (1 << 21) - 1


def align(a: np.ndarray, b: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Most words of a matched in order in b with low <= place in b - place in a <= high; first and last matched place in b.

    Of equal matches the one that begins last, then the one that ends first: the tight one. A row of cells, one for each
    diagonal, is one number each: matched words, first place, how early the last one is, from the highest bits down.
    """
    wide = high - low + 1
    pad = np.zeros(len(a) + wide + 1, dtype=b.dtype)
    at = np.arange(len(pad)) + low
    inside = (at >= 0) & (at < len(b))
    pad[inside] = b[at[inside]]
    row = np.zeros(wide + 1, dtype=np.int64)
    for i, x in enumerate(a):
        hit = np.flatnonzero((pad[i : i + wide] == x) & inside[i : i + wide])
        new = np.maximum(row[1:], row[:-1])
        if len(hit):
            old, j = row[hit], hit + i + low
            m = old >> 42
            new[hit] = np.maximum(new[hit], (m + 1) << 42 | np.where(m > 0, (old >> 21) & _MASK, j) << 21 | (_MASK - j))
        row[:-1] = np.maximum.accumulate(new)
    best = int(row.max())
    return best >> 42, (best >> 21) & _MASK, _MASK - (best & _MASK)


def chains(hits: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """hits (place in the document, place in a template of `size` words) -> the least and the greatest diagonal of each chain.

    A group is the hits of one template's length on diagonals half a band apart at most. One group follows another if it
    begins behind it in both texts and their diagonals are no further apart than the template is long; a group follows
    the one that gives the chain of most hits, and only groups a template's length back or less are looked at.
    """
    reach = max(1, band_of(size) // 2)
    by_shift = sorted({(p - q, p, q) for p, q in hits})
    groups: list[list[int]] = []  # first and last diagonal, first and last place in the document, in the template, hits
    for s, p, q in by_shift:
        g = groups[-1] if groups else None
        if g and s - g[0] <= reach:
            g[1], g[2], g[3], g[4], g[5], g[6] = s, min(g[2], p), max(g[3], p), min(g[4], q), max(g[5], q), g[6] + 1
        else:
            groups.append([s, s, p, p, q, q, 1])
    groups.sort(key=lambda g: (g[2], g[4]))
    score, back = [g[6] for g in groups], [-1] * len(groups)
    first = 0
    for i, g in enumerate(groups):
        while groups[first][2] < g[2] - 2 * size:
            first += 1
        for j in range(first, i):
            h = groups[j]
            if h[3] < g[2] + K and h[5] < g[4] + K and h[2] < g[2] and h[4] < g[4] and abs(g[0] - h[1]) <= size and score[j] + g[6] > score[i]:
                score[i], back[i] = score[j] + g[6], j
    out, used = [], set()
    for i in sorted(range(len(groups)), key=lambda i: -score[i]):
        low = high = None
        while i >= 0 and i not in used:
            used.add(i)
            low, high = min(groups[i][0], groups[i][0] if low is None else low), max(groups[i][1], groups[i][1] if high is None else high)
            i = back[i]
        if low is not None:
            out.append((low, high))
    return out


def _found(index: Index, text: np.ndarray, hits: dict[int, list[tuple[int, int]]], coverage: float) -> list[tuple[int, int, int, int]]:
    """(template, matched, first, last word) of the licenses of one text; of overlapping ones that of most matched words."""
    out = []
    for t, places in sorted(hits.items()):
        words = index.words[t]
        size, band = len(words), band_of(len(words))
        for low, high in chains(places, size):
            lo, hi = max(0, low - band), min(len(text), high + size + band)
            part = text[lo:hi]
            # No more words can match than there are in both.
            if np.isin(words, part).sum() < coverage * size:
                continue
            m, first, last = align(words, part, low - band - lo, high + band - lo)
            if m >= coverage * size:
                out.append((-m, -m / size, t, lo + first, lo + last))
    kept: list[tuple[int, int, int, int]] = []
    taken: list[tuple[int, int]] = []
    for m, _, t, first, last in sorted(out, key=lambda x: (x[0], x[1], x[3], x[2])):
        at = bisect_left(taken, (first, last))
        if (at == 0 or taken[at - 1][1] < first) and (at == len(taken) or taken[at][0] > last):
            taken.insert(at, (first, last))
            kept.append((t, -m, first, last))
    return sorted(kept, key=lambda x: x[2])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """docs (doc_id, text, more) -> one row for each license found: doc_id, license, coverage, matched, template_words,
    first_word, last_word (from 0), first_byte, end_byte (of the UTF-8 text).

    Of overlapping finds the one of most matched words stays; of equals that of the higher coverage, then the earlier
    one, then the template given first. A template that two others of the list resemble (a license and its variant) is
    so reported once. Null and wordless texts give none, as does an empty table. Repeated rows give repeated results;
    null ids come back null. A very long text is scanned whole. Other columns, whatever their names, are ignored. A
    template of one word is never found.
    """
    index = build(TEMPLATES if templates is None else templates)
    pairs = np.array(sorted(index.pairs), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = [np.zeros(1 << 20, dtype=bool) for _ in range(2)]
        for mask, prints in zip(maybe, (index.prints, pairs), strict=True):
            mask[(prints >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            for part, data, offsets in W.chunks(batch):
                hashes, rows, start, end = W.words(_clean(data), offsets)
                begins = np.searchsorted(rows, np.arange(part.num_rows + 1))
                found: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
                for k, mask, prints, where in ((K, maybe[0], index.prints, index.where), (2, maybe[1], pairs, index.pairs)):
                    shingles, at = _shingles(hashes, rows, k)
                    near = np.flatnonzero(mask[(shingles >> np.uint64(44)).astype(np.int64)])
                    near = near[np.isin(shingles[near], prints)]
                    for r, place, print_ in zip(rows[at[near]].tolist(), (at[near] - begins[rows[at[near]]]).tolist(), shingles[near].tolist(), strict=True):
                        for t, own in where[print_]:
                            found[r][t].append((place, own))
                out = []
                for r, hits in sorted(found.items()):
                    for t, m, first, last in _found(index, hashes[begins[r] : begins[r + 1]], hits, coverage):
                        a, b = int(begins[r]) + first, int(begins[r]) + last
                        size = len(index.words[t])
                        out.append((r, index.names[t], m / size, m, size, first, last, int(start[a] - offsets[r]), int(end[b] - offsets[r])))
                if out:
                    r, name, cover, m, size, first, last, a, b = zip(*out, strict=True)
                    ints = lambda x: pa.array(x, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(r)), pa.array(name), pa.array(cover, pa.float64()), ints(m), ints(size), ints(first), ints(last), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                        names=["doc_id", "license", "coverage", "matched", "template_words", "first_word", "last_word", "first_byte", "end_byte"],
                    )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, coverage double, matched int, template_words int, first_word int, last_word int, first_byte long, end_byte long")
