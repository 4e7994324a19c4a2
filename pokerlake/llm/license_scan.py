"""Licence scan: winnowed fingerprints pick templates, banded alignment reports what matches.

Words are compared in lower case and without ASCII punctuation. Of every ``SPAN``
consecutive hashes of ``GRAM`` words, the smallest is a fingerprint, in templates and texts
alike, so a common stretch of ``GRAM + SPAN - 1`` words shares one. Fingerprints of all
templates form an inverted index; a hit names a template and a diagonal. Templates of fewer
than ``FEW`` words are also indexed by every word: where as many of their words as the
coverage asks for lie within the band, each diagonal there is a candidate, so none of their
places is missed, wherever words are changed. Other hits of one template with near diagonals are one candidate, and a local alignment in a band around it
(words may be changed, missing or added) gives the words matched and the span in the text.

The templates are a parameter; their index is as large as they are, not as the documents.
Templates with fewer than ``GRAM`` words match nothing. Every place of a template in a text
is a row; of overlapping places of one template the one with more matching words stays.
Null and empty texts match nothing. Rows with equal or null ids give their rows each. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pokerlake.llm.license_texts import TEMPLATES
from pokerlake.llm.words import PLAIN_LOWER, PLAIN_SPACE, U64, rolling_hashes, sliding_argmin, text_slices, word_hashes, words_of

GRAM = 3
SPAN = 3
FEW = 12
BAND = 8
COVERAGE = 0.8
FOUND = "doc_id long, template string, license string, matched long, template_words long, coverage double, start long, end long, start_byte long, end_byte long"


def fingerprints(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the fingerprints, places of all runs of ``GRAM`` words), none over a border of ``first``."""
    grams = rolling_hashes(hashes, GRAM)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = len(grams)
    whole = owner[:n] == owner[GRAM - 1 : GRAM - 1 + n]
    picked = sliding_argmin(grams, SPAN)
    m = len(picked)
    inside = whole[:m] & whole[SPAN - 1 : SPAN - 1 + m] & (owner[:m] == owner[SPAN - 1 : SPAN - 1 + m])
    return np.unique(picked[inside]), np.flatnonzero(whole)


class Postings:
    """Sorted hashes with the places they stand for."""

    def __init__(self, grams: np.ndarray, places: np.ndarray):
        order = np.argsort(grams, kind="stable")
        self.grams, self.places = grams[order], places[order]
        self.near = np.zeros(1 << 16, bool)
        self.near[self.grams >> U64(48)] = True

    def join(self, grams: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place on the other side, place here) of all equal hashes."""
        at = np.flatnonzero(self.near[grams >> U64(48)])
        low, high = (np.searchsorted(self.grams, grams[at], side) for side in ("left", "right"))
        n = high - low
        return places[np.repeat(at, n)], self.places[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matching words, first word, word after the last) of the best local alignment.

    Text word ``i + diagonal + b - band`` meets template word ``i``; a match gains two, a
    change, a missing or an added word costs one.
    """
    n, width = len(template), 2 * band + 1
    score = np.zeros((n + 1, width + 1), np.int64)
    places = np.arange(n)[:, None] + diagonal - band + np.arange(width)
    valid = (places >= 0) & (places < len(text))
    same = np.zeros((n, width), bool)
    same[valid] = (text[np.clip(places, 0, max(0, len(text) - 1))] == template[:, None])[valid] if len(text) else False
    ramp = np.arange(width)
    for i in range(n):
        step = np.maximum(score[i, :width] + np.where(same[i], 2, -1), score[i, 1:] - 1)
        step = np.where(valid[i], np.maximum(step, 0), 0)
        score[i + 1, :width] = np.maximum(np.maximum.accumulate(step + ramp) - ramp, 0) * valid[i]
    i, b = np.unravel_index(int(score.argmax()), score.shape)
    i, b, matched, end = int(i), int(b), 0, 0
    start = 0
    while i > 0 and score[i, b] > 0:
        place = int(places[i - 1, b])
        if score[i, b] == score[i - 1, b] + 2 and same[i - 1, b]:
            matched, start, end = matched + 1, place, end or place + 1
            i -= 1
        elif score[i, b] == score[i - 1, b] - 1 and not same[i - 1, b]:
            i -= 1
        elif score[i, b] == score[i - 1, b + 1] - 1:
            i, b = i - 1, b + 1
        elif b > 0 and score[i, b] == score[i, b - 1] - 1:
            b -= 1
        else:
            break
    return matched, start, end


class Index:
    """Inverted index from fingerprints to (template, place)."""

    def __init__(self, templates: list[tuple[str, str, str]]):
        self.templates = templates
        words = words_of(pa.array([t[2] for t in templates], pa.string()), PLAIN_SPACE, PLAIN_LOWER)
        self.hashes, self.first = word_hashes(words), words.first
        marked, _ = fingerprints(self.hashes, self.first)
        self.sizes = np.diff(self.first)
        few = np.flatnonzero(np.repeat((self.sizes >= GRAM) & (self.sizes < FEW), self.sizes))
        self.marked, self.words = Postings(rolling_hashes(self.hashes, GRAM)[marked], marked), Postings(self.hashes[few], few)

    def candidates(self, hashes: np.ndarray, first: np.ndarray, coverage: float = COVERAGE) -> np.ndarray:
        """Distinct (text, template, diagonal)."""
        marked, _ = fingerprints(hashes, first)
        grams = self._hits(*self.marked.join(rolling_hashes(hashes, GRAM)[marked], marked), first)
        words = self._hits(*self.words.join(hashes, np.arange(len(hashes))), first)
        # Where a window of as many hits as needed is no wider than the band, all of its diagonals.
        size = self.sizes[words[:, 1]]
        low = np.arange(len(words))
        high = low + np.maximum(1, np.ceil(coverage * size - 1e-9).astype(np.int64)) - 1
        low, high, size = (v[high < len(words)] for v in (low, high, size))
        a, b = words[low], words[high]
        met = (a[:, :2] == b[:, :2]).all(axis=1) & (b[:, 2] - a[:, 2] <= 2 * (size // 2))
        n = (b[met, 2] - a[met, 2]) + 1
        wide = np.repeat(a[met], n, axis=0)
        wide[:, 2] += np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.unique(np.concatenate([grams, wide]), axis=0)

    def _hits(self, place: np.ndarray, spot: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Sorted (text, template, diagonal) of each hit."""
        text, template = (np.searchsorted(f, p, "right") - 1 for f, p in ((first, place), (self.first, spot)))
        diagonal = (place - first[text]) - (spot - self.first[template])
        return np.stack([text, template, diagonal], axis=1)[np.lexsort([diagonal, template, text])]

    def matches(self, texts: pa.Array, coverage: float) -> list[tuple]:
        """(text, template, matching words, template words, first word, after the last, first byte, after the last)."""
        words = words_of(texts, PLAIN_SPACE, PLAIN_LOWER)
        hashes, best = word_hashes(words), []
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
        offsets -= offsets[0]
        last = None
        for text, template, diagonal in self.candidates(hashes, words.first, coverage).tolist():
            own = self.hashes[self.first[template] : self.first[template + 1]]
            band = min(BAND, len(own) // 2)  # so that the band does not reach the next place
            if len(own) >= FEW and last and last[:2] == (text, template) and diagonal - last[2] <= band // 2:
                continue  # within the band of the candidate before
            last = (text, template, diagonal)
            low, high = int(words.first[text]), int(words.first[text + 1])
            around = max(0, diagonal - 2 * band), min(high - low, diagonal + len(own) + 2 * band)
            matched, start, end = align(own, hashes[low + around[0] : low + around[1]], diagonal - around[0], band)
            if matched >= coverage * len(own) and matched > 0:
                best.append((text, template, matched, len(own), start + around[0], end + around[0]))
        kept: list[tuple] = []
        for row in sorted(best, key=lambda r: (r[0], r[1], -r[2], r[4])):
            if not any(k[:2] == row[:2] and k[4] < row[5] and row[4] < k[5] for k in reversed(kept) if k[0] == row[0]):
                kept.append(row)
        return [(*r, int(words.start[words.first[r[0]] + r[4]] - offsets[r[0]]), int(words.end[words.first[r[0]] + r[5] - 1] - offsets[r[0]])) for r in kept]


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """A row per place of a template (name, licence id, text) that is covered enough: FOUND."""
    index = docs.sparkSession.sparkContext.broadcast(Index(templates or TEMPLATES))  # as large as the templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, part in text_slices(batch.column("text")):
                found = index.value.matches(part, coverage)
                if found:
                    text, template, matched, words, start, end, start_byte, end_byte = zip(*found, strict=True)
                    names, ids = zip(*(index.value.templates[t][:2] for t in template), strict=True)
                    share = [m / w for m, w in zip(matched, words, strict=True)]
                    columns = [batch.column("doc_id").take(pa.array([low + t for t in text])), names, ids, matched, words, share, start, end, start_byte, end_byte]
                    yield pa.record_batch([pa.array(c) for c in columns], names=[c.split()[0] for c in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)
