"""Words of a text column as numpy arrays, without a Python object per word.

A word is a run of ``[^\\x20\\x09-\\x0D]``. Work goes in slices of a few megabytes of text,
so memory does not follow the batch size; one text longer than a slice is a slice itself.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
U64 = np.uint64

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
# Lower case and ASCII punctuation as separators, for matching that ignores both.
PLAIN_SPACE = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
PLAIN_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


@dataclass
class Words:
    """``data[start:end]`` is a word; document ``i`` owns words ``first[i]`` to ``first[i + 1]``."""

    data: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @property
    def documents(self) -> np.ndarray:
        """Document number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def tidy(step: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The step of a task, giving freed memory back to the system at its end: workers wait for their next task."""

    @functools.wraps(step)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from step(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
            if trim:
                trim(0)

    return run


def text_slices(texts: pa.Array, size: int = SLICE_BYTES, rows: int | None = None) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) in slices of about ``size`` bytes and at most ``rows`` rows; null texts are empty."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + 1, offset=4 * texts.offset).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    at = 0
    while at < len(texts):
        stop = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        stop = min(max(stop, at + 1), len(texts), at + (rows or len(texts)))
        yield at, texts.slice(at, stop - at)
        at = stop


def words_of(texts: pa.Array, space: np.ndarray = SPACE, lower: np.ndarray | None = None) -> Words:
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + 1, offset=4 * texts.offset).astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = ~space[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(data if lower is None else lower[data], np.searchsorted(start, offsets), start, end)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of an odd number modulo 2**64 and of its inverse."""

    def __init__(self, base: int):
        self.base, self.inverse = U64(base), U64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(size, b, U64)])) for b in (self.base, self.inverse))
        return self.up, self.down


_BASES = (_Powers(0x9E3779B97F4A7C15), _Powers(0xC2B2AE3D27D4EB4F))


def word_hashes(words: Words, family: int = 0) -> np.ndarray:
    """64-bit hash of each word's bytes; ``family`` picks one of two independent functions."""
    powers, out = _BASES[family], np.empty(len(words.start), U64)
    at, n, chunk = 0, len(words.start), SLICE_BYTES // 2
    while at < n:
        low = words.start[at]
        stop = max(at + 1, int(np.searchsorted(words.end, low + chunk, side="right")))
        high = int(words.end[stop - 1])
        up, down = powers.upto(high - low + 1)
        total = np.zeros(high - low + 1, U64)
        np.cumsum((words.data[low:high].astype(U64) + U64(1)) * up[: high - low], out=total[1:])
        s, e = words.start[at:stop] - low, words.end[at:stop] - low
        out[at:stop] = mixed((total[e] - total[s]) * down[s] + (e - s).astype(U64))
        at = stop
    return out


def rolling_hashes(hashes: np.ndarray, width: int, family: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words, across document borders too."""
    if len(hashes) < width:
        return np.zeros(0, U64)
    factor, out, n = _BASES[1 - family].base, np.zeros(len(hashes) - width + 1, U64), len(hashes) - width + 1
    for i in range(width):
        out = out * factor + hashes[i : i + n]
    return mixed(out)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the minimum of each ``width`` consecutive values, the leftmost of equal ones, by doubling."""
    if len(values) < width:
        return np.zeros(0, np.int64)
    at, done = np.arange(len(values)), 1

    def smaller(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(values[right] < values[left], right, left)

    while done * 2 <= width:
        at = smaller(at[:-done], at[done:])
        done *= 2
    rest = width - done
    return smaller(at[: len(at) - rest], at[rest:]) if rest else at
