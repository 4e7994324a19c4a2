import random

import numpy as np
import pyarrow as pa

from pokerlake.llm import words as w
from tests.llm.frames import words


def random_texts(n: int) -> list[str | None]:
    draw = random.Random(4)
    parts = ["a", "bc", "é", "日本", " ", "  ", "\n", "\t", "\x0b", " ", "x" * 50]
    return [None, "", " "] + ["".join(draw.choices(parts, k=draw.randint(0, 30))) for _ in range(n)]


def test_words_and_hashes(monkeypatch):
    texts = random_texts(300)
    monkeypatch.setattr(w, "SLICE_BYTES", 64)
    seen: dict[str, set] = {}
    rows = 0
    for low, part in w.text_slices(pa.array(texts, pa.string()), 100):
        found = w.words_of(part)
        hashes = w.word_hashes(found)
        for i in range(len(part)):
            own = [bytes(found.data[found.start[k] : found.end[k]]).decode() for k in range(found.first[i], found.first[i + 1])]
            assert own == words(texts[low + i])
            for word, h in zip(own, hashes[found.first[i] : found.first[i + 1]].tolist(), strict=True):
                seen.setdefault(word, set()).add(h)
        rows += len(part)
    assert rows == len(texts)
    assert all(len(h) == 1 for h in seen.values())
    assert len({min(h) for h in seen.values()}) == len(seen)


def test_sliding_argmin_is_the_leftmost():
    values = np.random.default_rng(1).integers(0, 9, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 31, 200, 201):
        expected = [i + int(np.argmin(values[i : i + width])) for i in range(len(values) - width + 1)]
        assert w.sliding_argmin(values, width).tolist() == expected


def test_rolling_hashes_follow_the_words():
    values = np.array([1, 2, 3, 1, 2, 3, 4], np.uint64)
    rolled = w.rolling_hashes(values, 3).tolist()
    assert rolled[0] == rolled[3] and len(set(rolled)) == 4
    assert len(w.rolling_hashes(values, 8)) == 0
