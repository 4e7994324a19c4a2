"""Encoding whole texts with a ``tokenizers`` file, each distinct chunk of text once.

A tokenizer whose pre-tokenizer drops white space never looks across a space or a line
feed, so the ids of a text are the ids of its chunks in a row. A full stop or comma right
after an ASCII letter begins a chunk as well where no piece reaches across, and ASCII capitals
are written small where the tokenizer does so itself; all of this is checked when the file
is loaded. Chunks are told apart in Arrow, the library encodes those that are not remembered,
and numpy puts the ids in order.
"""

from __future__ import annotations

import os
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pokerlake.llm.words import text_slices

#: Chunks and bytes that a task remembers. They bound memory only: a forgotten chunk is encoded again.
REMEMBERED = 2_000_000
REMEMBERED_BYTES = 96 << 20
JOINED = 2_000


class ChunkEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._check()
        self._forget()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _check(self) -> None:
        """Refuse a tokenizer that looks across white space; see what else holds for this one."""
        pieces = [p.removesuffix("</w>") for p in self.tokenizer.get_vocab(with_added_tokens=False)]
        longer = [p for p in pieces if len(p) > 1]  # a sign of its own, as bytes have them, reaches nowhere
        held = {t: self._ids(t) for t in ("ab", "Ab", "AB", "x", "7", "!", "\u00e9")}
        spaced = all(self._ids(f"{a}{gap}{b}") == x + y for a, x in held.items() for b, y in held.items() for gap in (" ", "\n", " \n "))
        if not spaced or any(re.search("[\\s\u0120\u010a\u2581]", p) for p in [*longer, *self.added]):
            raise ValueError("the tokenizer does not drop white space before it splits")
        self.cut = not any(re.search("[A-Za-z][.,]", p) for p in [*longer, *self.added]) and all(
            self._ids(f"{t}{sign}") == x + self._ids(sign) for t, x in held.items() if t.isalpha() for sign in (".", ",", ".,x", ",'s")
        )
        letters = [*string.ascii_uppercase, "AB", "aBc", "X\u00e9", "\u00c9X", "A\u0301", "DON'T"]
        self.lower = all(self._ids(t) == self._ids("".join(c.lower() if c.isascii() else c for c in t)) for t in letters)

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids, self.lengths, self.used = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, bool)

    def kind(self, *more: int) -> np.dtype:
        """Smallest type that holds every id, and ``more``."""
        most = max(*self.tokenizer.get_vocab(with_added_tokens=True).values(), *more)
        return np.dtype(np.uint16 if most < 1 << 16 else np.uint32)

    def _learn(self, chunks: pa.Array) -> None:
        """Ids of chunks, many to a call; a token belongs to the chunk it starts in."""
        all_ids, all_lengths = [self.ids], [self.lengths]
        for at in range(0, len(chunks), JOINED):
            group = chunks.slice(at, JOINED).to_pylist()
            encoding = self.tokenizer.encode(" ".join(group), add_special_tokens=False)
            begins = np.zeros(len(group) + 1, np.int64)
            np.cumsum([len(c) + 1 for c in group], out=begins[1:])
            starts = np.fromiter((o[0] for o in encoding.offsets), np.int64, len(encoding))
            all_lengths.append(np.diff(np.searchsorted(starts, begins)))
            all_ids.append(np.array(encoding.ids, np.uint32))
        self.ids, self.lengths = np.concatenate(all_ids), np.concatenate(all_lengths)
        self.known = pa.concat_arrays([self.known, chunks])
        self.used = np.concatenate([self.used, np.ones(len(chunks), bool)])

    def _make_room(self) -> None:
        """Keep what was used since the last time, or nothing if that is most of it."""
        if len(self.known) <= REMEMBERED and self.known.nbytes + self.ids.nbytes <= REMEMBERED_BYTES:
            return
        if 2 * self.used.sum() > len(self.used):
            return self._forget()
        self.known = self.known.filter(pa.array(self.used))
        self.ids = self.ids[np.repeat(self.used, self.lengths)]
        self.lengths = self.lengths[self.used]
        self.used = np.zeros(len(self.lengths), bool)

    def _places(self, chunks: pa.Array) -> np.ndarray:
        """Places of the chunks among those that are known, learning the others."""
        self._make_room()
        found = pc.index_in(chunks, value_set=self.known)
        new = pc.is_null(found)
        places = found.fill_null(0).to_numpy().astype(np.int64)
        self.used[places[~new.to_numpy(zero_copy_only=False)]] = True
        if new.true_count:
            at = np.flatnonzero(new.to_numpy(zero_copy_only=False))
            places[at] = len(self.known) + np.arange(len(at))
            self._learn(chunks.filter(new))
        return places

    def _chunks(self, texts: pa.Array) -> pa.ListArray:
        texts = pc.replace_substring(texts, "\n", " ")
        if self.cut:
            texts = pc.replace_substring_regex(texts, "([A-Za-z])([.,])", "\\1 \\2")
        if self.lower:
            low = pc.ascii_lower(texts)
            # Added tokens are found before capitals are written small: none may appear that was not there.
            if all(pc.sum(pc.count_substring(low, t)).as_py() == pc.sum(pc.count_substring(texts, t)).as_py() for t in self.added):
                texts = low
        return pc.split_pattern(texts, " ")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        all_ids, all_counts = [], []
        for _, part in text_slices(texts, 8 << 20):
            words = self._chunks(part)
            firsts = words.offsets.to_numpy().astype(np.int64)
            coded = words.flatten().dictionary_encode()
            order = self._places(coded.dictionary)[coded.indices.to_numpy()]
            n = self.lengths[order]
            begins = (np.cumsum(self.lengths) - self.lengths)[order]
            ends = np.cumsum(n)
            total = np.concatenate([np.zeros(1, np.int64), ends])
            at = np.arange(total[-1]) + np.repeat(begins - (ends - n), n)
            all_ids.append(self.ids[at])
            all_counts.append(np.diff(total[firsts - firsts[0]]))
        if not all_ids:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate(all_ids), np.concatenate(all_counts)
