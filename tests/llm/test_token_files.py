import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pokerlake.llm import subwords, token_files
from tests.llm.frames import EDGES, documents

PATH = public_tokenizers.path("word_bpe_49k.json")
NASTY = ["it's DON'T 12 3", "a\tb\r\nc", "é ́x", "ΑΣ ΑΣ' Σ", "<|endoftext|>x <|startoftext|>", "\n\n", "x" * 3_000, "　 a b"]


def expected(rows):
    library, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0])):
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark):
    rows = EDGES + [(100 + i, t) for i, t in enumerate(NASTY)]
    manifest = token_files.write_token_files(documents(spark, rows), PATH, sequence_length=64)
    got = sorted((tuple(r) for r in token_files.read_digests(manifest).collect()), key=lambda r: r[1])
    assert got == expected(rows)
    assert token_files.read_digests(token_files.write_token_files(documents(spark, rows).limit(0), PATH)).collect() == []


def test_random_access(spark):
    rows = [(i, f"text number {i} " * (i % 40)) for i in range(300)]
    files = token_files.write_token_files(documents(spark, rows), PATH, sequence_length=16).orderBy("slice").collect()
    library = Tokenizer.from_file(PATH)
    stream = [x for i, t in rows for x in [*library.encode(t, add_special_tokens=False).ids, 2]]
    for file in files:
        own = []
        for n in range(file.sequences):
            ids, mask = token_files.sequence(file.file, n)
            assert len(ids) == len(mask) == 16 and ids.dtype == np.uint16
            own += ids[: mask.true_count].tolist()
        assert own == stream[file.start : file.start + file.tokens]


def test_forgotten_chunks_are_learnt_again(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(subwords, "REMEMBERED", 3)
    encoder, texts = subwords.ChunkEncoder(PATH), [f"word{i % 7} other{i}" for i in range(50)]
    for part in (texts, texts[::-1], texts):
        ids, counts = encoder.encode(pa.array(part))
        assert ids.tolist() == [x for t in part for x in encoder.tokenizer.encode(t, add_special_tokens=False).ids]
        assert counts.sum() == len(ids)


def test_capitals_stops_and_added_tokens_as_the_library_has_them():
    import pyarrow as pa

    encoder = subwords.ChunkEncoder(PATH)
    assert encoder.cut and encoder.lower
    texts = ["A,b.C d.,e f.'s g,'S H...i", "<|STARTOFTEXT|> <|startoftext|>.", "ÉA.b \u212a \u0130X ΑΣ.", "x.<|endoftext|>,Y", "a.b" * 400, ". , .a ,b"]
    for part in (texts, texts[1:2], texts[:1]):
        ids, counts = encoder.encode(pa.array(part))
        want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in part]
        assert ids.tolist() == [x for w in want for x in w] and counts.tolist() == [len(w) for w in want]


def test_tokenizers_that_look_across_spaces_are_refused(tmp_path):
    from tokenizers import models, pre_tokenizers

    level = Tokenizer(models.BPE(vocab={c: i for i, c in enumerate(sorted(pre_tokenizers.ByteLevel.alphabet()))}, merges=[]))
    level.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    level.save(str(tmp_path / "level.json"))
    with pytest.raises(ValueError):
        subwords.ChunkEncoder(str(tmp_path / "level.json"))
