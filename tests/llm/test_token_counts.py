import random

import public_tokenizers
import sentencepiece

from pokerlake.llm import token_counts as tc
from tests.llm.frames import EDGES, documents

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_equals_the_library(spark, monkeypatch):
    monkeypatch.setattr(tc, "CHUNK_BYTES", 5_000)
    draw = random.Random(12)
    parts = [" ", " ", "  ", "▁", "a", "the", "\n", ".", ",", ".,", "s.", "é", "日本", "<s>", "</s>", "<0x0A>", "\t", "　", "\r", "x"]
    rows = EDGES + [(100 + i, "".join(draw.choices(parts, k=draw.randint(0, 15)))) for i in range(3_000)]
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [r[1] or "" for r in rows]
    expected = [(r[0], len(t.encode()), len(x)) for r, t, x in zip(rows, texts, library.encode(texts), strict=True)]
    got = [tuple(r) for r in tc.token_counts(documents(spark, rows), PATH).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_empty_inputs(spark):
    assert tc.token_counts(documents(spark, EDGES).limit(0), PATH).collect() == []
    nothing = documents(spark, [(1, None), (2, "")])
    assert sorted(map(tuple, tc.token_counts(nothing, PATH).collect())) == [(1, 0, 0), (2, 0, 0)]
