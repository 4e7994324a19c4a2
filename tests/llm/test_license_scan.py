import random

import numpy as np
import pyarrow as pa

from pokerlake.llm import license_scan as ls
from pokerlake.llm.license_texts import TEMPLATES
from tests.llm.frames import EDGES, documents


def test_finds_changed_texts_with_spans(spark):
    draw, rows, truth = random.Random(9), [], {}
    for i, (name, _, text) in enumerate(TEMPLATES):
        words = text.split()
        if len(words) > 30:
            for at in draw.sample(range(len(words)), 3):
                words[at] = "changed"
            del words[draw.randrange(len(words))]
            words.insert(draw.randrange(len(words)), "added")
        rows.append((i, "é some words before. " + " ".join(words) + "\nand after"))
        truth[i] = name
    rows.append((99, "nothing of this kind, although licensed under the sun"))
    got = ls.scan(documents(spark, rows)).collect()
    best = {}
    for r in sorted(got, key=lambda r: (r.matched, r.coverage)):
        best[r.doc_id] = r
    assert {i: r.template for i, r in best.items()} == truth
    for i, r in best.items():
        span = rows[i][1].encode()[r.start_byte : r.end_byte].decode()
        assert len(span.split()) >= 0.9 * (r.end - r.start) - 3 and r.coverage >= 0.8
        assert "before" not in span and "after" not in span.split()[-1:]


def test_every_place_is_a_row(spark):
    line = "Released under the MIT License."
    rows = [(1, f"{line} text {line}"), (1, line), (2, line.upper()), *EDGES]
    got = sorted((r.doc_id, r.start, r.end) for r in ls.scan(documents(spark, rows)).filter("template = 'mit-line'").collect())
    assert got == [(1, 0, 5), (1, 0, 5), (1, 6, 11), (2, 0, 5)]
    assert ls.scan(documents(spark, EDGES).limit(0)).collect() == []


def test_alignment_equals_full_dynamic_programme():
    draw = np.random.default_rng(10)
    for _ in range(40):
        text = draw.integers(0, 6, 20).astype(np.uint64)
        template = np.delete(text[4:14], draw.integers(0, 10, 2))
        best, score = 0, np.zeros((len(template) + 1, len(text) + 1), int)
        for i, a in enumerate(template, 1):
            for j, b in enumerate(text, 1):
                score[i, j] = max(0, score[i - 1, j - 1] + (2 if a == b else -1), score[i - 1, j] - 1, score[i, j - 1] - 1)
                best = max(best, score[i, j])
        matched, start, end = ls.align(template, text, 4, band=20)
        assert 2 * matched - (end - start - matched) <= best <= 2 * matched
        assert set(template.tolist()) & set(text[start:end].tolist())


def test_common_stretches_share_a_fingerprint():
    draw = np.random.default_rng(11)
    n = ls.GRAM + ls.SPAN - 1
    for _ in range(50):
        common = draw.integers(0, 2**60, n).astype(np.uint64)
        hashes = []
        for _ in range(2):
            text = np.concatenate([draw.integers(0, 2**60, 7).astype(np.uint64), common, draw.integers(0, 2**60, 5).astype(np.uint64)])
            hashes.append(set(ls.rolling_hashes(text, ls.GRAM)[ls.fingerprints(text, np.array([0, len(text)]))[0]].tolist()))
        assert hashes[0] & hashes[1]


def test_short_templates_have_a_fingerprint():
    index = ls.Index([("x", "X", "three word line"), ("y", "Y", "two words")])
    assert [m[:4] for m in index.matches(pa.array(["a three word line b", None, "two words"], pa.string()).fill_null(""), 0.8)] == [(0, 0, 3, 3)]


def test_one_word_changed_or_missing_at_any_place_of_short_templates():
    index = ls.Index(TEMPLATES)
    for t, (_, _, text) in enumerate(TEMPLATES):
        words = text.split()
        if not 5 <= len(words) < ls.FEW:
            continue
        for at in range(len(words)):
            for new in (["changed"], []):
                broken = "some before " + " ".join(words[:at] + new + words[at + 1 :]) + " and after"
                found = {(m[1], m[2]) for m in index.matches(pa.array([broken]), 0.8)}
                plain = len(ls.words_of(pa.array([text]), ls.PLAIN_SPACE, ls.PLAIN_LOWER).start)
                lost = len(ls.words_of(pa.array([words[at]]), ls.PLAIN_SPACE, ls.PLAIN_LOWER).start)
                if plain - lost >= 0.8 * plain:
                    assert any(m[0] == t and m[1] >= plain - lost for m in found), broken


def test_scan_equals_alignment_at_every_diagonal():
    draw = random.Random(12)
    index = ls.Index(TEMPLATES)
    sizes = np.diff(index.first)
    texts = []
    for _ in range(120):
        words = [draw.choice("the license of this work under released is a an mit by".split()) for _ in range(30)]
        own = draw.choice([t for t, n in zip(TEMPLATES, sizes, strict=True) if n < ls.FEW])[2].split()
        for at in draw.sample(range(len(own)), draw.randint(0, 3)):
            own[at] = draw.choice(["other", "the", ""])
        words[10:10] = own
        texts.append(" ".join(words))
    found = {(m[0], m[1]) for m in index.matches(pa.array(texts), 0.8)}
    expected = set()
    words = ls.words_of(pa.array(texts), ls.PLAIN_SPACE, ls.PLAIN_LOWER)
    hashes = ls.word_hashes(words)
    for i in range(len(texts)):
        text = hashes[words.first[i] : words.first[i + 1]]
        for t, n in enumerate(sizes):
            if n < ls.FEW:
                own = index.hashes[index.first[t] : index.first[t + 1]]
                if any(ls.align(own, text, d, int(n) // 2)[0] >= 0.8 * n for d in range(-int(n), len(text))):
                    expected.add((i, t))
    assert len(expected) > 40 and found == expected
