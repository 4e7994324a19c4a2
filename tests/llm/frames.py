"""Small inputs with everything that a column may hold, and brute-force versions."""

from __future__ import annotations

import collections
import re

from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns of the input that have the names of columns the operators add or use inside.
CLASHES = "size string, shard string, key string, rep string, _score string, _contaminated string, block string, text_hash string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"


def documents(spark: SparkSession, rows: list[tuple], partitions: int = 3) -> DataFrame:
    """Rows of (doc_id, text[, lang[, source]])."""
    full = []
    for row in rows:
        row = (*row, *(None,) * (4 - len(row)))
        full.append((*row, len(row[1] or ""), *("x",) * 8))
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
EDGES = [
    (1, None, "en", "a"),
    (2, "", "en", None),
    (3, " \t\n ", None, "a"),
    (4, "one", "de", "a"),
    (5, LONG, "en", "a"),
    (6, "six little words stand right here", "fr", "b"),
    (7, "six little words stand right here", "fr", "b"),
    (7, "six little words stand right here", "fr", "b"),
    (None, "a row without an id but with text", "en", "b"),
    (8, "naïve “quotes” ÉCOLE 日本語 　 ▁ <s> <|endoftext|>\r\nnext  line ", "xx", "c"),
]


def components(ids: list, pairs: list[tuple]) -> dict:
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def weighted(text: str | None, n: int = 5) -> dict:
    """Weight of each run of words, as the near-duplicate operator defines it."""
    w = words(text)
    runs = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else ([tuple(w)] if w else [])
    return {r: 1 + (t.bit_length() - 1) for r, t in collections.Counter(runs).items()}


def probability_jaccard(a: dict, b: dict) -> float:
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())
