"""Merkle manifest of a table: a leaf per row, a tree per language, a tree over the languages.

``H`` is the lowercase hex SHA-256 of its inputs put together, digests as hex text. A leaf is
H of the columns ``doc_id, source, lang, n_chars, text``, each ``-`` if null and else its
length in UTF-8 bytes, a colon and its value. The leaves of a language ascend by ``doc_id``
(nulls first, equal ids by leaf). While several nodes remain, every two in a row become their
H, an odd last one its own H. What remains is the language's subroot; the subroots, by language
(null first, bytewise), are combined to the root in the same way.

Building. Leaves are numbered by sums over slices of their order. A tree is built in strides of
``STRIDE`` levels: ``2 ** STRIDE`` neighbours meet in one row, which holds the levels above them
up to one node. The next stride works on these nodes, a 256th of the rows. Each node of a
stride becomes a stored row that links to the node ``STRIDE`` levels up and holds the siblings
on the way (its own level and the levels between). A subroot links on into the tree of subroots.

Proving. A recursive query climbs from every leaf: its first part folds the (tampered) leaf
along its own row, each step joins the rows of the node reached, appends their siblings and
folds further, until a node without a parent. A tree of n leaves takes log(n) / STRIDE steps.

Digests travel as 32 bytes. Only the number of leaves of the largest tree, the number of trees
and the root pass through the driver. All rows of the input give a row, repeated ones too; null
ids have the leaf above and are never tampered with; an empty table gives no rows. Further
columns, whatever their names, do not count.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pokerlake.llm.common import stored
from pokerlake.llm.sharding import running

STRIDE = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Number of the tree over the subroots.
TOP = -1
ROWS_LIMIT = "spark.sql.cteRecursionRowLimit"


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    return digest(F.concat(*[field(changed.get(c, F.col(c))) for c in COLUMNS]))


def tampered_rows() -> Column:
    """Where 7 divides the CRC-32 of the id's decimal text."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, lang, leaf and ``changed``: the leaf with one more character counted, where ``tampered`` holds."""
    rows = docs.select(*COLUMNS, F.monotonically_increasing_id().alias("nr"))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", leaf().alias("leaf"), F.when(tampered, leaf(n_chars=F.col("n_chars") + 1)).alias("changed"), "nr")


def _depth(n: Column) -> Column:
    """Levels above the leaves of a tree with ``n`` leaves."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows with tree, depth and pos, and the number of trees."""
    langs = stored(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    trees = stored(running(langs, ["lang"], "n").select(F.col("lang").alias("_lang"), "n", F.col("place").alias("tree"), F.col("before").alias("_first")), "trees")
    # Equal rows differ in ``nr``, so that the order can be cut anywhere.
    placed = running(rows.withColumn("_one", F.lit(1)), ["lang", "doc_id", "leaf", "nr"], "_one")
    joined = placed.join(trees, F.col("lang").eqNullSafe(F.col("_lang")))
    return joined.select("doc_id", "leaf", "changed", "tree", _depth(F.col("n")).alias("depth"), (F.col("place") - F.col("_first")).alias("pos")), trees.count()


def _levels(first: Column, height: Column) -> Column:
    """The nodes above ``first`` (an array of digests), level by level, ``first`` in front."""

    def pair(below: Column):
        def of(i: Column) -> Column:
            return digest(F.concat(hexed(below[2 * i]), F.coalesce(hexed(F.get(below, 2 * i + 1)), F.lit(""))))

        return of

    def above(levels: Column, _: Column) -> Column:
        below = F.element_at(levels, -1)
        half = F.floor((F.size(below) - 1) / 2).cast("int")
        return F.concat(levels, F.array(F.transform(F.sequence(F.lit(0), half), pair(below))))

    steps = F.filter(F.sequence(F.lit(0), height), lambda i: i > 0)
    return F.aggregate(steps, F.array(first), above)


def stride(nodes: DataFrame, level: int) -> DataFrame:
    """Neighbours of ``nodes`` (tree, depth, pos, node with ``hash``) in one row, with the levels above them."""
    height = F.least(F.col("depth") - level, F.lit(STRIDE))
    blocks = nodes.groupBy("tree", "depth", F.shiftright("pos", STRIDE).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "node"))).alias("nodes"))
    blocks = stored(blocks.withColumn("height", height).withColumn("levels", _levels(F.transform("nodes", lambda x: x["node"]["hash"]), F.col("height"))), "blocks")
    return blocks.withColumn("top", F.element_at(F.element_at("levels", -1), 1))


def links(blocks: DataFrame, level: int, trees: int) -> DataFrame:
    """A row per node: its place, its node, the place of the parent (null above the root) and the siblings on the way."""
    rows = blocks.select("*", F.posexplode("nodes").alias("_at", "_node"))
    steps = F.filter(F.sequence(F.lit(0), F.col("height")), lambda i: i < F.col("height"))
    own = lambda i: F.floor(F.col("_at") / F.pow(F.lit(2), i)).cast("int")
    way = F.transform(
        steps,
        lambda i: F.struct(
            F.get(F.get("levels", i), F.when(own(i) % 2 == 1, own(i) - 1).otherwise(own(i) + 1)).alias("sibling"), (own(i) % 2 == 1).alias("left")
        ),
    )
    done = F.col("depth") - level <= F.col("height")
    lone = (F.col("tree") == TOP) | (F.lit(trees) == 1)

    def up(inside: Column, at_root: Column) -> Column:
        return F.when(~done, inside).when(~lone, at_root)

    return rows.select(
        "tree",
        F.lit(level).alias("level"),
        F.col("_node.pos").alias("pos"),
        F.col("_node.node").alias("node"),
        way.alias("way"),
        up(F.col("tree"), F.lit(TOP)).cast("long").alias("up_tree"),
        up(F.lit(level + STRIDE), F.lit(0)).cast("int").alias("up_level"),
        up(F.col("block"), F.col("tree")).cast("long").alias("up_pos"),
    )


def build(rows: DataFrame) -> tuple[DataFrame, DataFrame, str | None]:
    """(links of the leaves, links of all nodes above that a stride starts from, root)."""
    placed, trees = numbered(rows)
    if not trees:
        return None, None, None
    nodes = placed.select("tree", "depth", "pos", F.struct(F.col("leaf").alias("hash"), "changed", "doc_id").alias("node"))
    deepest = None
    low, upper, subroots, level = None, [], [], 0
    while True:
        blocks = stride(nodes, level)
        linked = links(blocks, level, trees)
        if low is None:
            low, deepest = linked, blocks.agg(F.max("depth")).first()[0]
        else:
            upper.append(linked)
        top = F.struct(F.col("top").alias("hash")).alias("node")
        subroots.append(blocks.filter(F.col("depth") - level <= STRIDE).select(F.col("tree").alias("pos"), top))
        level += STRIDE
        if level >= deepest:
            break
        nodes = blocks.filter(F.col("depth") > level).select("tree", "depth", F.col("block").alias("pos"), top)
    tops = subroots[0]
    for more in subroots[1:]:
        tops = tops.union(more)
    if trees == 1:
        return low, _union(upper, low), tops.select(hexed(F.col("node.hash"))).first()[0]
    nodes, level = tops.select(F.lit(TOP).cast("long").alias("tree"), _depth(F.lit(trees)).alias("depth"), "pos", "node"), 0
    while True:
        blocks = stride(nodes, level)
        upper.append(links(blocks, level, trees))
        level += STRIDE
        if trees <= 1 << level:
            return low, _union(upper, low), blocks.select(hexed(F.col("top"))).first()[0]
        nodes = blocks.select("tree", "depth", F.col("block").alias("pos"), F.struct(F.col("top").alias("hash")).alias("node"))


def _union(upper: list[DataFrame], low: DataFrame) -> DataFrame:
    """The rows above the leaves as one stored table."""
    plain = [u.withColumn("node", F.col("node.hash")) for u in upper] or [low.limit(0).withColumn("node", F.col("node.hash"))]
    out = plain[0]
    for more in plain[1:]:
        out = out.unionByName(more)
    return stored(out, "nodes")


CLIMB = """
    WITH RECURSIVE climb (doc_id, leaf, subroot, folded, siblings, tree, level, pos) AS (
        SELECT node.doc_id, node.hash, CAST(NULL AS BINARY), {fold_leaf}, {appended}, up_tree, up_level, up_pos
        FROM {leaves}
        UNION ALL
        SELECT c.doc_id, c.leaf, CASE WHEN n.tree = -1 AND n.level = 0 THEN n.node ELSE c.subroot END,
               {fold}, concat(c.siblings, {more}), n.up_tree, n.up_level, n.up_pos
        FROM climb c JOIN {nodes} n ON n.tree = c.tree AND n.level = c.level AND n.pos = c.pos)
    SELECT doc_id, leaf, subroot, folded, siblings FROM climb WHERE tree IS NULL"""


def _folded(way: str, start: str) -> str:
    """SQL that folds a digest with the siblings on the way."""
    mine, other = "lower(hex(h))", "lower(hex(s.sibling))"
    both = f"CASE WHEN s.sibling IS NULL THEN {mine} WHEN s.left THEN concat({other}, {mine}) ELSE concat({mine}, {other}) END"
    return f"aggregate({way}, {start}, (h, s) -> unhex(sha2({both}, 256)))"


def _appended(way: str) -> str:
    return f"transform(filter({way}, s -> s.sibling IS NOT NULL), s -> s.sibling)"


def climb(low: DataFrame, upper: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, folded (the folded root) and siblings of every leaf, as a stored table."""
    spark, tag = low.sparkSession, uuid4().hex[:12]
    views = {"leaves": f"merkle_leaves_{tag}", "nodes": f"merkle_nodes_{tag}"}
    low.createOrReplaceTempView(views["leaves"])
    upper.createOrReplaceTempView(views["nodes"])
    before = spark.conf.get(ROWS_LIMIT)
    spark.conf.set(ROWS_LIMIT, "-1")  # the default ends a climb of more than a million rows with an error
    try:
        text = CLIMB.format(fold_leaf=_folded("way", "coalesce(node.changed, node.hash)"), appended=_appended("way"), fold=_folded("n.way", "c.folded"), more=_appended("n.way"), **views)
        return stored(spark.sql(text), "proofs")
    finally:
        spark.conf.set(ROWS_LIMIT, before)
        for view in views.values():
            spark.catalog.dropTempView(view)


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    rows = stored(leaves(docs, F.lit(False) if tampered is None else tampered), "leaves")
    low, upper, root = build(rows)
    if root is None:
        return docs.sparkSession.createDataFrame([], PROOFS)
    found = climb(low, upper)
    proof = F.sha2(F.array_join(F.transform("siblings", hexed), "").cast("binary"), 256)
    return found.select(
        "doc_id", hexed(F.col("leaf")).alias("leaf"), F.coalesce(hexed(F.col("subroot")), F.lit(root)).alias("subroot"), F.lit(root).alias("root"),
        proof.alias("proof_sha256"), hexed(F.col("folded")).alias("folded_root"), (hexed(F.col("folded")) == root).alias("verified"),
    )
