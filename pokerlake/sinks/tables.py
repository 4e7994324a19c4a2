"""Full refresh, insert-only merge and upsert over plain tables."""

from __future__ import annotations

import re
from urllib.parse import unquote
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pokerlake.functions.numbers import count_where, pct
from pokerlake.sinks.scratch import stored

UPSERT_PARTS = 64
ROWS_PER_PART = 2_000_000
PART = "_part"


def _save(df: DataFrame, name: str, mode: str, folder: str | None) -> None:
    """Write a table, in ``folder`` if one is given and in the warehouse otherwise."""
    writer = df.write.mode(mode)
    (writer.option("path", f"{folder}/{name}") if folder else writer).saveAsTable(name)


def _is_view(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType == "VIEW"


def overwrite_table(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Replace a table with its schema; the written table is returned."""
    if _is_view(df.sparkSession, name):
        df.sparkSession.sql(f"DROP VIEW {name}")
    _save(df, name, "overwrite", folder)
    return df.sparkSession.read.table(name)


def new_rows(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows whose key the target does not have."""
    return source.join(target.select(*keys), keys, "left_anti").select(*source.columns)


def insert_new_rows(
    spark: SparkSession, name: str, source: DataFrame, keys: list[str], folder: str | None = None
) -> DataFrame:
    """Append the rows with new keys, stamped ``created_at``; the table is created on the first run."""
    source = source.withColumn("created_at", F.current_timestamp())
    if spark.catalog.tableExists(name):
        added = new_rows(spark.read.table(name), source, keys)
        added.write.mode("append").saveAsTable(name)
    else:
        _save(source, name, "errorifexists", folder)
    spark.catalog.refreshTable(name)
    return spark.read.table(name)


def write_batch(spark: SparkSession, name: str, rows: DataFrame, batch: str, folder: str | None = None) -> DataFrame:
    """Put the rows of a batch into a table partitioned by ``batch``, in place of those it had before."""
    dealt = rows.withColumn("batch", F.lit(batch))
    if not spark.catalog.tableExists(name):
        writer = dealt.write.partitionBy("batch")
        (writer.option("path", f"{folder}/{name}") if folder else writer).saveAsTable(name)
    else:
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = spark.conf.get(mode)
        spark.conf.set(mode, "dynamic")
        try:
            dealt.select(*spark.read.table(name).columns).write.mode("overwrite").insertInto(name)
        finally:
            spark.conf.set(mode, before)
        spark.catalog.refreshTable(name)
    return spark.read.table(name)


def upserted(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows with the source rows put in their place or added."""
    kept = target.join(source.select(*keys), keys, "left_anti").select(*target.columns)
    return kept.unionByName(source)


def part_of(number: int, parts: int) -> int:
    """The part of a hash among ``parts``: a further part takes rows from one other part only."""
    whole = 1 << (parts - 1).bit_length()
    return number % whole if number % whole < parts else number % (whole // 2)


def _part(keys: list[str], parts: int) -> Column:
    """``part_of`` as a column."""
    whole, number = 1 << (parts - 1).bit_length(), F.xxhash64(*keys)
    wide = F.pmod(number, F.lit(whole))
    return F.when(wide < parts, wide).otherwise(F.pmod(number, F.lit(max(whole // 2, 1)))).cast("int")


def _properties(spark: SparkSession, name: str) -> dict[str, str]:
    return {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}


def _snapshot(spark: SparkSession, name: str) -> tuple[int, int]:
    """Number of the snapshot that readers of an upserted table see, and its parts; zeros if there is none."""
    if not spark.catalog.tableExists(name):
        return 0, 0
    held = _properties(spark, name)
    return int(held["snapshot"]), int(held["parts"])


def _folders(spark: SparkSession, snapshot: str) -> dict[int, str]:
    """Folder of each part of a snapshot."""
    found = (re.match(rf"(.*/{PART}=(\d+))/", file) for file in spark.read.table(snapshot).inputFiles())
    return {int(m[2]): unquote(m[1]) for m in found if m}


def _finish(spark: SparkSession, name: str) -> None:
    """Let readers see the snapshot that an upsert completed; may be repeated."""
    number = _snapshot(spark, name)[0] + 1
    following = f"{name}__{number}"
    if spark.catalog.tableExists(following):
        held = _properties(spark, following)
        if "parts" in held:
            columns = ", ".join(f"`{c}`" for c in spark.read.table(following).columns if c != PART)
            properties = f"'snapshot' = '{number}', 'parts' = '{held['parts']}'"
            spark.sql(f"CREATE OR REPLACE VIEW {name} TBLPROPERTIES ({properties}) AS SELECT {columns} FROM {following}")
        else:
            spark.sql(f"DROP TABLE {following}")


def drop_old_snapshots(spark: SparkSession, name: str, keep: int = 2) -> None:
    """Delete the parts of an upserted table that none of its last ``keep`` snapshots needs."""
    number, _ = _snapshot(spark, name)
    held = {}
    while spark.catalog.tableExists(f"{name}__{number - len(held)}"):  # older ones are gone
        held[number - len(held)] = f"{name}__{number - len(held)}"
    needed = {f for n, table in held.items() if n > number - keep for f in _folders(spark, table).values()}
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    for n, table in sorted(held.items()):
        if n <= number - keep:
            unneeded = set(_folders(spark, table).values()) - needed
            spark.sql(f"DROP TABLE {table}")  # first, so that a run that breaks off leaves no table without files
            for folder in unneeded:
                path(folder).getFileSystem(conf).delete(path(folder), True)


def upsert(
    spark: SparkSession,
    name: str,
    source: DataFrame,
    keys: list[str],
    folder: str | None = None,
    parts: int = UPSERT_PARTS,
    rows_per_part: int = ROWS_PER_PART,
) -> DataFrame:
    """Update by key; the table is returned.

    Rows lie in parts by a hash of the key, and only parts with keys of the source are
    written anew, next to the old ones. ``name`` is a view of the last snapshot, a table whose
    partitions are the new parts and the untouched old ones; it is switched when the
    snapshot is complete. So a reader sees the state before or after an upsert, a run that
    breaks off earlier has changed nothing, and one that breaks off before the switch is
    finished by the next. The snapshot before the last stays for those who still read it.

    The table begins with ``parts`` parts, more if its first rows need them. Beyond
    ``rows_per_part`` rows each it gets as many more as it needs, twice as many at most at a time; a new part takes rows from one old part,
    and only those parts are written as well.

    The source is written once and read from there. Keys that occur twice in it are refused.
    One upsert of a table may run at a time.
    """
    source = stored(source, "source")
    if not source.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError("a key occurs more than once in the source")
    _finish(spark, name)
    number, before = _snapshot(spark, name)
    place = f"{folder or spark.conf.get('spark.sql.warehouse.dir')}/{name}__parts/{uuid4().hex[:12]}"
    following, old = f"{name}__{number + 1}", {}
    if not number:
        parts = max(parts, -(-source.count() // rows_per_part))
    else:
        target = spark.read.table(f"{name}__{number}")
        parts = max(before, min(2 * before, -(-target.count() // rows_per_part)))
        numbers = [r[0] for r in source.select(_part(keys, before)).distinct().collect()]  # one per part at most
        touched = {*numbers, *(part_of(n, before) for n in range(before, parts))}
        old = {part: f for part, f in _folders(spark, f"{name}__{number}").items() if part not in touched}
        source = upserted(target.filter(F.col(PART).isin(*touched)).drop(PART), source, keys)
    dealt = source.withColumn(PART, _part(keys, parts))
    dealt.repartition(PART).write.partitionBy(PART).option("path", place).saveAsTable(following)
    if old:
        kept = " ".join(f"PARTITION ({PART} = {part}) LOCATION '{f}'" for part, f in old.items())
        spark.sql(f"ALTER TABLE {following} ADD {kept}")
    spark.sql(f"ALTER TABLE {following} SET TBLPROPERTIES ('parts' = '{parts}')")
    _finish(spark, name)
    drop_old_snapshots(spark, name)
    return spark.read.table(name)


def upsert_stream(stream: DataFrame, name: str, keys: list[str], checkpoint: str, folder: str | None = None):
    """Upsert every micro-batch of a stream; repeating a batch changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        upsert(batch.sparkSession, name, batch, keys, folder)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def match_report(mapping: DataFrame) -> DataFrame:
    """Counts and rate of a capture-to-hand mapping, in one pass."""
    linked = F.col("hand_id").isNotNull()

    def graded(grade: str) -> Column:
        return count_where(F.col("match_confidence") == grade)

    return mapping.agg(
        F.count(F.lit(1)).alias("total"),
        count_where(linked).alias("matched"),
        pct(count_where(linked), F.count(F.lit(1))).alias("matched_pct"),
        graded("high").alias("high"),
        graded("medium").alias("medium"),
        count_where(~linked).alias("without_hand"),
    )


def latest(df: DataFrame, n: int = 10, by: str = "ingested_at") -> DataFrame:
    """The n most recently ingested rows."""
    return df.orderBy(F.desc(by)).limit(n)
