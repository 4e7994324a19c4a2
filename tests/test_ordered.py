"""Split and plain plans give the same rows, also when one key holds most of them."""

import random
import sys

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pokerlake.operators.lists import list_parts, repeated_text
from pokerlake.operators.ordered import _sliced, first_per_key, lookback, running, slice_bounds
from pokerlake.plans.models import elbow, impute_median, medians, train_test, trim_outliers

SCHEMA = "id bigint, key string, at bigint, x bigint"


def rows(spark, n=500):
    rng = random.Random(11)
    data = [(i, rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.randrange(40), rng.choice([None, 1, 2, 5])) for i in range(n)]
    return spark.createDataFrame(data, SCHEMA)


def table(df):
    return sorted(tuple(r) for r in df.select("id", *[c for c in df.columns if c not in ("id", "key", "at", "x")]).collect())


def test_running_split_equals_plain(spark):
    df = rows(spark)
    upto = Window.partitionBy("key").orderBy("at", "id")
    frame = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain = df.withColumns({"total": F.sum("x").over(frame), "nr": F.row_number().over(upto), "n": F.count(F.lit(1)).over(Window.partitionBy("key"))})
    for size in (7, 60, 1_000_000):
        cut = running(df, ["key"], ["at", "id"], {"total": F.col("x")}, number="nr", total="n", slice_rows=size)
        assert table(plain) == table(cut)
        assert dict(cut.dtypes)["nr"] == dict(cut.dtypes)["n"] == "bigint"


def test_slices_are_bounded(spark):
    bounds = slice_bounds(rows(spark), ["at", "id"], 10, 1).first()[0]
    assert len(bounds) == 9 and bounds == sorted(bounds, key=lambda b: (b.at, b.id))
    slices = _sliced(rows(spark), ["at", "id"], 50).groupBy("_slice").count().collect()
    assert len(slices) == 10 and max(r["count"] for r in slices) <= 60
    assert slice_bounds(rows(spark).limit(0), ["at", "id"], 10, 1).first()[0] == []


def test_points_are_a_share_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr("pokerlake.operators.ordered.SAMPLE", 200)
    df = spark.range(20_000, numPartitions=16).withColumn("at", F.col("id") % 97)
    points = df.filter(F.pmod(F.xxhash64(F.struct("at", "id")), F.lit(100)) == 0).count()
    assert 150 < points < 250  # of all partitions together
    slices = _sliced(df, ["at", "id"], 1_000).groupBy("_slice").count().collect()
    assert len(slices) == 20 and max(r["count"] for r in slices) < 2_500


def test_the_input_is_evaluated_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def watched(x):
        seen.add(1)
        return x

    df = spark.range(300).select(watched("id").alias("id"), (F.col("id") % 3).alias("key"))
    running(df, ["key"], ["id"], {"total": F.col("id")}, number="nr", total="n", lags={"before": "id"}, slice_rows=40).collect()
    assert seen.value == 300


def test_previous_values_across_slices(spark):
    df = rows(spark)
    window = Window.partitionBy("key").orderBy("at", "id")
    plain = table(df.withColumn("before", F.lag("x").over(window)))
    for size in (1, 7, 60, 1_000_000):
        assert table(running(df, ["key"], ["at", "id"], lags={"before": "x"}, slice_rows=size)) == plain


def test_lookback_split_equals_plain(spark):
    df = rows(spark)
    args = (df, ["key"], ["at", "id"], {"before": "x"}, {"five": (F.col("x"), 5)})
    window = Window.partitionBy("key").orderBy("at", "id")
    plain = table(df.withColumns({"before": F.lag("x").over(window), "five": F.sum("x").over(window.rowsBetween(-5, -1))}))
    for block in (6, 50, 10_000):
        assert table(lookback(*args, block_rows=block, slice_rows=90)) == plain


def test_running_over_everything(spark):
    got = table(running(rows(spark), [], ["at", "id"], {"total": F.lit(1)}, number="nr"))
    assert sorted(r[1] for r in got) == list(range(1, 501)) and all(r[1] == r[2] for r in got)


def test_lists(spark):
    df = rows(spark).filter("key IS NOT NULL")
    own = df.collect()
    for size in (3, 10_000):
        parts = list_parts(df, ["key"], ["at", "id"], {"items": F.col("id"), "values": F.col("x")}, part_rows=size).collect()
        assert max(len(r.items) for r in parts) <= size
        for key in ("hot", "a", "b"):
            mine = sorted((r for r in parts if r.key == key), key=lambda r: r.part)
            order = sorted((r for r in own if r.key == key), key=lambda r: (r.at, r.id))
            assert [i for r in mine for i in r.items] == [r.id for r in order]
            assert [i for r in mine for i in r["values"]] == [r.x for r in order if r.x is not None]
        named = df.withColumn("x", F.col("x").cast("string"))
        texts = repeated_text(named, ["key"], "x", ",", part_rows=size).collect()
        for key in ("hot", "b"):
            mine = [r.text.split(",") for r in sorted((r for r in texts if r.key == key), key=lambda r: r.part)]
            assert all(len(p) <= size for p in mine)
            assert sum(mine, []) == sorted(str(r.x) for r in own if r.key == key and r.x is not None)


def test_rank_filter_reaches_below_the_shuffle(spark):
    plan = first_per_key(rows(spark), ["key"], ["at", "id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_medians(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, None), (10.0, 3.0), (4.0, 2.0), (None, None)], "a double, b double")
    for bins in (2, 3, 1_000):
        assert tuple(medians(df, ["a", "b"], bins).first()) == (3.0, 2.0)
    assert sorted(r.b for r in impute_median(df, ["a", "b"]).collect()) == [1.0, 2.0, 2.0, 2.0, 3.0]


def test_medians_by_bisection(spark):
    rng, nan, inf = random.Random(3), float("nan"), float("inf")
    columns = {
        "even": [float(x) for x in range(400)],
        "ties": [rng.choice([1.0, 2.0, 2.0, 5.0]) for _ in range(400)],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(400)],
        "close": [1 + i * 2.0**-52 for i in range(400)],
        "odd": [rng.choice([None, nan, 7.5, -3.0]) for _ in range(400)],
        "ends": [rng.choice([inf, -inf, 0.0]) for _ in range(399)] + [0.0],
        "none": [None] * 400,
        "same": [4.0] * 400,
    }
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"`{c}` double" for c in columns)).repartition(5)

    def middle(values):
        held = sorted(max(min(v, sys.float_info.max), -sys.float_info.max) for v in values if v is not None and v == v)
        return held[(len(held) - 1) // 2] / 2 + held[len(held) // 2] / 2 if held else None

    want = [middle(v) for v in columns.values()]
    for bins in (60, 4096):
        assert list(medians(df, list(columns), bins).first()) == want
    assert list(medians(df.limit(0), ["even"]).first()) == [None]
    with pytest.raises(ValueError):
        medians(df, ["even"], 1)


def test_elbow_and_outliers(spark):
    inertia = [100, 60, 40, 38, 37, 36, 35]
    search = spark.createDataFrame(list(zip(range(2, 9), map(float, inertia))), "k int, inertia double")
    # Bends are 20, 18, 1, 0, 0: the largest at k=2, so the next k.
    assert [r.k for r in elbow(search).collect() if r.is_chosen] == [3]
    assert [r.k for r in elbow(search, min_k=5).collect() if r.is_chosen] == [5]
    values = spark.createDataFrame([(float(v),) for v in [1] * 50 + [1000]], "v double")
    assert trim_outliers(values, "v").count() == 50


def test_split_of_training_rows_is_stable(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("hand_id"))
    train, test = train_test(df)
    again = train_test(df.repartition(7))[1]
    assert train.count() + test.count() == 5000 and 850 < test.count() < 1150
    assert test.exceptAll(again).count() == 0
