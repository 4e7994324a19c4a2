"""Broadcast joins follow measured sizes."""

from pyspark.sql import functions as F

from workload.registry import runnable


def test_exploded_tables_are_not_broadcast_unseen(spark):
    """A guess of 3 MB stands for 2.4 million exploded rows here."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {name: spark.conf.get(name, None) for name in names}

    def joined(t):
        hands = t.spark.range(400_000).withColumn("seat", F.explode(F.array(*[F.lit(i) for i in range(6)])))
        return t.spark.range(3_000_000).join(hands, "id")

    try:
        planned = runnable(joined)(spark, "")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in planned
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
