"""Tournament results by stage, buy-in and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pokerlake.functions.labels import finish_stage
from pokerlake.functions.numbers import count_where, pct, rounded
from pokerlake.operators.ordered import SLICE_ROWS, running

# The first three places win 8, 6 and 4 times the prize part of the buy-in.
PLACE_PRIZE = {1: 8, 2: 6, 3: 4}


def tournament_results(tournaments: DataFrame) -> DataFrame:
    """Every tournament with stage, prize split and profit."""
    place = F.col("hero_position")
    share = F.coalesce(*[F.when(place == p, F.lit(times)) for p, times in PLACE_PRIZE.items()], F.lit(0))
    by_place = (F.col("buyin_prize") * share).cast("decimal(12,2)")
    profit = F.col("hero_prize") - F.col("buyin_total")
    return tournaments.withColumns(
        {
            "stage": finish_stage(place),
            "estimated_position_prize": by_place,
            "estimated_bounty_prize": F.col("hero_prize") - by_place,
            "profit": profit,
            "roi_pct": pct(profit, F.col("buyin_total")),
        }
    )


def tournament_analysis(tournaments: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Results with profit and buy-in accumulated over all tournaments in order of time."""
    results = tournament_results(tournaments)
    sums = {"cumulative_profit": F.col("profit"), "cumulative_buyin": F.col("buyin_total")}
    return running(results, [], ["started_at", "tournament_id"], sums, slice_rows=slice_rows)


def tournament_summary_by_stage(results: DataFrame) -> DataFrame:
    """Counts, shares and money per finishing stage."""
    by_stage = results.groupBy("stage").agg(
        F.count(F.lit(1)).alias("tournaments"),
        F.sum("buyin_total").alias("total_buyin"),
        F.sum("hero_prize").alias("total_prize"),
        F.sum("profit").alias("total_profit"),
        rounded(F.avg("profit"), 2).alias("avg_profit"),
        F.sum("estimated_position_prize").alias("total_position_prize"),
        F.sum("estimated_bounty_prize").alias("total_bounty_prize"),
        pct(F.sum("profit"), F.sum("buyin_total")).alias("roi_pct"),
    )
    # The window sees one row per stage.
    everything = F.sum("tournaments").over(Window.partitionBy())
    return by_stage.withColumn("pct_of_total", pct(F.col("tournaments"), everything))


def tournament_summary_by_buyin(results: DataFrame) -> DataFrame:
    """Where runs end and what they pay, per buy-in."""
    stage, bounty = F.col("stage"), F.col("estimated_bounty_prize")
    return results.groupBy("buyin_total").agg(
        F.count(F.lit(1)).alias("tournaments"),
        count_where(stage == "7_rush_bust").alias("rush_busts"),
        count_where(stage.isin("5_mid_final", "6_early_final")).alias("final_no_cash"),
        count_where(stage.isin("1_champion", "2_runner_up", "3_third")).alias("itm"),
        pct(count_where(F.col("hero_prize") > 0), F.count(F.lit(1))).alias("itm_rate"),
        F.sum("buyin_total").alias("total_buyin_sum"),
        F.sum("hero_prize").alias("total_prize"),
        F.sum("profit").alias("total_profit"),
        pct(F.sum("profit"), F.sum("buyin_total")).alias("roi_pct"),
        F.sum(bounty).alias("total_bounty_earned"),
        rounded(F.avg(F.when(bounty > 0, bounty)), 2).alias("avg_bounty_when_won"),
    ).withColumnRenamed("total_buyin_sum", "total_buyin")


def tournament_summary_daily(results: DataFrame) -> DataFrame:
    """Money and outcomes per day."""
    return results.groupBy(F.to_date("started_at").alias("play_date")).agg(
        F.count(F.lit(1)).alias("tournaments"),
        F.sum("buyin_total").alias("total_buyin"),
        F.sum("hero_prize").alias("total_prize"),
        F.sum("profit").alias("daily_profit"),
        pct(F.sum("profit"), F.sum("buyin_total")).alias("roi_pct"),
        F.max("profit").alias("best_result"),
        F.min("profit").alias("worst_result"),
        count_where(F.col("stage") == "7_rush_bust").alias("rush_busts"),
        count_where(F.col("hero_prize") > 0).alias("itm_count"),
    )
