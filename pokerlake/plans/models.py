"""Player clusters and hand-profit regression with Spark ML."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pokerlake.functions.labels import sample_confidence
from pokerlake.functions.numbers import pct, rounded
from pokerlake.operators.ordered import top
from pokerlake.plans.features import HAND_FEATURES, PLAYER_FEATURES
from pokerlake.sinks.scratch import stored

# Training settings of the two models.
MIN_HANDS = 10
MIN_K = 3
K_VALUES = range(2, 9)
SEED = 42
TREES, DEPTH, MIN_SPLIT = 100, 10, 20
# Fixed values of k-means: rows that starts are drawn from, most steps, and the move of a centre that ends them.
DRAWS, MOST_STEPS, TOLERANCE = 1024, 300, 1e-4
#: Bins of a pass that narrows a median.
BINS = 4096

# Cluster names, descriptions and advice against them.
PROFILES = {
    "TAG": ("Tight-Aggressive", "Respect their raises"),
    "Nit": ("Ultra-tight passive", "Steal blinds"),
    "LAG": ("Loose-Aggressive", "Call down lighter"),
    "Fish": ("Loose-Passive", "Value bet relentlessly"),
    "Maniac": ("High all-in frequency", "Tighten up, call with premiums"),
    "Reg": ("Balanced aggressive", "Play solid"),
    "Rec": ("Recreational player", "Standard play"),
}


def trainable(features: DataFrame, min_hands: int = MIN_HANDS) -> DataFrame:
    """Players with enough hands to train on."""
    return features.filter(F.col("total_hands") >= min_hands)


def medians(df: DataFrame, columns: list[str], bins: int = BINS) -> DataFrame:
    """Exact medians, one row with a column each; NULL for a column without values.

    The rank of a middle value is narrowed from the column's range to one bin of a histogram,
    from that bin's range to a bin of it, and so on until the bin holds one value only. A pass is
    one aggregation into ``bins`` rows per column and rank; no values are sorted or kept, and
    two numbers per column and rank pass through the driver. A range that spans orders of
    magnitude is cut on a logarithmic scale, so that a handful of passes do for any doubles. NaN counts as missing, infinite
    values as the largest finite ones.
    """
    if bins < 2:
        raise ValueError("a pass needs two bins to narrow anything")
    kept = stored(df.select(*[_finite(F.col(c)).alias(f"c{i}") for i, c in enumerate(columns)]), "values")
    ends = kept.agg(*[f(f"c{i}").alias(f"{f.__name__}{i}") for i in range(len(columns)) for f in (F.count, F.min, F.max)]).first()
    open_ranks, found = [], {}
    for i in range(len(columns)):
        n = ends[f"count{i}"]
        for rank in {(n + 1) // 2, (n + 2) // 2} if n else ():
            open_ranks.append((i, rank, ends[f"min{i}"], ends[f"max{i}"], 0))
    ranks = {i: [r for j, r, *_ in open_ranks if j == i] for i in range(len(columns))}
    while open_ranks:
        found |= {(i, rank): low for i, rank, low, high, _ in open_ranks if low == high}
        open_ranks = [x for x in open_ranks if x[2] < x[3]]
        if open_ranks:
            open_ranks = _narrowed(kept, open_ranks, bins)
    values = [sum(found[i, r] / len(ranks[i]) for r in ranks[i]) if ranks[i] else None for i in range(len(columns))]
    return df.sparkSession.createDataFrame([values], ", ".join(f"`{c}` double" for c in columns))


def _finite(value: Column) -> Column:
    value, largest = value.cast("double"), sys.float_info.max
    return F.when(value.isNotNull() & ~F.isnan(value), F.greatest(F.least(value, F.lit(largest)), F.lit(-largest)))


def _share(value: Column, low: float, high: float, bins: int) -> Column:
    """Place of the value between ``low`` (0) and ``high`` (1), rising, evenly or by its logarithm."""
    if low * high > 0 and max(low / high, high / low) <= bins:
        # Halves, so that the width of the whole range of doubles is finite.
        return (value / 2 - low / 2) / (high / 2 - low / 2)
    level = lambda x: math.copysign(math.log(abs(x)) + 750, x) if x else 0.0
    at = F.when(value == 0, 0.0).otherwise(F.signum(value) * (F.ln(F.abs(value)) + 750))
    return (at - level(low)) / (level(high) - level(low))


def _narrowed(kept: DataFrame, open_ranks: list[tuple], bins: int) -> list[tuple]:
    """One pass: (column, rank, low, high, rows below) for the bins that hold the ranks."""
    asked = []
    for nr, (i, rank, low, high, below) in enumerate(open_ranks):
        value = F.col(f"c{i}")
        bin_ = F.greatest(F.least(F.floor(_share(value, low, high, bins) * bins), F.lit(bins - 1)), F.lit(0)).cast("int")
        asked.append(F.when((value >= low) & (value <= high), F.struct(F.lit(nr).alias("nr"), bin_.alias("bin"), value.alias("value"))))
    hits = kept.select(F.explode(F.array_compact(F.array(*asked))).alias("x")).select("x.*")
    counted = hits.groupBy("nr", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    upto = F.sum("n").over(Window.partitionBy("nr").orderBy("bin"))  # at most ``bins`` rows each
    wanted = F.element_at(F.array(*[F.lit(rank - below) for _, rank, _, _, below in open_ranks]), F.col("nr") + 1)
    held = counted.withColumn("upto", upto).filter((F.col("upto") >= wanted) & (F.col("upto") - F.col("n") < wanted))
    rows = {r["nr"]: r for r in held.collect()}
    return [(i, rank, rows[nr]["low"], rows[nr]["high"], below + rows[nr]["upto"] - rows[nr]["n"]) for nr, (i, rank, _, _, below) in enumerate(open_ranks)]


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace NULLs by the exact median of the column."""
    found = medians(df, columns).select(F.struct(*columns)).scalar()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), found[c]) for c in columns})


def scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column less its mean, over its population standard deviation (1 if that is 0)."""
    moments = df.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.stddev_pop(c).alias(f"{c}_std") for c in columns]
    )

    def moment(name: str) -> Column:
        return moments.select(name).scalar()

    def score(c: str) -> Column:
        spread = moment(f"{c}_std")
        return (F.col(c) - moment(f"{c}_mean")) / F.when(spread == 0, F.lit(1.0)).otherwise(spread)

    return df.withColumns({f"{c}_scaled": score(c) for c in columns})


def _scaling_stages(columns: list[str]) -> list:
    return [
        VectorAssembler(inputCols=columns, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
    ]


def _first_centers(draws: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ over the drawn rows; fewer centres if fewer rows differ."""
    random = np.random.default_rng(seed)
    chosen = draws[[random.integers(len(draws))]]
    gaps = ((draws - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k and gaps.sum() > 0:
        chosen = np.vstack([chosen, draws[random.choice(len(draws), p=gaps / gaps.sum())]])
        gaps = np.minimum(gaps, ((draws - chosen[-1]) ** 2).sum(axis=1))
    return chosen


def _moved(rows: DataFrame, centers: dict[tuple, np.ndarray]) -> dict[tuple, tuple[np.ndarray, float]]:
    """One pass of Lloyd's for many models: each model's means of the rows next to its centres, and its cost before."""
    keys, now = list(centers), list(centers.values())
    width = now[0].shape[1]
    sums = [f"s{j}" for j in range(width)]

    def nearest(batches):
        totals = [np.zeros((len(c), width + 2)) for c in now]
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for c, total in zip(now, totals):
                gaps = ((x[:, None, :] - c) ** 2).sum(axis=2)
                near = gaps.argmin(axis=1)
                for j, weight in enumerate([np.ones(len(x)), gaps.min(axis=1), *x.T]):
                    total[:, j] += np.bincount(near, weights=weight, minlength=len(c))
        found = np.vstack([np.column_stack([np.full(len(t), i), np.arange(len(t)), t]) for i, t in enumerate(totals)])
        yield pa.RecordBatch.from_arrays([pa.array(column) for column in found.T], ["model", "center", "n", "cost", *sums])

    parts = rows.mapInArrow(nearest, ", ".join(f"{c} double" for c in ["model", "center", "n", "cost", *sums]))
    added = parts.groupBy("model", "center").agg(*[F.sum(c).alias(c) for c in ["n", "cost", *sums]])
    means, costs = [c.copy() for c in now], [0.0] * len(now)
    for row in added.collect():  # a row per centre
        i = int(row["model"])
        costs[i] += row["cost"]
        if row["n"]:
            means[i][int(row["center"])] = np.array([row[c] for c in sums]) / row["n"]
    return {key: (mean, cost) for key, mean, cost in zip(keys, means, costs)}


def _best_centers(points: DataFrame, ks: Iterable[int], starts: int) -> dict[int, tuple[np.ndarray, float]]:
    """For each k the centres of lowest cost among several random starts, and the cost.

    All starts of all k move together, a job per step that hands a row per centre to the driver, instead of
    a chain of jobs per start. A start is drawn by k-means++ from at most ``DRAWS`` different rows, those of smallest
    hash; every step goes over all rows, until no centre moves by more than ``TOLERANCE``.
    """
    rows = points.select(vector_to_array("features").alias("at"))
    drawn = rows.distinct().orderBy(F.xxhash64(F.lit(SEED), "at"), "at").limit(DRAWS)
    draws = np.array([r["at"] for r in drawn.collect()])
    moving = {(k, i): _first_centers(draws, k, SEED + i) for k in ks for i in range(starts)}
    ended: dict[tuple, tuple[np.ndarray, float]] = {}
    for _ in range(MOST_STEPS):
        moved = _moved(rows, moving)
        far = {key for key, (c, _) in moved.items() if (((c - moving[key]) ** 2).sum(axis=1) > TOLERANCE**2).any()}
        ended |= moved
        moving = {key: moved[key][0] for key in far}
        if not moving:
            break
    return {k: min((ended[k, i] for i in range(starts)), key=lambda x: x[1]) for k in {k for k, _ in ended}}


def _kmeans_model(spark: SparkSession, centers: np.ndarray, k: int) -> KMeansModel:
    """The centres as a model: fitted to them alone, so that each is a cluster of its own."""
    alone = spark.createDataFrame([(Vectors.dense(c),) for c in centers], ["features"]).coalesce(1)
    return KMeans(k=k, seed=SEED, featuresCol="features", predictionCol="cluster_id", initMode="random", maxIter=0).fit(alone)


def k_search(features: DataFrame, ks: Iterable[int] = K_VALUES, starts: int = 10) -> DataFrame:
    """Inertia and silhouette for each number of clusters; one row per k.

    The silhouette is the one of squared Euclidean distances, which needs no pairs of rows.
    """
    spark = features.sparkSession
    scaler = Pipeline(stages=_scaling_stages(PLAYER_FEATURES)).fit(features)
    points = scaler.transform(features).select("features").persist()
    try:
        n = points.count()
        # The scaler divides by the sample deviation; the cost is stated for the population one.
        to_population = n / (n - 1)
        evaluator = ClusteringEvaluator(featuresCol="features", predictionCol="cluster_id")
        rows = []
        for k, (centers, cost) in sorted(_best_centers(points, ks, starts).items()):
            silhouette = evaluator.evaluate(_kmeans_model(spark, centers, k).transform(points))
            rows.append((k, float(cost * to_population), silhouette))
    finally:
        points.unpersist()
    return spark.createDataFrame(rows, "k int, inertia double, silhouette double")


def elbow(search: DataFrame, min_k: int = MIN_K) -> DataFrame:
    """Mark the chosen k: the value after the largest bend of the inertia, at least ``min_k``.

    ``search`` holds one row per tried k, so the window over it is a few rows.
    """
    by_k = Window.orderBy("k")
    bend = F.abs(F.lead("inertia", 2).over(by_k) - 2 * F.lead("inertia", 1).over(by_k) + F.col("inertia"))
    bends = search.withColumns({"bend": bend, "next_k": F.lead("k", 1).over(by_k)})
    chosen = bends.agg(F.max_by("next_k", F.struct("bend", -F.col("k"))).alias("k"))
    return search.withColumn("is_chosen", F.col("k") == F.greatest(chosen.scalar(), F.lit(min_k)))


def elbow_k(search: DataFrame, min_k: int = MIN_K) -> int:
    return elbow(search, min_k).filter("is_chosen").first()["k"]


def fit_clusters(features: DataFrame, k: int, starts: int = 10) -> PipelineModel:
    """Scaling and k-means as one model that can be saved and loaded."""
    scaler = Pipeline(stages=_scaling_stages(PLAYER_FEATURES)).fit(features)
    points = scaler.transform(features).persist()
    try:
        centers, _ = _best_centers(points, [k], starts)[k]
    finally:
        points.unpersist()
    return PipelineModel([*scaler.stages, _kmeans_model(features.sparkSession, centers, k)])


def _parts(model: PipelineModel) -> tuple[StandardScalerModel, KMeansModel]:
    return model.stages[1], model.stages[2]


def _centers(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """cluster_id, the scaled centre and the centre in the units of the features; k rows."""
    scaler, kmeans = _parts(model)
    mean, std = scaler.mean.toArray(), scaler.std.toArray()
    rows = [
        (i, [float(x) for x in center], *[float(x) for x in center * std + mean])
        for i, center in enumerate(kmeans.clusterCenters())
    ]
    names = ", ".join(f"{c} double" for c in PLAYER_FEATURES)
    return spark.createDataFrame(rows, f"cluster_id int, center array<double>, {names}")


def name_clusters(centroids: DataFrame) -> DataFrame:
    """Add name, description and strategy from the rank of each centroid among all.

    A rank is the share of centroids strictly below; the windows see one row per cluster.
    """

    def rank(column: str) -> Column:
        below = F.count(F.lit(1)).over(
            Window.orderBy(column).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        ) - F.count(F.lit(1)).over(Window.partitionBy(column))
        return below / F.count(F.lit(1)).over(Window.partitionBy())

    vpip, pfr, factor, allin = (rank(c) for c in ("vpip_pct", "pfr_pct", "aggression_factor", "allin_pct"))
    tight, loose = vpip < 0.3, vpip > 0.7
    aggressive = (factor > 0.6) | (pfr > 0.6)
    passive = (factor < 0.4) & (pfr < 0.4)
    name = (
        F.when(tight & aggressive, "TAG")
        .when(tight & passive, "Nit")
        .when(loose & aggressive, "LAG")
        .when(loose & passive, "Fish")
        .when(allin > 0.7, "Maniac")
        .when(aggressive, "Reg")
        .otherwise("Rec")
    )

    def lookup(i: int) -> Column:
        pairs = F.create_map(*[F.lit(x) for k, v in PROFILES.items() for x in (k, v[i])])
        return F.try_element_at(pairs, F.col("cluster_name"))

    named = centroids.withColumn("cluster_name", name)
    return named.withColumns({"cluster_description": lookup(0), "strategy_vs": lookup(1)})


def cluster_definitions(model: PipelineModel, features: DataFrame, model_version: str = "1") -> DataFrame:
    """Name, centroid, size and share of each cluster of the training players."""
    centroids = _centers(features.sparkSession, model).drop("center")
    return definitions_of(centroids, model.transform(features).select("cluster_id"), model_version)


def definitions_of(centroids: DataFrame, assigned: DataFrame, model_version: str = "1") -> DataFrame:
    """The definitions table of given centroids (one row each) and assignments."""
    sizes = assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).cast("int").alias("player_count"))
    everyone = F.sum("player_count").over(Window.partitionBy())
    short = {
        "vpip_pct": "vpip", "pfr_pct": "pfr", "three_bet_pct": "three_bet", "aggression_factor": "af",
        "wtsd_pct": "wtsd", "wsd_pct": "wsd", "allin_pct": "allin",
    }
    named = name_clusters(centroids)
    return (
        named.join(sizes, "cluster_id", "left")
        .withColumn("player_count", F.coalesce("player_count", F.lit(0)))
        .select(
            "cluster_id", "cluster_name", "cluster_description", "strategy_vs",
            *[F.col(c).alias(f"centroid_{s}") for c, s in short.items()],
            "player_count",
            pct(F.col("player_count"), everyone).alias("pct_of_total"),
            F.lit(model_version).alias("model_version"),
            F.current_timestamp().alias("created_at"),
        )
    )


def score_players(
    model: PipelineModel, features: DataFrame, definitions: DataFrame, training_rows: int, model_version: str = "1"
) -> DataFrame:
    """Every player with cluster, distance to its centre, labels and confidence.

    Centres and definitions hold one row per cluster and are broadcast. The distance is
    stated in population standard deviations of the training data.
    """
    spark = features.sparkSession
    scored = model.transform(impute_median(features, PLAYER_FEATURES))
    centers = _centers(spark, model).select("cluster_id", "center")
    own = definitions.filter(F.col("model_version") == model_version)  # one row per cluster
    labels = own.select("cluster_id", "cluster_name", "cluster_description", "strategy_vs")
    squares = F.zip_with(vector_to_array("features"), "center", lambda a, b: (a - b) * (a - b))
    distance = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))
    to_population = (training_rows / (training_rows - 1)) ** 0.5
    return (
        scored.join(F.broadcast(centers), "cluster_id")
        .join(F.broadcast(labels), "cluster_id")
        .select(
            "player_name", "total_hands", "cluster_id",
            (distance * to_population).alias("distance_to_centroid"),
            "cluster_name", "cluster_description", "strategy_vs",
            sample_confidence(F.col("total_hands")).alias("confidence"),
            F.lit(model_version).alias("model_version"),
            F.current_timestamp().alias("scored_at"),
        )
    )


def cluster_overview(scored: DataFrame) -> DataFrame:
    """Players, mean hands and high-confidence players per cluster name."""
    return scored.groupBy("cluster_name").agg(
        F.count(F.lit(1)).alias("players"),
        rounded(F.avg("total_hands"), 0).alias("avg_hands"),
        F.count_if(F.col("confidence") == "high").alias("high_confidence"),
    )


def trim_outliers(df: DataFrame, column: str, deviations: float = 3.0) -> DataFrame:
    """Rows strictly within so many sample deviations of the mean."""
    stats = df.agg(F.avg(column).alias("mean"), (F.stddev_samp(column) * deviations).alias("reach"))
    mean, reach = stats.select("mean").scalar(), stats.select("reach").scalar()
    return df.filter((F.col(column) > mean - reach) & (F.col(column) < mean + reach))


def train_test(df: DataFrame, key: str = "hand_id", test_share: float = 0.2, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Split by a hash of the key: the same rows on every run and on any partitioning."""
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(10_000))
    is_test = bucket < int(test_share * 10_000)
    return df.filter(~is_test), df.filter(is_test)


def _ready(features: DataFrame) -> DataFrame:
    """Copies of the features for the model, 0 where one is missing; the features stay as they are."""
    return features.withColumns({f"_in_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in HAND_FEATURES})


def fit_ev(train: DataFrame, trees: int = TREES, depth: int = DEPTH) -> PipelineModel:
    """Random forest of the profit of a hand; saved and loaded like any pipeline model.

    Half the minimum split size stands in for it as the minimum leaf size. Trees do not
    depend on the scale of a feature, so there is no scaling stage.
    """
    forest = RandomForestRegressor(
        featuresCol="raw", labelCol="profit_bb", predictionCol="predicted_ev_bb",
        numTrees=trees, maxDepth=depth, minInstancesPerNode=MIN_SPLIT // 2, seed=SEED,
    )
    stages = [VectorAssembler(inputCols=[f"_in_{c}" for c in HAND_FEATURES], outputCol="raw"), forest]
    return Pipeline(stages=stages).fit(_ready(train).fillna(0.0, subset=["profit_bb"]))


def predict_ev(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Features as they are with the predicted profit; for the model missing values count as 0."""
    return model.transform(_ready(features)).drop("raw", *[f"_in_{c}" for c in HAND_FEATURES])


def score_hands(model: PipelineModel, features: DataFrame) -> DataFrame:
    """The predictions table."""
    return predict_ev(model, features).select(
        "hand_id", "high_card_rank", "low_card_rank", "is_suited", "is_pocket_pair", "hand_strength_score",
        "is_final_stage", "position_encoded", "is_late_position", "stack_bb", "opponent_count", "predicted_ev_bb",
        "profit_bb", "won_hand", "feature_timestamp",
    )


def same_direction(predicted: Column, actual: Column) -> Column:
    """Share of rows where both are above zero or both are not."""
    return F.avg(((predicted > 0) == (actual > 0)).cast("double"))


def regression_report(scored: DataFrame, label: str = "profit_bb", prediction: str = "predicted_ev_bb") -> DataFrame:
    """MAE, RMSE, R² and directional accuracy in one pass."""
    y, p = F.col(label), F.col(prediction)
    error = p - y
    return scored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.try_divide(F.sum(error * error), F.var_pop(y) * F.count(y))).alias("r2"),
        same_direction(p, y).alias("directional_accuracy"),
    )


def importances(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """Weight of each feature in the forest."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(w)) for name, w in zip(HAND_FEATURES, weights)]
    return spark.createDataFrame(rows, "feature string, importance double")


def ev_report(scored: DataFrame) -> DataFrame:
    """Agreement of predicted and actual profit."""
    y, p = F.col("profit_bb"), F.col("predicted_ev_bb")
    return scored.agg(F.corr(y, p).alias("correlation"), same_direction(p, y).alias("directional_accuracy"))


def best_spots(scored: DataFrame, n: int = 10) -> DataFrame:
    return top(scored, [F.desc("predicted_ev_bb"), "hand_id"], n)


def worst_spots(scored: DataFrame, n: int = 10) -> DataFrame:
    return top(scored, [F.asc("predicted_ev_bb"), "hand_id"], n)


def ev_by_situation(scored: DataFrame) -> DataFrame:
    """Mean, spread and count of the prediction and mean profit, by stage and late position."""
    return scored.groupBy("is_final_stage", "is_late_position").agg(
        rounded(F.avg("predicted_ev_bb"), 2).alias("predicted_mean"),
        rounded(F.stddev_samp("predicted_ev_bb"), 2).alias("predicted_std"),
        F.count("predicted_ev_bb").alias("hands"),
        rounded(F.avg("profit_bb"), 2).alias("profit_mean"),
    )


def ev_by_position(scored: DataFrame) -> DataFrame:
    """Mean prediction and profit by stage and position group."""
    places = F.array(*map(F.lit, ["Early", "Middle", "Late", "Blinds"]))
    return scored.groupBy(
        F.when(F.col("is_final_stage") == 1, "Final").otherwise("Rush").alias("stage_name"),
        F.get(places, F.col("position_encoded").cast("int")).alias("position_name"),
    ).agg(
        rounded(F.avg("predicted_ev_bb"), 2).alias("predicted_profit_bb"),
        rounded(F.avg("profit_bb"), 2).alias("actual_profit_bb"),
    )
