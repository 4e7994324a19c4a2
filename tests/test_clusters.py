"""k-means over many starts: found centres, costs, and what it asks of the driver."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from pokerlake.plans.features import PLAYER_FEATURES
from pokerlake.plans.models import fit_clusters, k_search
from workload import models as queries

GROUPS = ((10.0, 5.0), (40.0, 9.0), (70.0, 30.0))


@pytest.fixture(scope="module")
def players(spark):
    """Three groups of 20 players, far apart."""
    rows = [(f"p{g}_{i}", *[low + (i * (j + 3)) % 7 / 10 if j % 2 else high + i % 5 / 10 for j in range(len(PLAYER_FEATURES))]) for g, (high, low) in enumerate(GROUPS) for i in range(20)]
    return spark.createDataFrame(rows, ["player_name", *PLAYER_FEATURES]).repartition(3, "player_name")


def test_clusters_are_the_groups(players):
    placed = fit_clusters(players, 3, starts=4).transform(players)
    found = {(r["player_name"][:2], r["cluster_id"]) for r in placed.select("player_name", "cluster_id").collect()}
    assert len(found) == 3 and len({c for _, c in found}) == 3


def test_cost_is_that_of_the_nearest_centre(players):
    model = fit_clusters(players, 3, starts=4)
    rows = np.array([r[0] for r in model.transform(players).select(vector_to_array("features")).collect()])
    gaps = ((rows[:, None, :] - np.array(model.stages[2].clusterCenters())) ** 2).sum(axis=2)
    search = {r["k"]: r for r in k_search(players, [2, 3], starts=4).collect()}
    assert search[3]["inertia"] == pytest.approx(gaps.min(axis=1).sum() * 60 / 59)
    assert search[3]["inertia"] < search[2]["inertia"] and search[3]["silhouette"] > 0.9


def test_fewer_different_rows_than_clusters(spark):
    rows = [(f"p{i}", *[float(i % 2 * 5)] * len(PLAYER_FEATURES)) for i in range(12)]
    model = fit_clusters(spark.createDataFrame(rows, ["player_name", *PLAYER_FEATURES]), 4, starts=2)
    assert len(model.stages[2].clusterCenters()) == 2


def test_starts_move_together(spark, players):
    """A chain of jobs for each of 20 starts takes several hundred jobs, whose traces fill the driver."""
    known = spark.sparkContext.statusTracker().getJobIdsForGroup
    before = set(known())
    k_search(players, [2, 3], starts=10).collect()
    assert len(set(known()) - before) < 100


def test_training_and_scoring_share_one_run_of_the_joins(spark, monkeypatch):
    runs = []

    def players(t):
        runs.append(t)
        columns = ", ".join(f"cast(id * {i + 2} AS double) AS {c}" for i, c in enumerate(PLAYER_FEATURES))
        return spark.range(30).selectExpr("cast(id AS string) AS player_name", "id AS total_hands", *columns.split(", "))

    monkeypatch.setattr(queries, "player_features", players)
    t = SimpleNamespace(spark=spark, sf_dir="made up")
    assert (queries.training(t).count(), queries.stored_players(t).count()) == (20, 30)
    assert len(runs) == 1
