"""Start points by hash keys, bounds of rows, and k-means in rounds against k-means in one place."""

import pathlib

import numpy as np
import pytest
from conftest import series_rows
from pyspark.sql import functions as F

from strandlab.operators import blocks, cluster, lloyd, seeding
from strandlab.operators.task_state import Sent
from strandlab.session import shared_folder


def blobs(n=90, d=5, k=3, seed=0, spread=6.0):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % k
    return rng.normal(size=(n, d)) + spread * rng.normal(size=(k, d))[y], y


def two_sets(spark):
    (x1, y1), (x2, y2) = blobs(n=140, k=5, seed=1, spread=1.0), blobs(n=50, k=2, seed=2)
    return series_rows(spark, x1, y1, "one").unionByName(series_rows(spark, x2, y2, "two")).repartition(3)


def by_restart(fits):
    return {(r["dataset_name"], r["restart"]): r for r in fits.collect()}


@pytest.mark.parametrize("how, block_bytes, state_bytes", [("oversampled", 600, 64 << 20), ("oversampled", 2000, 10_000), ("one_by_one", 600, 64 << 20)])
def test_rounds_give_the_centres_of_the_block(spark, how, block_bytes, state_bytes):
    df = two_sets(spark)
    local = by_restart(cluster.kmeans(df, restarts=4, seed=5, seeding=how))
    rounds = by_restart(cluster.kmeans(df, restarts=4, seed=5, seeding=how, block_bytes=block_bytes, state_bytes=state_bytes))
    assert set(local) == set(rounds) and len(local) == 8
    for at, a in local.items():
        b = rounds[at]
        assert a["rounds"] == b["rounds"] and a["inertia"] == pytest.approx(b["inertia"])
        assert np.array(a["centres"]) == pytest.approx(np.array(b["centres"]))


def test_start_points_of_few_different_rows(spark):
    df = series_rows(spark, [[0.0], [0.0], [0.0], [0.0], [7.0]], [0, 1, 2, 0, 1])
    for settings in ({}, {"block_bytes": 8}):
        fits = cluster.kmeans(df, restarts=3, max_iter=0, **settings).collect()
        assert all(len(r["centres"]) == 3 and {c[0] for c in r["centres"]} == {0.0, 7.0} for r in fits)


def test_a_draw_has_the_exact_probabilities():
    """A row wins with its share of the weights, and the second winner is a draw among the rest."""
    weight = np.array([1.0, 2.0, 3.0, 0.0, 4.0])
    ids, n = np.arange(5), 20_000
    first, second = np.zeros(5), np.zeros((5, 5))
    for restart in range(n):
        rows, _ = seeding.winners(ids, weight, 3, restart, 1, 2)
        first[rows[0]] += 1
        second[rows[0], rows[1]] += 1
        assert rows[0] == seeding.race(ids, weight, 3, restart, 1)[0]
    p = weight / weight.sum()
    assert first / n == pytest.approx(p, abs=4 * np.sqrt(0.25 / n))
    for i in (0, 1, 2, 4):
        rest = np.where(np.arange(5) == i, 0, weight)
        assert second[i] / first[i] == pytest.approx(rest / rest.sum(), abs=4 * np.sqrt(0.25 / first[i]))


def test_start_centres_are_squared_distance_draws():
    """With all rows as candidates of weight one, the second centre is drawn by the squared distance from the first."""
    x = np.array([[0.0], [1.0], [3.0], [6.0]])
    ids, n = np.arange(4), 20_000
    seen = np.zeros((4, 4))
    for restart in range(n):
        c = seeding.draw_among(x, ids, np.ones(4), 2, 1, restart)[:, 0]
        seen[np.flatnonzero(x[:, 0] == c[0])[0], np.flatnonzero(x[:, 0] == c[1])[0]] += 1
    assert seen.sum(axis=1) / n == pytest.approx(np.full(4, 0.25), abs=0.015)
    for i in range(4):
        d2 = ((x - x[i]) ** 2).sum(axis=1)
        assert seen[i] / seen[i].sum() == pytest.approx(d2 / d2.sum(), abs=0.03)


def test_oversampled_starts_are_as_good():
    x, _ = blobs(n=600, k=12, d=4, seed=3, spread=5.0)
    cost = {how: np.mean([lloyd.block_sums(x, start(x, np.arange(600), 12, 1, r))[2].sum() for r in range(40)]) for how, start in seeding.SEEDINGS.items()}
    assert cost["oversampled"] < 1.1 * cost["one_by_one"]


def test_start_reads_the_rows_a_fixed_number_of_times(spark, monkeypatch):
    calls = []
    grown = lloyd._grown
    monkeypatch.setattr(lloyd, "_grown", lambda *a, **k: (calls.append(1), grown(*a, **k))[1])
    for k in (3, 9):
        x, y = blobs(n=60, k=k)
        calls.clear()
        cluster.kmeans(series_rows(spark, x, y), restarts=2, max_iter=0, block_bytes=600).collect()
        assert len(calls) == seeding.ROUNDS + 1


@pytest.mark.parametrize("k, spread", [(1, 1.0), (2, 0.5), (7, 1.0), (12, 6.0)])
def test_skipped_rows_never_change(k, spread):
    """Rounds with gaps against rounds that measure all rows; most rows are skipped in the end."""
    x, _ = blobs(n=500, k=max(k, 3), seed=k, spread=spread)
    centres = x[:k].copy()
    owner, gap = lloyd.assign(x, centres)
    gap = gap.astype(np.float32)
    share = []
    for _ in range(40):
        n, means, _ = lloyd.block_sums(x, centres)
        moved = np.where(n[:, None] > 0, means, centres)
        drift = np.sqrt(((moved - centres) ** 2).sum(axis=1))
        centres = moved
        gap = gap - lloyd.used_gap(drift, owner)
        rows = np.flatnonzero(~(gap > 0))
        owner = owner.copy()
        owner[rows], gap[rows] = lloyd.assign(x[rows], centres) if len(rows) else (owner[rows], gap[rows])
        gap = np.nextafter(gap.astype(np.float32), np.float32(-np.inf))
        share.append(len(rows) / len(x))
        assert (owner == lloyd.assign(x, centres)[0]).all()
    assert np.mean(share[10:]) < 0.3


def test_shuffled_rows_of_a_round(spark):
    x, y = blobs(n=200, k=4, spread=0.5)
    df = series_rows(spark, x, y).repartition(3)
    settings = cluster.settings_of(df, 1e-4)
    blocks = lloyd.blocks_of(df, settings, 800)
    restarts, tasks = 5, blocks.rdd.getNumPartitions()
    state = [("d", r, x[r : r + 4].tolist(), [0.0] * 4) for r in range(restarts)]
    sent = Sent(spark, spark.createDataFrame(state, "dataset_name string, restart int, centres array<array<double>>, drift array<double>").toArrow())
    done = blocks.mapInArrow(lloyd._round(sent, "dataset_name"), f"dataset_name string, {lloyd._BLOCK}, {lloyd._SUM}")
    assert 0 < done.where("restart is not null").count() <= restarts * 4 * tasks
    assert done.where("restart is null").count() == blocks.count() > tasks
    assert done.groupBy("restart").agg(F.sum("n").alias("n")).where("restart is not null and n = 200").count() == restarts


def test_rounds_leave_only_their_result(spark):
    folder = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    x, y = blobs(n=60)
    fits = cluster.kmeans(series_rows(spark, x, y), restarts=3, block_bytes=600)
    left = sorted(p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before)
    assert fits.count() == 3 and set(left) <= {"kmeans-fit", "kmeans-settings", "small-side", "kmeans-start", "kmeans-candidates"}
    assert "kmeans-blocks" not in left and "kmeans-round" not in left


def test_more_restarts_than_tasks_hold(spark):
    x, y = blobs(n=60)
    df = series_rows(spark, x, y)
    assert by_restart(cluster.kmeans(df, restarts=5, block_bytes=600, state_bytes=1)).keys() == {("d", r) for r in range(5)}


def test_data_sets_beyond_a_block_need_no_rounds(spark, monkeypatch):
    def no_rounds(*args):
        raise AssertionError("a data set that a task can hold went through rounds")

    monkeypatch.setattr(cluster, "_fit_rounds", no_rounds)
    rng = np.random.default_rng(5)
    y = np.arange(4400) % 2
    x = rng.normal(size=(4400, 500)) + 3 * y[:, None]
    assert x.nbytes > blocks.BLOCK_BYTES
    fits = cluster.kmeans(series_rows(spark, x, y), restarts=1, max_iter=2).collect()
    assert len(fits) == 1
    truth = np.stack([x[y == c].mean(axis=0) for c in (0, 1)])
    found = np.array(sorted(fits[0]["centres"]))
    assert np.allclose(found, truth[truth[:, 0].argsort()])


def test_restarts_of_much_work_are_shared(spark, monkeypatch):
    rng = np.random.default_rng(6)
    y = np.arange(90) % 3
    df = series_rows(spark, rng.normal(size=(90, 5)) + y[:, None], y)
    alone = by_restart(cluster.kmeans(df, restarts=6, tasks=1))
    monkeypatch.setattr(cluster, "TASK_PRODUCTS", 2 * 90 * 5 * 3)
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 1)
    shared = by_restart(cluster.kmeans(df, restarts=6))
    assert shared.keys() == alone.keys() and len(alone) == 6
    for at, a in alone.items():
        assert a["rounds"] == shared[at]["rounds"] and a["inertia"] == pytest.approx(shared[at]["inertia"])


def test_start_points_by_chunks_of_rows(monkeypatch):
    rng = np.random.default_rng(7)
    x, ids = rng.normal(size=(400, 6)), np.arange(400)
    whole = {how: start(x, ids, 5, 1, 2) for how, start in seeding.SEEDINGS.items()}
    weights = seeding.weights_of(x, x[:7])
    monkeypatch.setattr(seeding, "BLOCK_BYTES", 33 * 6 * 8)
    assert len(list(seeding.chunks(x))) == 13
    assert np.array_equal(seeding.weights_of(x, x[:7]), weights) and weights.sum() == 400
    for how, start in seeding.SEEDINGS.items():
        assert np.array_equal(start(x, ids, 5, 1, 2), whole[how])
