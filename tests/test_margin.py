"""Margin machines against a general minimiser, and both ways to solve against each other."""

import numpy as np
import pyarrow as pa
import pytest
from conftest import series_rows
from pyspark.sql import functions as F

from strandlab.operators import blocks, classify, margin


def sample(n=120, d=4, k=3, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % k
    return rng.normal(size=(n, d)) + spread * rng.normal(size=(k, d))[y], y


def gradient(z, y, c, w):
    inside = y * (z @ w) < 1
    return margin._penalty(len(w)) * w - 2 * c * z[inside].T @ (y[inside] - z[inside] @ w)


def objective(z, y, c, w):
    return 0.5 * (margin._penalty(len(w)) * w * w).sum() + c * np.square(np.maximum(1 - y * (z @ w), 0)).sum()


@pytest.mark.parametrize("c", classify.C_GRID)
@pytest.mark.parametrize("spread, n", [(0.2, 60), (1.0, 200), (8.0, 90)])
def test_newton_ends_at_the_minimum(c, spread, n):
    x, label = sample(n, spread=spread)
    for features in (margin.Linear(), margin.Fourier(1, 40)):
        z = features(x, 0.3)
        y = margin._signs(label, 1)
        w, rounds = margin.minimise(z, y, c, np.zeros(z.shape[1]))
        scale = c * len(z) + 1.0
        assert np.abs(gradient(z, y, c, w)).max() < 1e-7 * scale and rounds < 100
        least = objective(z, y, c, w)
        rng = np.random.default_rng(2)
        for size in (1e-4, 1e-2, 1.0):
            assert all(objective(z, y, c, w + size * rng.normal(size=len(w))) >= least for _ in range(20))


def test_start_does_not_matter():
    x, label = sample(100)
    z, y = margin.Fourier(1, 30)(x, 0.3), margin._signs(label, 0)
    first = margin.minimise(z, y, 10.0, np.zeros(31))[0]
    other = margin.minimise(z, y, 10.0, np.random.default_rng(0).normal(size=31) * 5)[0]
    assert first == pytest.approx(other, abs=1e-7)


def table(spark):
    frames = []
    for name, n, d, k in (("a", 90, 3, 2), ("b", 150, 3, 4), ("c", 40, 5, 3), ("one", 12, 3, 1)):
        x, y = sample(n, d, k, seed=n)
        frames.append(series_rows(spark, x, y, name))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    part = F.when(F.col("series_id") % 10 < 5, "train").when(F.col("series_id") % 10 < 7, "valid").otherwise("test")
    return out.withColumn("part", part).repartition(3)


@pytest.mark.parametrize("features", [margin.Linear(), margin.Fourier(3, 24)])
@pytest.mark.parametrize("block_bytes, state_bytes", [(0, 1 << 20), (0, 2000), (5000, 1 << 20)])
def test_rounds_give_the_weights_of_the_block(spark, features, block_bytes, state_bytes):
    rows = table(spark)
    grid = rows.select("dataset_name").distinct().withColumn("c", F.explode(F.array(*[F.lit(c) for c in (0.01, 1.0, 100.0)])))
    ready = classify.prepared(rows, rows)
    name = lambda r: (r["dataset_name"], r["c"])
    local = {name(r): r for r in margin.fit_margin(ready, rows, grid, features).collect()}
    rounds = {name(r): r for r in margin.fit_margin(ready, rows, grid, features, block_bytes=block_bytes, state_bytes=state_bytes).collect()}
    assert set(local) == set(rounds) and len(local) == 12
    for k, r in local.items():
        assert rounds[k]["classes"] == r["classes"]
        assert np.array(rounds[k]["weights"]) == pytest.approx(np.array(r["weights"]), abs=1e-6)


def test_written_weights_have_no_gradient(spark):
    rows = table(spark)
    ready = classify.prepared(rows, rows)
    grid = rows.select("dataset_name").distinct().withColumn("c", F.explode(F.array(*[F.lit(c) for c in classify.C_GRID])))
    machines = margin.fit_margin(ready, rows, grid, margin.Fourier(3, 24), block_bytes=0).collect()
    assert max(m["rounds"] for m in machines) < 60
    held = {}
    for r in ready.collect():
        held.setdefault(r["dataset_name"], []).append((r["series"], r["label"], r["gamma"]))
    for m in machines:
        x, label, gamma = zip(*held[m["dataset_name"]])
        z = margin.Fourier(3, 24)(np.array(x), gamma[0])
        for k, w in zip(m["classes"], m["weights"]):
            y = margin._signs(np.array(label), k)
            assert np.abs(gradient(z, y, m["c"], np.array(w))).max() < 1e-6 * (1 + m["c"] * len(z))


def test_no_block_is_exploded(spark):
    """Rows are not moved for a prediction, and weights are sent once."""
    rows = table(spark)
    ready = classify.prepared(rows, rows)
    grid = rows.select("dataset_name").distinct().withColumn("c", F.lit(1.0))
    machines = margin.fit_margin(ready, rows, grid, margin.Linear())
    from strandlab.operators.blocks import dataset_sizes

    sizes = dataset_sizes(rows)
    sent = classify.predict(ready, sizes, machines, margin.Linear())
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "block" not in plan
    assert sent.count() == rows.count()


@pytest.mark.parametrize("state_bytes", [1 << 20, 0])
def test_rows_without_data_set_or_parameters_are_left_out(spark, state_bytes):
    rows = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "dataset_name string, series_id bigint").withColumn("series", F.array(F.lit(1.0)))
    given = spark.createDataFrame([("a", 10.0), (None, 20.0), ("c", 30.0)], "dataset_name string, w double")

    def add(name, table, fitted):
        if not (table.num_rows and fitted.num_rows):
            return pa.table({"name": pa.array([], pa.string()), "v": pa.array([], pa.float64())})
        return pa.table({"name": pa.array([name] * table.num_rows), "v": pa.array([fitted["w"][0].as_py()] * table.num_rows, pa.float64())})

    got = blocks.apply_with_parameters(rows, given, add, "name string, v double", state_bytes=state_bytes).collect()
    assert [tuple(r) for r in got] == [("a", 10.0)]


def test_empty_table(spark):
    rows = table(spark).where("false")
    grid = rows.select("dataset_name").withColumn("c", F.lit(1.0))
    assert margin.fit_margin(classify.prepared(rows, rows), rows, grid).collect() == []


def test_a_task_of_a_round_meets_few_data_sets(spark, monkeypatch):
    """Sums are sent per task and data set, so these pairs bound what a round shuffles."""
    rows = table(spark).repartition(16)
    grid = rows.select("dataset_name").distinct().withColumn("c", F.lit(1.0))
    pairs, real = [], margin.materialise

    def written(df, name, *args):
        if name == "margin-rows":
            pairs.extend(df.select(F.spark_partition_id().alias("task"), "dataset_name").distinct().collect())
        return real(df, name, *args)

    monkeypatch.setattr(margin, "materialise", written)
    machines = margin.fit_margin(classify.prepared(rows, rows), rows, grid, margin.Linear(), block_bytes=0).collect()
    tasks = spark.sparkContext.defaultParallelism
    assert len(machines) == 4 and {r["dataset_name"] for r in pairs} == {"a", "b", "c", "one"}
    assert len(pairs) <= tasks + 4 - 1 and len({r["task"] for r in pairs}) > 4
