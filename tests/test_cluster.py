import math

import numpy as np
import pytest
from conftest import series_rows
from pyspark.sql import functions as F

from strandlab.operators import cluster, metrics, neighbours
from strandlab.plans import evaluate


def blobs(n=90, d=5, k=3, seed=0):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % k
    return rng.normal(size=(n, d)) + 6.0 * rng.normal(size=(k, d))[y], y


def labelled(spark, a, b):
    rows = [("d", int(x), int(y)) for x, y in zip(a, b)]
    return spark.createDataFrame(rows, "dataset_name string, label bigint, cluster bigint")


def pair_counts(a, b):
    n = len(a)
    tp = fp = fn = tn = 0
    for i in range(n):
        for j in range(i + 1, n):
            same_a, same_b = a[i] == a[j], b[i] == b[j]
            tp += same_a and same_b
            fn += same_a and not same_b
            fp += same_b and not same_a
            tn += not same_a and not same_b
    return tp, fp, fn, tn


def test_external_scores_brute_force(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 3, 40), rng.integers(0, 4, 40)
    got = metrics.external_scores(labelled(spark, a, b)).first()
    tp, fp, fn, tn = (float(v) for v in pair_counts(a, b))
    assert got["ari"] == pytest.approx(2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)))
    assert got["fmi"] == pytest.approx(math.sqrt(tp / (tp + fp)) * math.sqrt(tp / (tp + fn)))


@pytest.mark.parametrize(
    "a, b, scores",
    [
        ([0, 0, 1, 1, 2, 2], [5, 5, 3, 3, 4, 4], (1.0, 1.0, 1.0)),
        ([0, 0, 0, 0], [1, 1, 1, 1], (1.0, 1.0, 1.0)),
        ([0, 0, 0, 0], [0, 1, 2, 3], (0.0, 0.0, 0.0)),
    ],
)
def test_external_scores_edges(spark, a, b, scores):
    got = metrics.external_scores(labelled(spark, a, b)).first()
    assert (got["ari"], got["nmi"], got["fmi"]) == pytest.approx(scores)


def test_external_scores_ignore_names(spark):
    a = [0, 0, 1, 1, 2, 2, 2, 0]
    b = [0, 1, 1, 1, 2, 2, 0, 0]
    one = metrics.external_scores(labelled(spark, a, b)).first()
    two = metrics.external_scores(labelled(spark, a, [{0: 9, 1: 4, 2: 7}[x] for x in b])).first()
    assert tuple(one) == pytest.approx(tuple(two)) or one["ari"] == pytest.approx(two["ari"])


def test_macro_scores(spark):
    df = labelled(spark, [0, 0, 1, 2], [0, 1, 1, 3])
    got = metrics.macro_scores(df, predicted="cluster").first()
    assert got["accuracy"] == pytest.approx(0.5)
    assert got["precision"] == pytest.approx((1 + 0.5 + 0 + 0) / 4)
    assert got["recall"] == pytest.approx((0.5 + 1 + 0 + 0) / 4)
    assert got["f1"] == pytest.approx((2 / 3 + 2 / 3 + 0 + 0) / 4)


def test_internal_scores_brute_force(spark):
    x, y = blobs()
    df = series_rows(spark, x, y).withColumn("cluster", F.col("label"))
    got = metrics.centre_scores(df).first()
    m = x.mean(axis=0)
    groups = [x[y == c] for c in range(3)]
    between = sum(len(g) * ((g.mean(axis=0) - m) ** 2).sum() for g in groups)
    within = sum(((g - g.mean(axis=0)) ** 2).sum() for g in groups)
    assert got["chs"] == pytest.approx(between * (len(x) - 3) / (within * 2))
    s = [np.linalg.norm(g - g.mean(axis=0), axis=1).mean() for g in groups]
    c = [g.mean(axis=0) for g in groups]
    worst = [max((s[i] + s[j]) / np.linalg.norm(c[i] - c[j]) for j in range(3) if j != i) for i in range(3)]
    assert got["dbs"] == pytest.approx(np.mean(worst))


def test_internal_scores_edges(spark):
    same = series_rows(spark, [[1.0], [1.0], [2.0], [2.0]], [0, 0, 1, 1]).withColumn("cluster", F.col("label"))
    got = metrics.centre_scores(same).first()
    assert got["chs"] == 1.0 and got["dbs"] == 0.0
    single = series_rows(spark, [[1.0], [2.0]], [0, 0]).withColumn("cluster", F.col("label"))
    assert tuple(metrics.centre_scores(single).first())[1:] == (None, None)


@pytest.mark.parametrize("tile_rows", [7, 40, 1000])
def test_silhouette_brute_force(spark, tile_rows):
    x, y = blobs(n=61)
    y[0] = 9  # a cluster of one
    dist = np.linalg.norm(x[:, None] - x[None], axis=2)
    wanted = []
    for i in range(len(x)):
        own = (y == y[i]).sum()
        if own == 1:
            wanted.append(0.0)
            continue
        a = dist[i, y == y[i]].sum() / (own - 1)
        b = min(dist[i, y == c].mean() for c in set(y) if c != y[i])
        wanted.append((b - a) / max(a, b))
    df = series_rows(spark, x, y).withColumn("cluster", F.col("label"))
    got = {r["series_id"]: r["silhouette"] for r in neighbours.silhouette_rows(df, tile_rows).collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx(wanted)
    assert neighbours.silhouette_score(df, tile_rows).first()["ss"] == pytest.approx(np.mean(wanted))


def test_silhouettes_of_labelings_share_one_pass(spark):
    x, y = blobs(n=61)
    z = np.arange(61) % 4
    df = series_rows(spark, x, y)
    both = df.withColumn("clusters", F.array(F.col("label"), F.col("series_id") % 4))
    got = {r["labeling"]: r["ss"] for r in neighbours.silhouette_scores_of_labelings(both, tile_rows=16).collect()}
    for k, labels in enumerate((y, z)):
        one = series_rows(spark, x, labels).withColumn("cluster", F.col("label"))
        assert got[k] == pytest.approx(neighbours.silhouette_score(one).first()["ss"])


def test_tiles_hold_bytes_not_rows(spark):
    x, y = blobs(n=61)
    df = series_rows(spark, x, y).withColumn("cluster", F.col("label"))
    small = neighbours.distance_sums(df, tile_bytes=300).orderBy("series_id", "other").collect()
    whole = neighbours.distance_sums(df).orderBy("series_id", "other").collect()
    assert [r["series_id"] for r in small] == [r["series_id"] for r in whole]
    assert [r["total"] for r in small] == pytest.approx([r["total"] for r in whole])


def test_series_of_different_lengths_are_an_error(spark):
    df = spark.createDataFrame([("d", 1, 0, [1.0, 2.0, 3.0]), ("d", 2, 0, [1.0, 2.0, 3.0, 4.0, 5.0])], "dataset_name string, series_id bigint, label bigint, series array<double>")
    with pytest.raises(Exception, match="lists of one length without nulls in data set d: from 3 to 5"):
        neighbours.distance_sums(df.withColumn("cluster", F.col("label"))).collect()
    holed = spark.createDataFrame([("d", 1, 0, [1.0, 2.0]), ("d", 2, 0, None)], df.schema)
    with pytest.raises(Exception, match="1 null lists"):
        neighbours.distance_sums(holed.withColumn("cluster", F.col("label"))).collect()


def test_one_cluster_keeps_external_scores(spark):
    (x1, y1), (x2, y2) = blobs(seed=1), blobs(n=20, k=2, seed=2)
    df = series_rows(spark, x1, y1, "many").unionByName(series_rows(spark, x2, y2, "one"))
    clustered = df.withColumn("cluster", F.when(F.col("dataset_name") == "many", F.col("label")).otherwise(F.lit(0)))
    scores = evaluate.clustering_scores(clustered)
    got = {r["dataset_name"]: r for r in scores.collect()}
    assert got["one"]["ari"] is not None and got["one"]["chs"] is None and got["one"]["dbs"] is None and got["one"]["ss"] is None
    assert got["many"]["ss"] is not None
    assert [r["dataset_name"] for r in evaluate.one_cluster_datasets(scores).collect()] == ["one"]


def test_representations_are_scored_by_model_and_seed(spark):
    (x1, y1), (x2, y2) = blobs(seed=1), blobs(n=40, k=2, seed=2)
    one = series_rows(spark, x1, y1, "d").withColumns({"model_name": F.lit("a"), "encoder_name": F.lit(None).cast("string"), "seed": F.lit(1)})
    two = series_rows(spark, x2, y2, "d").withColumns({"model_name": F.lit("b"), "encoder_name": F.lit("e"), "seed": F.lit(2)})
    both = one.unionByName(two).withColumn("part", F.lit("test"))
    got, rejected = evaluate.evaluate_representations(both, restarts=5)
    rows = {(r["model_name"], r["encoder_name"], r["seed"]): r for r in got.collect()}
    assert set(rows) == {("a", None, 1), ("b", "e", 2)} and rejected.count() == 0
    for df, key in ((one, ("a", None, 1)), (two, ("b", "e", 2))):
        alone = evaluate.cluster_and_evaluate(df.withColumn("part", F.lit("test")), "representation", restarts=5)[0].first()
        assert rows[key]["n_classes"] == alone["n_classes"] and rows[key]["ari"] == pytest.approx(alone["ari"])


def two_sets(spark):
    (x1, y1), (x2, y2) = blobs(seed=1), blobs(n=50, k=2, seed=2)
    return series_rows(spark, x1, y1, "one").unionByName(series_rows(spark, x2, y2, "two"))


def test_kmeans_rounds_equal_local(spark):
    df = two_sets(spark)
    local = cluster.kmeans(df, restarts=4, seed=5, tasks=2).collect()
    # blocks of 600 bytes force the rounds over many blocks
    rounds = cluster.kmeans(df, restarts=4, seed=5, block_bytes=600).collect()
    key = lambda r: (r["dataset_name"], r["restart"])
    for a, b in zip(sorted(local, key=key), sorted(rounds, key=key), strict=True):
        assert key(a) == key(b)
        assert a["inertia"] == pytest.approx(b["inertia"])
        assert a["rounds"] == b["rounds"]
        assert np.array(a["centres"]) == pytest.approx(np.array(b["centres"]))


def test_kmeans_mixed_sizes(spark):
    df = two_sets(spark)
    fits = cluster.kmeans(df, restarts=3, block_bytes=90 * 5 * 8 - 1)  # one data set above, one below
    assert fits.count() == 6
    best = cluster.best_restart(fits).collect()
    assert {r["dataset_name"] for r in best} == {"one", "two"}


def test_kmeans_finds_blobs_and_cost_falls(spark):
    df = two_sets(spark)
    inertia = []
    for rounds in (0, 1, 2, 50):
        fits = cluster.kmeans(df, restarts=2, max_iter=rounds).orderBy("dataset_name", "restart").collect()
        inertia.append([r["inertia"] for r in fits])
    for before, after in zip(inertia, inertia[1:]):
        assert all(b <= a + 1e-9 for a, b in zip(before, after))
    best = cluster.best_restart(cluster.kmeans(df, restarts=10))
    scores = metrics.external_scores(cluster.cluster_rows(df, best)).collect()
    assert all(r["ari"] > 0.95 for r in scores)


def test_kmeans_does_not_depend_on_partitions(spark):
    df = two_sets(spark)
    seen = [sorted(r["inertia"] for r in cluster.kmeans(df.repartition(n), restarts=2, block_bytes=900).collect()) for n in (1, 5)]
    assert seen[0] == pytest.approx(seen[1])


def test_seeding_prefers_far_points(spark):
    x = np.zeros((40, 1))
    x[20:] = 100.0
    df = series_rows(spark, x, [0, 1] * 20)
    starts = cluster.kmeans(df, restarts=5, max_iter=0).collect()
    assert all(sorted(c[0] for c in r["centres"]) == [0.0, 100.0] for r in starts)


def test_cluster_and_evaluate(spark):
    broken = series_rows(spark, [[1.0, float("nan")], [1.0, 2.0]], [0, 1], "broken")
    skipped = series_rows(spark, [[1.0, 2.0], [5.0, 6.0]], [0, 1], "DodgerLoopDay")
    x, y = blobs(seed=4)
    df = series_rows(spark, x, y, "fine").unionByName(broken).unionByName(skipped)
    scores, rejected = evaluate.cluster_and_evaluate(df, "representation", restarts=5)
    rows = scores.collect()
    assert [r["dataset_name"] for r in rows] == ["fine"]
    assert rows[0]["n_classes"] == 3 and rows[0]["ari"] > 0.9
    assert [r["dataset_name"] for r in rejected.collect()] == ["broken"]


def test_raw_clustering_scores_on_series(spark):
    rng = np.random.default_rng(0)
    y = np.arange(40) % 2
    x = rng.normal(size=(40, 16)) + 8.0 * y[:, None]
    df = series_rows(spark, x, y, "r").withColumn("part", F.lit("test"))
    rows = evaluate.cluster_raw(df, [1, 3], restarts=3).orderBy("seed").collect()
    assert [r["seed"] for r in rows] == [1, 3]
    assert all(r["ari"] == pytest.approx(1.0) and r["n_features"] == 16 for r in rows)


def test_intervals_stay_inside(spark):
    sizes = spark.createDataFrame([("a", 1, 64), ("b", 1, 7)], "dataset_name string, n bigint, d bigint")
    rows = cluster.draw_intervals(sizes, 3).join(sizes, "dataset_name").collect()
    assert sum(r["dataset_name"] == "a" for r in rows) == 33
    for r in rows:
        assert 0 <= r["start"] and r["start"] + r["len"] <= r["d"] and r["len"] >= 2


@pytest.mark.parametrize("clusters", [4, 100])
def test_tile_sums_of_odd_vectors(clusters):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(50, 3)), rng.normal(size=(40, 3))
    x[3], x[5, 0], x[7, 1], x[9], x[11] = np.nan, np.inf, 1e200, x[10], x[10] + 1e-9
    y[0], y[1], y[4, 0], y[6, 1] = x[10], x[10] + 1e-7, np.inf, -np.inf
    x[20:], y[20:] = x[20:] + 1e6, y[20:] + 1e6  # far from the origin and from the others
    sides = [neighbours.Side(v, rng.integers(0, clusters, (len(v), 2))) for v in (x, y)]
    for a, b in (sides, (sides[0], sides[0])):
        with np.errstate(all="ignore"):
            dist = np.sqrt(((a.x[:, None] - b.x[None]) ** 2).sum(axis=2))
            found = neighbours._tile_sums(a, b)
        for sums, near, far in zip(found, (dist, dist.T), (b, a)):
            for k, (names, member) in enumerate(far.members):
                wanted = np.stack([near[:, member == c].sum(axis=1) for c in range(len(names))], axis=1)
                np.testing.assert_allclose(sums[k], wanted, rtol=1e-9)


def test_tiles_measure_each_distance_once(spark, monkeypatch):
    rng = np.random.default_rng(6)
    a, b = (neighbours.Side(rng.normal(size=(n, 4)), np.zeros((n, 1), int)) for n in (70, 90))
    measured, distances = [], neighbours._distances
    monkeypatch.setattr(neighbours, "CHUNK", 32)
    monkeypatch.setattr(neighbours, "_distances", lambda *args: measured.append(distances(*args).size) or distances(*args))
    both = neighbours._tile_sums(a, b)
    assert [s[0].shape for s in both] == [(70, 1), (90, 1)] and sum(measured) == 70 * 90
    assert both[0][0].sum() == pytest.approx(both[1][0].sum())


def test_rows_are_sent_to_few_lines_however_short_these_are_asked_for(spark, monkeypatch):
    """Every row goes to each line, so the rows sent are the lines."""
    x, y = blobs(n=61)
    df = series_rows(spark, x, y).withColumn("cluster", F.col("label"))
    sent = []
    real = neighbours.join_small
    monkeypatch.setattr(neighbours, "join_small", lambda df, small, *a, **k: sent.extend(r["_lines"] for r in small.collect()) or real(df, small, *a, **k))
    fine = neighbours.distance_sums(df, tile_rows=1).orderBy("series_id", "other").collect()
    whole = neighbours.distance_sums(df).orderBy("series_id", "other").collect()
    assert sent == [neighbours.FINE_LINES, 1]
    assert [r["total"] for r in fine] == pytest.approx([r["total"] for r in whole])
