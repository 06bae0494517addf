import math
from collections import Counter

import numpy as np
import pytest
from conftest import series_rows
from pyspark.sql import functions as F

from strandlab.operators import batches, ordering, prep, scaling, split, stats


def expected_quotas(counts, share):
    n = sum(counts.values())
    n_train = n - math.ceil(share * n)
    base = {c: v * n_train // n for c, v in counts.items()}
    rest = sorted(counts, key=lambda c: (-(counts[c] * n_train % n), c))
    for c in rest[: n_train - sum(base.values())]:
        base[c] += 1
    return base


@pytest.mark.parametrize("share", [0.5, 0.35, 0.1])
def test_split_sizes(spark, share):
    labels = [0] * 17 + [1] * 5 + [2] * 9 + [3] * 1
    df = series_rows(spark, [[0.0]] * len(labels), labels)
    rows = split.stratified_split(df, share).collect()
    assert sum(r["part"] == "test" for r in rows) == math.ceil(share * len(labels))
    train = Counter(r["label"] for r in rows if r["part"] == "train")
    wanted = expected_quotas(Counter(labels), share)
    assert {c: train.get(c, 0) for c in wanted} == wanted


def test_split_does_not_depend_on_partitions(spark):
    df = series_rows(spark, [[0.0]] * 60, [i % 3 for i in range(60)])
    seen = set()
    for n in (1, 4, 16):
        parts = split.split_parts(df.repartition(n)).select("series_id", "part").collect()
        seen.add(tuple(sorted((r["series_id"], r["part"]) for r in parts)))
    assert len(seen) == 1
    assert {p for _, p in next(iter(seen))} == {"train", "valid", "test"}


def test_split_strategy_errors(spark):
    df = series_rows(spark, [[0.0]] * 4, [0, 0, 1, 1])
    with pytest.raises(ValueError):
        split.split_parts(df, strategy="other")


def test_singletons(spark):
    df = series_rows(spark, [[0.0]] * 5, [0, 0, 1, 2, 2])
    assert sorted(r["label"] for r in prep.drop_singleton_classes(df).collect()) == [0, 0, 2, 2]


def test_reject_missing(spark):
    good = series_rows(spark, [[1.0, 2.0]], [0], "good")
    bad = series_rows(spark, [[1.0, float("nan")], [1.0, 2.0]], [0, 1], "bad")
    kept, report = prep.reject_missing(good.unionByName(bad))
    assert [r["dataset_name"] for r in kept.collect()] == ["good"]
    assert [tuple(r) for r in report.collect()] == [("bad", 1, 2)]


def test_skip_and_parts(spark):
    df = spark.createDataFrame([("GunPoint", "test"), ("DodgerLoopDay", "test"), ("GunPoint", "train")], "dataset_name string, part string")
    assert prep.skip_datasets(df, prep.SKIPPED_DATASETS).count() == 2
    assert prep.skip_datasets(df, []).count() == 3
    assert prep.clustering_parts(df, "raw").count() == 2
    assert prep.clustering_parts(df, "representation").count() == 3
    with pytest.raises(ValueError):
        prep.clustering_parts(df, "other")


def test_column_order():
    assert prep.column_order(["c", "b", "a", "raw"], ["raw", "x", "b"]) == ["raw", "b", "a", "c"]


def test_row_numbers_with_one_hot_group(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), "id"
    )
    got = ordering.number_rows(df, ["g"], ["id"], F.floor(F.col("id") / 64)).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["g"], []).append((r["row_no"], r["id"]))
    for rows in groups.values():
        rows.sort()
        assert [n for n, _ in rows] == list(range(1, len(rows) + 1))
        assert [i for _, i in rows] == sorted(i for _, i in rows)


def test_group_median(spark):
    values = {"a": [3.0, 1.0, 2.0], "b": [1.0, 1.0, 5.0, 9.0], "c": [7.0], None: [2.0, 4.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "g string, v double")
    got = {r["g"]: r["median"] for r in ordering.group_median(df, ["g"], "v").collect()}
    assert got == {"a": 2.0, "b": 3.0, "c": 7.0, None: 3.0}


@pytest.mark.parametrize("broadcast", [1 << 25, -1])
def test_group_quantiles(spark, monkeypatch, broadcast):
    """A hot group with a hot value, a small one, one value, ties and the null group; by broadcast and by salts."""
    monkeypatch.setattr(ordering, "BROADCAST_BYTES", broadcast)
    rng = np.random.default_rng(0)
    hot = np.concatenate([np.full(9000, 0.25), rng.normal(size=21_000)])
    values = {"hot": hot, "few": rng.normal(size=41), "one": [7.0], "tied": [1.0] * 5 + [2.0] * 4, None: [2.0, 4.0, 9.0]}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("one", None), ("few", float("nan")), ("none", None), ("none", float("nan"))], "g string, v double").repartition(4)
    shares = [0.0, 0.001, 0.1, 0.25, 0.5, 0.9, 0.995, 1.0]
    got = {r["g"]: r["quantiles"] for r in ordering.group_quantiles(df, ["g"], "v", shares).collect()}
    assert got.pop("none") in (None, [])
    assert set(got) == set(values)
    for k, vs in values.items():
        assert got[k] == pytest.approx(list(np.quantile(vs, shares)))
    medians = {r["g"]: r["median"] for r in ordering.group_median(df.where("NOT isnan(v)"), ["g"], "v").collect()}
    assert all(medians[k] == pytest.approx(np.median(vs)) for k, vs in values.items())


def test_five_numbers_keep_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    got = {r["g"]: (r["median"], r["mean"], r["std"], r["min"], r["max"]) for r in stats.five_numbers(df, ["g"], "v").collect()}
    assert got == {None: (2.0, 2.0, 1.0, 1.0, 3.0), "a": (5.0, 5.0, 0.0, 5.0, 5.0)}


def test_scaling_constants(spark):
    train = series_rows(spark, [[1.0, 5.0], [3.0, 5.0]], [0, 1])
    fit = scaling.step_ranges(train)
    new = series_rows(spark, [[5.0, 6.0]], [0])
    assert scaling.scale_steps(new, fit, -1.0, 1.0).first()["series"] == [3.0, 1.0]  # no clipping, constant step
    assert scaling.scale_steps(train, fit).orderBy("series_id").first()["series"] == [0.0, 0.0]
    moments = scaling.step_moments(train)
    assert scaling.standardise_steps(train, moments).orderBy("series_id").first()["series"] == [-1.0, 0.0]


def test_normaliser_off_and_without_valid(spark):
    df = series_rows(spark, [[1.0], [3.0], [2.0]], [0, 0, 0]).withColumn(
        "part", F.when(F.col("series_id") < 2, "train").otherwise("test")
    )
    assert scaling.make_normaliser(enabled=False)(df).collect() == df.collect()
    got = {r["series_id"]: r["series"] for r in scaling.make_normaliser()(df).collect()}
    assert got == {0: [0.0], 1: [1.0], 2: [0.5]}


def test_nested_scaling(spark):
    rows = [("d", i, "train", [[float(i), 1.0], [float(i + 1), 3.0]]) for i in range(3)]
    df = spark.createDataFrame(rows, "dataset_name string, series_id bigint, part string, steps array<array<double>>")
    got = scaling.make_normaliser(nested=True)(df).orderBy("series_id").first()["steps"]
    assert got == [[0.0, 0.0], [pytest.approx(1 / 3), 1.0]]


def test_padding(spark):
    df = series_rows(spark, [[0.0]] * 10, [0] * 10)
    rows = batches.pad_last_batch(batches.with_batches(batches.in_order(df))).collect()
    sizes = Counter(r["batch_id"] for r in rows)
    assert sizes == {0: 8, 1: 8}
    assert Counter(r["series_id"] for r in rows)[9] == 7


def test_full_batches_are_not_padded(spark):
    df = series_rows(spark, [[0.0]] * 16, [0] * 16)
    assert batches.pad_last_batch(batches.with_batches(batches.in_order(df))).count() == 16


def test_partners_are_a_permutation(spark):
    df = series_rows(spark, [[float(i)] for i in range(20)], [0] * 20)
    pairs = batches.batch_partners(batches.with_batches(batches.in_order(df)), 7).collect()
    for b in {r["batch_id"] for r in pairs}:
        mine = [r for r in pairs if r["batch_id"] == b]
        assert sorted(r["series_id"] for r in mine) == sorted(r["partner_id"] for r in mine)


@pytest.mark.parametrize("alpha", [0.3, 2.5])
def test_beta_draws_have_the_right_moments(spark, alpha):
    got = spark.range(4000).select(F.lit("d").alias("dataset_name"), F.col("id").alias("batch_id")).select(batches.mix_share(3, alpha).alias("s"))
    one = got.agg(F.avg("s").alias("mean"), F.var_pop("s").alias("var"), F.min("s").alias("lo"), F.max("s").alias("hi")).first()
    assert one["mean"] == pytest.approx(0.5, abs=0.02) and 0 <= one["lo"] and one["hi"] <= 1
    assert one["var"] == pytest.approx(1 / (4 * (2 * alpha + 1)), rel=0.08)


def test_beta_shares(spark):
    df = series_rows(spark, [[float(i)] for i in range(64)], [0] * 64)
    pairs = batches.batch_partners(batches.with_batches(batches.in_order(df)), 7)
    rows = batches.mixed_rows(pairs, 7, alpha=0.5).collect()
    per_batch = {}
    for r in rows:
        per_batch.setdefault(r["batch_id"], set()).add(r["share"])
        assert r["mixed"][0] == pytest.approx(r["share"] * r["series_1"][0] + (1 - r["share"]) * r["series_2"][0])
    assert all(len(s) == 1 for s in per_batch.values())
    assert len({next(iter(s)) for s in per_batch.values()}) == 8


@pytest.mark.parametrize("limit", [0, 1 << 20])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast(spark, monkeypatch, limit, how):
    from strandlab.operators import joining

    monkeypatch.setattr(joining, "BROADCAST_BYTES", limit)
    df = spark.range(500).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 7)).alias("dataset_name"), F.col("id").alias("series_id"))
    small = spark.createDataFrame([("hot", [1.0, 2.0]), ("d1", [3.0]), ("none", [0.0])], "dataset_name string, v array<double>")
    got = joining.join_small(df, small, "dataset_name", how, numbers=F.size("v"))
    assert sorted(map(str, got.collect())) == sorted(map(str, df.join(small, "dataset_name", how).collect()))


def test_whole_preparation_with_salted_joins(spark, monkeypatch):
    from strandlab.operators import joining

    df = series_rows(spark, [[float(i), float(i % 4)] for i in range(40)], [i % 3 for i in range(40)])
    wanted = scaling.scale_steps(df, scaling.step_ranges(df)).orderBy("series_id").collect()
    monkeypatch.setattr(joining, "BROADCAST_BYTES", 0)
    assert scaling.scale_steps(df, scaling.step_ranges(df)).orderBy("series_id").collect() == wanted
