"""Exact row numbers and running totals without putting a whole group in one task.

A window over a group sends the group to one task, which fails when one group
holds a third of the data. Here each group is cut into buckets that keep the
order; the bucket totals are summed up first (few rows), and the inner window
only ever sees one bucket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlab.operators.joining import BROADCAST_BYTES
from strandlab.operators.task_state import counted_numbers
from strandlab.session import materialise


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool = False) -> list[Column]:
    """Join condition on the group keys; plain equality lets join and window share one shuffle."""
    pairs = [(left[k], right["_r_" + k]) for k in keys]
    return [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs]


def _with_offsets(
    df: DataFrame, keys: Sequence[str], weight: Column, per_group: DataFrame | None, null_safe: bool = False
) -> DataFrame:
    """Attach the total weight of all earlier buckets of the group, and group columns if given."""
    totals = df.groupBy(*keys, "_bucket").agg(F.sum(weight).alias("_total"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset")
    )
    if per_group is not None:
        renamed = per_group.select(*[F.col(k).alias("_r_" + k) for k in keys],
                                   *[c for c in per_group.columns if c not in keys])
        offsets = offsets.join(renamed, _same(offsets, renamed, keys)).drop(*["_r_" + k for k in keys])
    renames = {k: "_r_" + k for k in [*keys, "_bucket"]}
    offsets = offsets.withColumnsRenamed(renames)
    return df.join(offsets, _same(df, offsets, [*keys, "_bucket"], null_safe)).drop(*renames.values())


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str | Column],
    bucket: Column,
    name: str = "row_no",
    per_group: DataFrame | None = None,
) -> DataFrame:
    """``row_number()`` per group, from 1. ``bucket`` must never fall along ``order_by``.

    Group keys must not be null, as in the series tables. ``per_group`` columns (one row per group) ride along on the bucket table,
    so that joining them needs no further pass over the rows.
    """
    bucketed = df.withColumn("_bucket", bucket)
    inner = W.partitionBy(*keys, "_bucket").orderBy(*order_by)
    numbered = _with_offsets(bucketed, keys, F.lit(1), per_group).withColumn("_inner", F.row_number().over(inner))
    return numbered.withColumn(name, (F.col("_offset") + F.col("_inner")).cast("bigint")).drop(
        "_bucket", "_offset", "_inner"
    )


def running_total(
    df: DataFrame, keys: Sequence[str], order_by: str, weight: str, name: str = "running", null_safe: bool = False
) -> DataFrame:
    """Running sum of ``weight`` along the numbers ``order_by`` (distinct in a group), current row included."""
    bucketed = with_value_bucket(df, order_by)
    inner = W.partitionBy(*keys, "_bucket").orderBy(order_by).rowsBetween(W.unboundedPreceding, 0)
    summed = _with_offsets(bucketed, keys, F.col(weight), None, null_safe).withColumn("_inner", F.sum(weight).over(inner))
    return summed.withColumn(name, F.col("_offset") + F.col("_inner")).drop("_bucket", "_offset", "_inner")


def with_value_bucket(df: DataFrame, col: str, name: str = "_bucket") -> DataFrame:
    """Add a bucket number that never falls as the value of ``col`` grows.

    The cut points are approximate quantiles, a few per shuffle partition. They
    only steer how the work is spread; results do not depend on them.
    """
    buckets = min(8192, max(128, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    shares = [i / buckets for i in range(1, buckets)]
    cuts = df.agg(F.percentile_approx(F.col(col).cast("double"), shares, 10 * buckets).alias("cuts")).first()["cuts"]
    points = sorted({float(c) for c in cuts or [] if math.isfinite(c)}) or [0.0]
    binned = Bucketizer(splits=[-math.inf, *points, math.inf], inputCol="_v", outputCol="_b", handleInvalid="keep")
    out = binned.transform(df.withColumn("_v", F.col(col).cast("double")))
    # a missing value sorts first
    return out.withColumn(name, F.when(F.col("_v").isNull(), -1).otherwise(F.col("_b").cast("int"))).drop("_v", "_b")


# share of the rows on each side of the middle that pass 2 looks at, and the accuracy of the sketch behind it
_MIDDLE, _ACCURACY = 0.001, 10_000


def _beside(rows: DataFrame, narrow: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows with the one row of their group in ``narrow`` (its keys start with ``_r_``). Null keys are groups too.

    ``narrow`` is counted: broadcast up to ``BROADCAST_BYTES``, beyond that copied to salts, so that no group meets in one task.
    """
    renames = ["_r_" + k for k in keys]
    size = 16 * (narrow.agg(F.sum(counted_numbers(narrow))).first()[0] or 0)
    if size <= BROADCAST_BYTES:
        narrow = F.broadcast(narrow)
        return rows.join(narrow, _same(rows, narrow, keys, null_safe=True)).drop(*renames)
    salts = max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # equal values of one group are spread as well, by the task that reads them
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(value, F.spark_partition_id()), F.lit(salts)).cast("int"))
    copies = narrow.withColumn("_r__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = [*_same(salted, copies, keys, null_safe=True), salted["_salt"] == copies["_r__salt"]]
    return salted.join(copies, on).drop(*renames, "_salt", "_r__salt")


def group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], name: str = "quantiles", also: Sequence[Column] = ()
) -> DataFrame:
    """Exact quantiles per group (an array, in the order of ``shares``), interpolated between neighbouring values.

    Null and NaN are left out. A group without a number has no quantiles (null).

    Pass 1 sketches each group, which brackets all quantiles at ten times the error of the sketch. Pass 2 counts the values below each
    bracket and, value by value, those inside. A group of few values is counted as a whole. Only counts are shuffled.
    """
    keys, shares = list(keys), [float(p) for p in shares]
    ends = [(p - _MIDDLE, p + _MIDDLE) for p in shares]
    probes = sorted({min(max(e, 0.0), 1.0) for pair in ends for e in pair})
    number = F.col(value).cast("double")
    df = df.withColumn("_value", F.when(~F.isnan(number), number))
    drawn = F.percentile_approx("_value", probes, _ACCURACY)
    sketch = materialise(df.groupBy(*keys).agg(drawn.alias("_q"), F.count("_value").alias("_size"), *also), "quantile-sketch")
    few = F.col("_size") < 2.0 / _MIDDLE
    low = [F.when(few | (a <= 0), F.lit(-math.inf)).otherwise(F.col("_q")[probes.index(max(a, 0.0))]) for a, _ in ends]
    high = [F.when(few | (b >= 1), F.lit(math.inf)).otherwise(F.col("_q")[probes.index(min(b, 1.0))]) for _, b in ends]
    renames = {k: "_r_" + k for k in keys}
    narrow = sketch.select(*keys, F.array(*low).alias("_low"), F.array(*high).alias("_high"), "_size").withColumnsRenamed(renames)
    rows = _beside(df.select(*keys, "_value").where("_value IS NOT NULL"), narrow, keys, "_value")
    at = lambda c, i: F.col(c)[i]
    under = rows.groupBy(*keys).agg(F.array(*[F.count_if(F.col("_value") < at("_low", i)) for i in range(len(shares))]).alias("_under"))
    inside = F.filter(F.sequence(F.lit(0), F.lit(len(shares) - 1)), lambda i: (F.col("_value") >= F.get("_low", i)) & (F.col("_value") <= F.get("_high", i)))
    counted = rows.withColumn("_share", F.explode(inside)).groupBy(*keys, "_share", "_value").agg(F.count(F.lit(1)).alias("_n"), F.first("_size").alias("_size"))
    counted = materialise(counted, "quantile-values")
    under = under.withColumnsRenamed(renames)
    placed = running_total(counted, [*keys, "_share"], "_value", "_n", "_upto", null_safe=True)
    placed = placed.join(under, _same(placed, under, keys, null_safe=True)).drop(*renames.values())
    upto = F.col("_upto") + F.get("_under", F.col("_share"))
    rank = F.element_at(F.array(*[F.lit(p) for p in shares]), F.col("_share") + 1) * (F.col("_size") - 1) + 1
    holds = lambda r: (upto - F.col("_n") < r) & (r <= upto)
    value_at = lambda r: F.max(F.when(holds(r), F.col("_value")))
    found = placed.where(holds(F.floor(rank)) | holds(F.ceil(rank))).groupBy(*keys, "_share").agg(
        value_at(F.floor(rank)).alias("_a"), value_at(F.ceil(rank)).alias("_b"), F.max(rank - F.floor(rank)).alias("_part"))
    between = F.col("_a") + F.col("_part") * (F.col("_b") - F.col("_a"))
    found = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_share", between.alias("v")))).alias("_found")).withColumnsRenamed(renames)
    joined = sketch.join(found, _same(sketch, found, keys, null_safe=True), "left").drop(*renames.values(), "_q")
    values = F.transform("_found", lambda x: x["v"])
    missed = (F.col("_size") > 0) & (F.coalesce(F.size("_found"), F.lit(0)) < len(shares)) | F.exists("_found", lambda x: x["v"].isNull())
    checked = F.when(missed, F.raise_error(F.lit("a quantile lies outside its bracket")).cast("array<double>")).otherwise(values)
    return joined.withColumn(name, checked).drop("_size", "_found")


def group_median(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "median", also: Sequence[Column] = ()
) -> DataFrame:
    """Exact median per group, next to the aggregates in ``also``.

    Pass 1 sketches each group; the sketch brackets the middle at ten times its
    error. Pass 2 counts what lies below the bracket and orders only the few
    values inside it. Neither pass shuffles the rows themselves.
    """
    keys = list(keys)
    bracket = F.percentile_approx(F.col(value), [0.5 - _MIDDLE, 0.5 + _MIDDLE], _ACCURACY)
    sketch = df.groupBy(*keys).agg(bracket.alias("_q"), F.count(value).alias("_size"), *also)
    sketch = materialise(sketch, "median-sketch")
    renames = {k: "_r_" + k for k in keys}
    narrow = sketch.select(*keys, "_q", "_size").withColumnsRenamed(renames)
    rows = _beside(df.select(*keys, value), narrow, keys, value)
    upper = rows.where(F.col(value) <= F.col("_q")[1])
    # everything below the bracket becomes one row without a value
    inside = F.when(F.col(value) >= F.col("_q")[0], F.col(value)).alias("_value")
    counted = upper.groupBy(*keys, inside).agg(F.count(F.lit(1)).alias("_n"), F.first("_size").alias("_size"))
    # small from here on, and read several times
    counted = materialise(counted, "median-middle")
    placed = running_total(counted, keys, "_value", "_n", "_upto", null_safe=True)
    low, high = F.floor((F.col("_size") + 1) / 2), F.ceil((F.col("_size") + 1) / 2)
    holds = lambda rank: (F.col("_upto") - F.col("_n") < rank) & (rank <= F.col("_upto"))
    at = lambda rank: F.max(F.when(holds(rank), F.col("_value")))
    found = placed.where(holds(low) | holds(high)).groupBy(*keys).agg(((at(low) + at(high)) / 2).alias(name))
    found = found.withColumnsRenamed(renames)
    joined = sketch.join(found, _same(sketch, found, keys, null_safe=True), "left").drop(*renames.values(), "_q")
    missed = (F.col("_size") > 0) & F.col(name).isNull()
    checked = F.when(missed, F.raise_error(F.lit("the middle lies outside its bracket")).cast("double")).otherwise(F.col(name))
    return joined.withColumn(name, checked).drop("_size")
