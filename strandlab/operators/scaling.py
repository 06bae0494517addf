"""Scaling per time step and per channel, fitted on the train rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlab.operators.joining import join_small
from strandlab.operators.prep import DATASET, PART, SERIES


def step_values(df: DataFrame, keys: Sequence[str] = (DATASET,), series: str = SERIES) -> DataFrame:
    """One row per series step: keys, ``pos`` from 0, ``value``; NaN counts as missing."""
    steps = df.select(*keys, F.posexplode(series).alias("pos", "value"))
    return steps.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def step_ranges(df: DataFrame, keys: Sequence[str] = (DATASET,), series: str = SERIES) -> DataFrame:
    """Least and greatest value of every time step. Combines before the shuffle."""
    return step_values(df, keys, series).groupBy(*keys, "pos").agg(
        F.min("value").alias("low"), F.max("value").alias("high")
    )


def step_moments(df: DataFrame, keys: Sequence[str] = (DATASET,), series: str = SERIES) -> DataFrame:
    """Mean and population deviation of every time step."""
    return step_values(df, keys, series).groupBy(*keys, "pos").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )


def channel_values(df: DataFrame, keys: Sequence[str] = (DATASET,), nested: str = "steps") -> DataFrame:
    """One row per number of a nested series ``[t][channel]``."""
    steps = df.select(*keys, F.explode(nested).alias("_step"))
    values = steps.select(*keys, F.posexplode("_step").alias("channel", "value"))
    return values.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def channel_ranges(df: DataFrame, keys: Sequence[str] = (DATASET,), nested: str = "steps") -> DataFrame:
    """Least and greatest value of every channel over all steps of all series."""
    return channel_values(df, keys, nested).groupBy(*keys, "channel").agg(
        F.min("value").alias("low"), F.max("value").alias("high")
    )


def merge_ranges(*fits: DataFrame, keys: Sequence[str] = (DATASET, "channel")) -> DataFrame:
    """Fit of the union of the data behind several fits."""
    merged = fits[0]
    for f in fits[1:]:
        merged = merged.unionByName(f)
    return merged.groupBy(*keys).agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _packed(fit: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """One row per data set with its fit as an array in position order (as long as one series)."""
    stats = [c for c in fit.columns if c not in (*keys, pos)]
    return fit.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(pos, *stats))).alias("_fit"))


def _min_max(x: Column, low: Column, high: Column, lo: float, hi: float) -> Column:
    width = high - low
    return F.lit(lo) + (x - low) * F.lit(hi - lo) / F.when(width == 0, F.lit(1.0)).otherwise(width)


def scale_steps(
    df: DataFrame, fit: DataFrame, lo: float = 0.0, hi: float = 1.0, keys: Sequence[str] = (DATASET,), series: str = SERIES
) -> DataFrame:
    """Min-max scale every step to ``[lo, hi]`` with fitted ranges; no clipping, a constant step gives ``lo``."""
    joined = join_small(df, _packed(fit, keys, "pos"), keys, numbers=F.size("_fit") * 3)
    scaled = F.zip_with(series, "_fit", lambda x, b: _min_max(x, b["low"], b["high"], lo, hi))
    return joined.withColumn(series, scaled).drop("_fit")


def scale_channels(
    df: DataFrame, fit: DataFrame, lo: float = 0.0, hi: float = 1.0, keys: Sequence[str] = (DATASET,), nested: str = "steps"
) -> DataFrame:
    """Min-max scale every channel of nested series."""
    joined = join_small(df, _packed(fit, keys, "channel"), keys, numbers=F.size("_fit") * 3)
    scaled = F.transform(
        nested, lambda step: F.zip_with(step, F.col("_fit"), lambda x, b: _min_max(x, b["low"], b["high"], lo, hi))
    )
    return joined.withColumn(nested, scaled).drop("_fit")


def standardise_steps(
    df: DataFrame, fit: DataFrame, keys: Sequence[str] = (DATASET,), series: str = SERIES, **also: Column
) -> DataFrame:
    """``(x - mean) / std`` per step with the population deviation; a constant step gives 0.

    ``also`` adds columns computed from the packed fit of the data set, ``_fit``.
    """
    packed = _packed(fit, keys, "pos").withColumns(also)
    joined = join_small(df, packed, keys, numbers=F.size("_fit") * 3)
    scaled = F.zip_with(
        series, "_fit", lambda x, m: (x - m["mean"]) / F.when(m["std"] == 0, F.lit(1.0)).otherwise(m["std"])
    )
    return joined.withColumn(series, scaled).drop("_fit")


def make_normaliser(
    enabled: bool = True, value_range: tuple[float, float] = (0.0, 1.0), nested: bool = False
) -> Callable[[DataFrame], DataFrame]:
    """Table step that fits on the train part and scales all parts; the valid part may be absent."""
    lo, hi = value_range

    def apply(df: DataFrame) -> DataFrame:
        train = df.where(F.col(PART) == "train")
        if nested:
            return scale_channels(df, channel_ranges(train), lo, hi)
        return scale_steps(df, step_ranges(train), lo, hi)

    return apply if enabled else lambda df: df
