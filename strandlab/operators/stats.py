"""Descriptive statistics of data sets and arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlab.operators.ordering import group_median
from strandlab.operators.prep import DATASET, LABEL, SERIES


def class_and_feature_counts(df: DataFrame, key: str = DATASET) -> DataFrame:
    """Number of classes and of features per data set.

    Two aggregate levels: the distinct labels of a hot data set are merged before they meet.
    """
    per_class = df.groupBy(key, LABEL).agg(F.max(F.size(SERIES)).alias("_len"))
    return per_class.groupBy(key).agg(
        F.count(LABEL).alias("n_classes"), F.max("_len").cast("bigint").alias("n_features")
    )


def five_numbers(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median, mean, population deviation, least and greatest value per group."""
    others = [
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ]
    return group_median(df, keys, value, "median", others)


def five_numbers_of_series(df: DataFrame, keys: Sequence[str] = (DATASET,), series: str = SERIES) -> DataFrame:
    """Same over all numbers of all series of a group."""
    return five_numbers(df.select(*keys, F.explode(series).alias("value")), keys, "value")


def audit_counts(value: str | Column) -> list[Column]:
    """Counts of NaN, positive and negative infinity."""
    v = F.col(value) if isinstance(value, str) else value
    return [
        F.count_if(F.isnan(v)).alias("n_nan"),
        F.count_if(v == F.lit(float("inf"))).alias("n_pos_inf"),
        F.count_if(v == F.lit(float("-inf"))).alias("n_neg_inf"),
    ]


def processed_and_removed(before: DataFrame, report: DataFrame, key: str = DATASET) -> DataFrame:
    """Data sets and rows seen, kept and removed by a reject step."""
    seen = before.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    removed = report.select(key, F.lit(True).alias("_removed"))
    return seen.join(removed, key, "left").agg(
        F.count(F.lit(1)).alias("n_datasets"),
        F.count("_removed").alias("n_datasets_removed"),
        F.sum("n_rows").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("_removed"), F.col("n_rows"))), F.lit(0)).alias("n_rows_removed"),
    )
