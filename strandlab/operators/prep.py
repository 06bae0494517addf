"""Row and column preparation: targets, filters, rejects, modes, unions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlab.functions import arrays
from strandlab.operators.joining import join_small, without_rows
from strandlab.session import materialise

DATASET, LABEL, SERIES, SERIES_ID, PART = "dataset_name", "label", "series", "series_id", "part"

# Data sets the comparison leaves out.
SKIPPED_DATASETS = (
    "DodgerLoopDay",
    "DodgerLoopGame",
    "DodgerLoopWeekend",
    "GestureMidAirD1",
    "GestureMidAirD2",
    "GestureMidAirD3",
    "MelbournePedestrian",
)


def features(df: DataFrame, target: str = LABEL) -> DataFrame:
    return df.drop(target)


def targets(df: DataFrame, target: str = LABEL, key: Sequence[str] = (DATASET, SERIES_ID)) -> DataFrame:
    return df.select(*key, target)


def drop_unnamed(df: DataFrame) -> DataFrame:
    """Drop index columns that a CSV writer left behind."""
    return df.select(*[c for c in df.columns if not c.startswith("Unnamed")])


def skip_datasets(df: DataFrame, skipped: Iterable[str] | DataFrame, key: str = DATASET) -> DataFrame:
    """Drop the rows of listed data sets; the list is a table or a few names."""
    if isinstance(skipped, DataFrame):
        return join_small(df, skipped.select(key).distinct(), key, "left_anti", row_key=df.columns)
    names = list(skipped)
    return df.where(~F.col(key).isin(names)) if names else df


def keep_datasets(df: DataFrame, kept: Iterable[str] | DataFrame, key: str = DATASET) -> DataFrame:
    if isinstance(kept, DataFrame):
        return join_small(df, kept.select(key).distinct(), key, "left_semi", row_key=df.columns)
    return df.where(F.col(key).isin(list(kept)))


def clustering_parts(df: DataFrame, data_type: str) -> DataFrame:
    """Raw series are clustered on the test part only; representations on what they hold."""
    if data_type == "raw":
        return df.where(F.col(PART) == "test")
    if data_type == "representation":
        return df
    raise ValueError(f"unknown data type: {data_type}")


def reject_missing(df: DataFrame, key: str = DATASET) -> tuple[DataFrame, DataFrame]:
    """Keep data sets without a missing value; report the others.

    The report has one row per rejected data set: rows with a missing value and all rows.
    """
    flagged = df.select(key, arrays.has_missing(SERIES).alias("_missing"))
    report = (
        flagged.groupBy(key)
        .agg(F.count_if("_missing").alias("n_missing"), F.count(F.lit(1)).alias("n_rows"))
        .where(F.col("n_missing") > 0)
    )
    report = materialise(report, "rejected")
    return join_small(df, report.select(key), key, "left_anti", row_key=df.columns, written=True), report


def drop_singleton_classes(df: DataFrame, keys: Sequence[str] = (DATASET, LABEL), row_id: str | None = None) -> DataFrame:
    """Drop classes with one row.

    A class of one names its row: the aggregate that counts a class also takes its least ``row_id`` (by default the series id where
    there is one), and the rows to drop are found by class and id.
    """
    row_id = row_id or (SERIES_ID if SERIES_ID in df.columns else None)
    if row_id is None:
        single = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 1).drop("_n")
        return join_small(df, single, keys, "left_anti", row_key=df.columns)
    single = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(row_id).alias(row_id)).where(F.col("_n") == 1)
    return without_rows(df, single, [*keys, row_id])


def with_mode(df: DataFrame, mode: str) -> DataFrame:
    if mode == "with_labels":
        return df
    if mode == "without_labels":
        return df.drop(LABEL)
    raise ValueError(f"unknown mode: {mode}")


def rename_values(c: str | Column, names: dict[str, str]) -> Column:
    """Display name of a model; names without an entry stay as they are."""
    col = F.col(c) if isinstance(c, str) else c
    if not names:
        return col
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), col)


def column_order(columns: Iterable[str], first: Sequence[str]) -> list[str]:
    """Baseline columns first, in the order given, then the others sorted."""
    present = list(columns)
    head = [c for c in first if c in present]
    return head + sorted(c for c in present if c not in head)


def model_key(model: str = "model_name", encoder: str = "encoder_name") -> Column:
    return F.concat_ws(" - ", F.col(model), F.col(encoder))


def first_source_wins(df: DataFrame, keys: Sequence[str], source_order: str) -> DataFrame:
    """One row per key, the one of the earliest source; a plain aggregate, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.min(F.struct(F.col(source_order), *[F.col(c) for c in rest if c != source_order])).alias("_first")
    return df.groupBy(*keys).agg(packed).select(*keys, "_first.*").select(*df.columns)


def union_parts(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def union_results(*runs: DataFrame) -> DataFrame:
    """Append result tables of runs; a metric a run lacks is null there."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def predefined_folds(train: DataFrame, valid: DataFrame) -> DataFrame:
    """Train rows are never scored (fold -1), validation rows are fold 0."""
    return train.withColumn("fold", F.lit(-1)).unionByName(valid.withColumn("fold", F.lit(0)))


def name_difference(left: DataFrame, right: DataFrame, key: str = DATASET) -> DataFrame:
    """Distinct names of ``left`` that ``right`` does not have."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def join_parts(df: DataFrame, key: str = DATASET) -> DataFrame:
    """One row per data set with the row counts of its three parts; all parts must exist."""
    counts = df.groupBy(key, PART).agg(F.count(F.lit(1)).alias("n"))
    side = lambda p: counts.where(F.col(PART) == p).select(key, F.col("n").alias(f"n_{p}"))
    return side("train").join(side("valid"), key).join(side("test"), key)


def attach_labels(reprs: DataFrame, labels: DataFrame, key: Sequence[str] = (DATASET, SERIES_ID)) -> DataFrame:
    return reprs.join(labels.select(*key, LABEL), list(key))
