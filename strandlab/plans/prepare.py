"""Preparation of all data sets in one job: read, merge or keep the given parts, split, drop singletons, write."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.operators import prep, split
from strandlab.operators.prep import DATASET, LABEL, PART, SERIES, SERIES_ID
from strandlab.session import materialise
from strandlab.sources import series_files, tables


def read_given_parts(
    spark: SparkSession, train: str | Sequence[str], test: str | Sequence[str], train_pattern: str | None = None, test_pattern: str | None = None
) -> DataFrame:
    """Rows of the train and test files of all data sets; ids are unique in a data set, even for train and odd for test rows."""
    sides = [
        series_files.read_arff(spark, paths, pattern=pattern).select(
            DATASET, (F.col(SERIES_ID) * 2 + odd).alias(SERIES_ID), F.lit(name).alias(PART), LABEL, SERIES
        )
        for name, odd, paths, pattern in (("train", 0, train, train_pattern), ("test", 1, test, test_pattern))
    ]
    return prep.union_parts(*sides)


def prepare_all(
    given: DataFrame,
    path: str,
    strategy: str = "manual",
    datasets: DataFrame | None = None,
    skipped: Iterable[str] = prep.SKIPPED_DATASETS,
    test_share: float = split.TEST_SHARE,
    valid_share: float = split.VALID_SHARE,
    seed: int = split.SPLIT_SEED,
    fmt: str = "parquet",
) -> DataFrame:
    """Write the parts of all listed data sets to ``path`` and return them as read back (Parquet) or as written (text).

    ``datasets`` holds the wanted names (all, if None); ``skipped`` names never are prepared. The rows are written once as read, since
    the split goes through them several times and text would be parsed each time.
    """
    rows = prep.skip_datasets(given, skipped)
    if datasets is not None:
        rows = prep.keep_datasets(rows, datasets)
    rows = materialise(rows, "given-rows")
    parts = split.split_parts(rows, strategy, test_share, valid_share, seed)
    tables.write_parts(parts, path, fmt)
    if fmt != "parquet":
        return parts
    return given.sparkSession.read.schema(parts.schema).parquet(path)
