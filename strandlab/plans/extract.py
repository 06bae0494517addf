"""Encoders by name, and the extraction of representations for all data sets in one job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.operators import cluster, distill, scaling
from strandlab.operators.blocks import dataset_sizes
from strandlab.operators.prep import DATASET, LABEL, PART, SERIES, SERIES_ID
from strandlab.session import materialise

ROW = [DATASET, SERIES_ID]


class FittedEncoder(Protocol):
    def encode(self, df: DataFrame) -> DataFrame:
        """Rows of ``df`` with the vector column ``repr``."""


class Encoder(Protocol):
    def fit(self, df: DataFrame) -> FittedEncoder:
        """Fit on the train rows of ``df``, all data sets at once."""


@dataclass
class FittedIntervals:
    intervals: DataFrame

    def encode(self, df: DataFrame) -> DataFrame:
        return cluster.interval_features(df, self.intervals).withColumnRenamed("features", "repr")


@dataclass
class IntervalEncoder:
    """Means over seeded random intervals."""

    seed: int = 42

    def fit(self, df: DataFrame) -> FittedIntervals:
        return FittedIntervals(cluster.draw_intervals(dataset_sizes(df), self.seed))


@dataclass
class FittedLinear:
    encoders: DataFrame

    def encode(self, df: DataFrame) -> DataFrame:
        return distill.encode_linear(df, self.encoders, keep_series=True).drop("checkpoint")


@dataclass
class PrincipalEncoder:
    """Leading axes of the train rows."""

    compression: int = 2

    def fit(self, df: DataFrame) -> FittedLinear:
        train = df.where(F.col(PART) == "train")
        return FittedLinear(materialise(distill.principal_axes(train, self.compression), "axes"))


@dataclass
class SuppliedEncoder:
    """Encoder that needs no fit, given as a table function (for example supplied network weights)."""

    run: Callable[[DataFrame], DataFrame]

    def fit(self, df: DataFrame) -> SuppliedEncoder:
        return self

    def encode(self, df: DataFrame) -> DataFrame:
        return self.run(df)


ENCODERS: dict[str, Callable[..., Encoder]] = {
    "intervals": IntervalEncoder,
    "principal": PrincipalEncoder,
    "supplied": SuppliedEncoder,
}


def make_encoder(name: str, **settings) -> Encoder:
    if name not in ENCODERS:
        raise ValueError(f"unknown encoder: {name}")
    return ENCODERS[name](**settings)


def with_teacher(df: DataFrame, teacher: Encoder) -> DataFrame:
    """Fit the teacher and add its representation as ``teacher``. The teacher stays as fitted afterwards."""
    return teacher.fit(df).encode(df).withColumnRenamed("repr", "teacher")


def fit_student(
    df: DataFrame, teacher: Encoder | None = None, epochs: int = distill.EPOCHS, compression: int = 2, **settings
) -> DataFrame:
    """Training log of one student per data set, with the encoders of the best and the final epoch.

    Without a teacher the student is a plain autoencoder.
    """
    scaled = df.transform(scaling.make_normaliser())
    taught = scaled if teacher is None else with_teacher(scaled, teacher)
    grams = distill.gram_parts(taught, None if teacher is None else "teacher")
    return distill.fit_students(grams, dataset_sizes(df), epochs, compression, **settings)


def extract(df: DataFrame, fits: DataFrame, model_name: str, encoder_name: str) -> DataFrame:
    """Representations of all parts under the best and the final encoder of every data set."""
    scaled = df.transform(scaling.make_normaliser())
    coded = distill.encode_linear(scaled.select(*ROW, LABEL, PART, SERIES), distill.checkpoints(fits))
    return coded.withColumn("model_name", F.lit(model_name)).withColumn("encoder_name", F.lit(encoder_name))
