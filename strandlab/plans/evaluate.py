"""Evaluation of all data sets in one job: clustering and classification."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.operators import classify, cluster, metrics, neighbours, prep, stats
from strandlab.operators.blocks import dataset_sizes
from strandlab.operators.prep import DATASET, LABEL, SERIES, SERIES_ID
from strandlab.session import materialise
from strandlab.sources import series_files, tables

SEPARATOR = "\u0001"


def pack_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Several key columns (data set, model, encoder, seed) as one data set name, so that each is a data set of its own."""
    return df.withColumn(DATASET, F.array_join(F.array(*[F.col(k).cast("string") for k in keys]), SEPARATOR, ""))


def unpack_keys(df: DataFrame, keys: Sequence[str], kinds: dict[str, str]) -> DataFrame:
    """The key columns back from a packed data set name; an empty piece is null."""
    pieces = F.split(DATASET, SEPARATOR, -1)
    named = [F.nullif(F.get(pieces, i), F.lit("")).cast(kinds[k]).alias(k) for i, k in enumerate(keys)]
    return df.select(*named, *[c for c in df.columns if c not in keys])


def scores_by(fn, df: DataFrame, keys: Sequence[str], **settings) -> DataFrame:
    """``fn`` (a plan that scores data sets) for every combination of ``keys``, the data set name among them."""
    if DATASET not in keys:
        raise ValueError(f"{DATASET} is one of the keys")
    return unpack_keys(fn(pack_keys(df, keys), **settings), keys, dict(df.dtypes))


def clustering_scores(clustered: DataFrame, internal: str = SERIES, silhouette: DataFrame | None = None) -> DataFrame:
    """Three external and three internal scores per data set.

    The internal scores are measured on the ``internal`` column, which for raw
    data is the series and not the features that were clustered. A data set
    that ended in one cluster keeps its external scores; its internal ones are
    null. ``silhouette`` may bring those scores from a shared pass.
    """
    rows = clustered if internal == SERIES else clustered.withColumn(SERIES, F.col(internal))
    counts = stats.class_and_feature_counts(rows)
    return (
        counts.join(metrics.external_scores(rows), DATASET)
        .join(metrics.centre_scores(rows), DATASET, "left")
        .join(neighbours.silhouette_score(rows) if silhouette is None else silhouette, DATASET, "left")
        .select(DATASET, "n_features", "n_classes", "ari", "nmi", "fmi", "chs", "dbs", "ss")
    )


REPRESENTATION_KEYS = (DATASET, "model_name", "encoder_name", "seed")


def evaluate_representations(df: DataFrame, keys: Sequence[str] = REPRESENTATION_KEYS, **settings) -> tuple[DataFrame, DataFrame]:
    """Clustering scores of every data set, model, encoder and seed in one job, and the report of the rejected ones.

    Ids are unique per combination of ``keys``. ``settings`` go to ``cluster_and_evaluate``.
    """
    kinds = dict(df.dtypes)
    skipped = settings.pop("skipped", prep.SKIPPED_DATASETS)
    scores, rejected = cluster_and_evaluate(pack_keys(prep.skip_datasets(df, skipped), keys), "representation", skipped=(), **settings)
    return unpack_keys(scores, keys, kinds), unpack_keys(rejected, keys, kinds)


def classify_representations(
    df: DataFrame, keys: Sequence[str] = REPRESENTATION_KEYS, skipped: Iterable[str] = prep.SKIPPED_DATASETS, **settings
) -> DataFrame:
    """Accuracy and macro scores on the test part for every data set, model, encoder and seed in one job.

    Ids are unique per combination of ``keys``. ``settings`` go to ``classify_and_evaluate``.
    """
    return scores_by(classify_and_evaluate, prep.skip_datasets(df, skipped), keys, skipped=(), **settings)


def representation_files(spark: SparkSession, paths: str | Sequence[str], seeds: Iterable[int], template: str = "run_{{seed_number}}") -> DataFrame:
    """Rows of the files ``.../run_<seed>/.../<part>/<data set>_<model>_<encoder>.csv`` of the wanted seeds, with all of these as columns.

    Files of other seeds and of no seed are left out; a file name that has not three pieces is an error.
    """
    rows = series_files.keep_seeds(series_files.read_wide_csv(spark, paths, "*.csv"), "file", seeds, template)
    rows = rows.withColumn(prep.PART, F.regexp_extract("file", r"([^/]+)/[^/]+$", 1))
    return series_files.representation_name_columns(rows, series_files.base_name("file")).drop("file")


def cluster_files(
    spark: SparkSession, paths: str | Sequence[str], results: str, seeds: Sequence[int], part: str = "test", prefix: str | None = None,
    template: str = "run_{{seed_number}}", **settings,
) -> tuple[DataFrame, DataFrame]:
    """Clustering scores of representation files of one part, written to ``results`` by seed; the scores as read back, and the report.

    The report names every data set, model, encoder and seed without scores or without internal scores, with the reason.
    """
    rows = materialise(representation_files(spark, paths, seeds, template).where(F.col(prep.PART) == part).drop(prep.PART), "representations")
    scores, rejected = evaluate_representations(rows, **settings)
    tables.write_results(scores, results, prefix=prefix)
    written = tables.read_results(spark, results, seeds)
    reason = lambda df, text: df.select(*REPRESENTATION_KEYS, F.lit(text).alias("reason"))
    single = written.where("chs IS NULL AND dbs IS NULL AND ss IS NULL")
    return written, reason(rejected, "missing values").unionByName(reason(single, "one cluster"))


def classify_files(
    spark: SparkSession, paths: str | Sequence[str], results: str, seeds: Sequence[int], prefix: str | None = None,
    template: str = "run_{{seed_number}}", **settings,
) -> DataFrame:
    """Classification scores of representation files (parts train, valid and test), written to ``results`` by seed and read back."""
    rows = representation_files(spark, paths, seeds, template)
    # ids are line numbers of a file, so they repeat over the parts
    place = F.when(F.col(prep.PART) == "train", 0).when(F.col(prep.PART) == "valid", 1).otherwise(2)
    rows = materialise(rows.withColumn(SERIES_ID, F.col(SERIES_ID) * 3 + place), "representations")
    tables.write_results(classify_representations(rows, **settings), results, prefix=prefix)
    return tables.read_results(spark, results, seeds)


def cluster_and_evaluate(
    df: DataFrame,
    data_type: str,
    skipped: Iterable[str] = prep.SKIPPED_DATASETS,
    seed: int = cluster.SEED,
    restarts: int = cluster.RESTARTS,
    decomposer_seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Scores of all usable data sets, and the report of the rejected ones."""
    kept, rejected = prep.reject_missing(prep.skip_datasets(prep.clustering_parts(df, data_type), skipped))
    if data_type == "raw":
        scores = cluster_raw_rows(kept, [decomposer_seed], seed, restarts).drop("seed")
    else:
        best = cluster.best_restart(cluster.kmeans(kept, restarts, seed))
        clustered = materialise(cluster.cluster_rows(kept, best), "clustered")
        scores = clustering_scores(clustered)
    return scores, rejected


def one_cluster_datasets(scores: DataFrame) -> DataFrame:
    """Data sets that ended in a single cluster: they have no internal scores."""
    return scores.where("chs is null and dbs is null and ss is null").select(DATASET, F.lit("one cluster").alias("reason"))


def raw_features(df: DataFrame, seed: int) -> DataFrame:
    """Interval features in place of the series."""
    drawn = cluster.draw_intervals(dataset_sizes(df), seed)
    return cluster.interval_features(df, drawn).drop(SERIES).withColumnRenamed("features", SERIES)


def raw_features_of_seeds(df: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """Interval features under every seed; the seed is a key column."""
    sizes = dataset_sizes(df).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    return cluster.interval_features(df, cluster.draw_intervals(sizes))


def cluster_raw_rows(df: DataFrame, seeds: Sequence[int], seed: int, restarts: int) -> DataFrame:
    """Cluster the interval features of every decomposer seed at once and score them on the series."""
    swept = raw_features_of_seeds(df, seeds)
    # (data set, seed) is clustered like a data set of its own
    keyed = pack_keys(swept, [DATASET, "seed"]).select(
        DATASET,
        SERIES_ID,
        LABEL,
        F.col(SERIES).alias("raw"),
        F.col("features").alias(SERIES),
    )
    rows = materialise(keyed, "interval-features")
    best = cluster.best_restart(cluster.kmeans(rows, restarts, seed))
    clustered = materialise(cluster.cluster_rows(rows, best), "clustered")
    # the raw distances are the same for all seeds, so they are gone through once
    seed_of = F.split(DATASET, SEPARATOR)
    labelled = clustered.groupBy(seed_of[0].alias(DATASET), SERIES_ID).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(seed_of[1].cast("int").alias("s"), F.col("cluster").alias("c")))), lambda x: x["c"]).alias("clusters")
    )
    once = materialise(df.select(DATASET, SERIES_ID, SERIES).join(labelled, [DATASET, SERIES_ID]), "labelled")
    order = F.array(*[F.lit(s) for s in sorted(set(seeds))])
    widths = neighbours.silhouette_scores_of_labelings(once).select(
        F.concat_ws(SEPARATOR, DATASET, F.get(order, "labeling")).alias(DATASET), "ss"
    )
    scores = clustering_scores(clustered, "raw", widths)
    return unpack_keys(scores, [DATASET, "seed"], {DATASET: "string", "seed": "int"})


def cluster_raw(
    df: DataFrame, seeds: Sequence[int] = cluster.DECOMPOSER_SEEDS, seed: int = cluster.SEED, restarts: int = cluster.RESTARTS
) -> DataFrame:
    """Seed sweep over raw test rows: the decomposer seed varies, the k-means seed is fixed."""
    kept, _ = prep.reject_missing(prep.skip_datasets(prep.clustering_parts(df, "raw"), prep.SKIPPED_DATASETS))
    return cluster_raw_rows(kept, seeds, seed, restarts)


def classify_and_evaluate(
    df: DataFrame, skipped: Iterable[str] = prep.SKIPPED_DATASETS, seed: int = classify.CLASSIFIER_SEED, **settings
) -> DataFrame:
    """Accuracy and macro scores on the test part of every data set. ``settings`` go to ``grid_classify``."""
    kept = prep.skip_datasets(df, skipped)
    predicted = classify.grid_classify(kept, seed, **settings)
    counts = stats.class_and_feature_counts(kept.where(F.col(prep.PART) == "train"))
    return counts.join(metrics.macro_scores(predicted), DATASET).select(
        DATASET, F.lit("test").alias("data_part"), "n_features", "n_classes", "accuracy", "precision", "recall", "f1"
    )
