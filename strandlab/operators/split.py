"""Exact seeded stratified splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlab.functions.keys import key_bucket, order_key
from strandlab.operators.joining import join_small
from strandlab.operators.prep import DATASET, LABEL, PART, SERIES_ID, drop_singleton_classes
from strandlab.session import materialise

# Shares and seed of the standard plan.
TEST_SHARE = 0.50
VALID_SHARE = 0.35
SPLIT_SEED = 42


def class_quotas(counts: DataFrame, share: float, dataset: str = DATASET, label: str = LABEL) -> DataFrame:
    """Rows of every class that stay in the larger side, by largest remainder.

    ``counts`` has ``n_class`` rows per data set and class. Integer arithmetic,
    so that the remainders are exact.
    """
    per_set = W.partitionBy(dataset)
    big = lambda c: F.col(c).cast("decimal(19,0)")
    sized = counts.withColumn("n", F.sum("n_class").over(per_set)).withColumn(
        "n_train", F.col("n") - F.ceil(F.lit(share) * F.col("n"))
    )
    scaled = sized.withColumn("scaled", big("n_class") * big("n_train"))
    based = scaled.withColumn("base", F.expr("scaled div n")).withColumn("rest", F.col("scaled") % big("n"))
    by_rest = per_set.orderBy(F.desc("rest"), F.asc(label))
    placed = based.withColumn("missing", F.col("n_train") - F.sum("base").over(per_set)).withColumn(
        "place", F.row_number().over(by_rest)
    )
    extra = F.when(F.col("place") <= F.col("missing"), 1).otherwise(0)
    return placed.select(dataset, label, (F.col("base") + extra).cast("bigint").alias("quota"))


def class_thresholds(
    df: DataFrame, share: float, seed: int, dataset: str = DATASET, label: str = LABEL, key: str = SERIES_ID
) -> DataFrame:
    """Order key of the last row that stays in the larger side, per data set and class (null: no row stays).

    One scan counts key buckets; a second looks only at the bucket in which
    the quota of a class is reached.
    """
    classes = [dataset, label]
    keyed = df.select(*classes, key, order_key(seed, key).alias("_key"))
    keyed = keyed.withColumn("_bucket", key_bucket(F.col("_key")))
    buckets = materialise(keyed.groupBy(*classes, "_bucket").agg(F.count(F.lit(1)).alias("_n")), "split-buckets")
    quotas = class_quotas(buckets.groupBy(*classes).agg(F.sum("_n").alias("n_class")), share, dataset, label)
    upto = F.sum("_n").over(W.partitionBy(*classes).orderBy("_bucket"))
    reached = buckets.withColumn("_upto", upto).join(quotas, classes)
    reached = reached.where((F.col("_upto") - F.col("_n") < F.col("quota")) & (F.col("quota") <= F.col("_upto")))
    wanted = reached.select(*classes, "_bucket", (F.col("quota") - F.col("_upto") + F.col("_n")).alias("_place"))
    near = join_small(keyed, wanted, [*classes, "_bucket"], row_key=key)
    place = F.row_number().over(W.partitionBy(*classes, "_bucket").orderBy("_key", key))
    last = near.withColumn("_row", place).where(F.col("_row") == F.col("_place"))
    last = last.select(*classes, F.struct("_key", key).alias("_last"))
    return quotas.select(*classes).join(last, classes, "left")


def stratified_split(
    df: DataFrame,
    share: float,
    names: Sequence[str] = ("train", "test"),
    seed: int = SPLIT_SEED,
    dataset: str = DATASET,
    label: str = LABEL,
    key: str = SERIES_ID,
    part: str = PART,
) -> DataFrame:
    """Add ``part``: ``names[1]`` gets ``ceil(share * n)`` rows of every data set, class shares kept.

    The rows of a class are ordered by md5 of seed and key, so the split does
    not change with the partitioning. Once the thresholds of the classes are
    known, every row decides for itself: the rows are not shuffled.
    """
    thresholds = class_thresholds(df, share, seed, dataset, label, key)
    marked = join_small(df, thresholds, [dataset, label], numbers=F.lit(8), row_key=key)
    stays = F.coalesce(F.struct(order_key(seed, key).alias("_key"), key) <= F.col("_last"), F.lit(False))
    return marked.withColumn(part, F.when(stays, names[0]).otherwise(names[1])).drop("_last")


def split_parts(
    df: DataFrame,
    strategy: str = "manual",
    test_share: float = TEST_SHARE,
    valid_share: float = VALID_SHARE,
    seed: int = SPLIT_SEED,
) -> DataFrame:
    """Train, valid and test parts.

    ``manual`` merges what is given and splits anew; ``as_defined`` keeps a
    given ``part`` of train and test. Validation rows come out of train, after
    classes with a single train row are dropped.
    """
    if strategy == "manual":
        halves = stratified_split(df.drop(PART) if PART in df.columns else df, test_share, ("train", "test"), seed)
    elif strategy == "as_defined":
        halves = df
    else:
        raise ValueError(f"unknown split strategy: {strategy}")
    test = halves.where(F.col(PART) == "test")
    train = halves.where(F.col(PART) == "train").drop(PART)
    if valid_share <= 0:
        return halves
    tuned = stratified_split(drop_singleton_classes(train), valid_share, ("train", "valid"), seed)
    return tuned.unionByName(test)
