"""Training logs: epoch means, early stopping, checkpoint choice. One row per model and epoch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MODEL_KEYS = ("dataset_name", "model_name")


def early_stopping_settings(max_epochs: int, profile: str = "default") -> dict:
    """Fixed values of the two training profiles."""
    if profile == "default":
        return {"min_delta": 0.0005, "patience": max_epochs // 10}
    if profile == "contrastive":
        return {"min_delta": 0.0001, "patience": max_epochs // 2}
    raise ValueError(f"unknown profile: {profile}")


def epoch_means(steps: DataFrame, keys: Sequence[str] = MODEL_KEYS) -> DataFrame:
    """Epoch loss from step losses, weighted by the batch size."""
    return steps.groupBy(*keys, "epoch").agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"))


def running_best(log: DataFrame, loss: str = "val_loss", keys: Sequence[str] = MODEL_KEYS) -> DataFrame:
    """Least and greatest loss so far. A window holds the epochs of one model only."""
    so_far = W.partitionBy(*keys).orderBy("epoch").rowsBetween(W.unboundedPreceding, 0)
    return log.withColumn("best_so_far", F.min(loss).over(so_far)).withColumn("worst_so_far", F.max(loss).over(so_far))


def early_stop(
    log: DataFrame, min_delta: float, patience: int, loss: str = "val_loss", keys: Sequence[str] = MODEL_KEYS
) -> DataFrame:
    """Epoch in which training stops, or null, with the best loss and epoch up to then.

    The best loss only moves on a gain above ``min_delta``, so this is a fold
    over the epochs in order and not a running minimum.
    """
    state = "struct<best double, best_epoch bigint, misses bigint, stop_epoch bigint>"
    start = F.struct(
        F.lit(float("inf")).alias("best"),
        F.lit(None).cast("bigint").alias("best_epoch"),
        F.lit(0).cast("bigint").alias("misses"),
        F.lit(None).cast("bigint").alias("stop_epoch"),
    ).cast(state)

    def step(s, e):
        better = e["loss"] + F.lit(min_delta) < s["best"]
        misses = F.when(better, F.lit(0).cast("bigint")).otherwise(s["misses"] + 1)
        moved = F.struct(
            F.when(better, e["loss"]).otherwise(s["best"]).alias("best"),
            F.when(better, e["epoch"]).otherwise(s["best_epoch"]).alias("best_epoch"),
            misses.alias("misses"),
            F.when(misses >= patience, e["epoch"]).alias("stop_epoch"),
        ).cast(state)
        return F.when(s["stop_epoch"].isNotNull(), s).otherwise(moved)

    epochs = F.struct(F.col("epoch").cast("bigint").alias("epoch"), F.col(loss).cast("double").alias("loss"))
    ordered = log.groupBy(*keys).agg(F.sort_array(F.collect_list(epochs)).alias("_log"))
    return ordered.withColumn("_end", F.aggregate("_log", start, step)).select(
        *keys,
        F.col("_end.best").alias("best_loss"),
        F.col("_end.best_epoch").alias("best_epoch"),
        F.col("_end.misses").alias("misses"),
        F.col("_end.stop_epoch").alias("stop_epoch"),
    )


def best_checkpoint(log: DataFrame, loss: str = "val_loss", keys: Sequence[str] = MODEL_KEYS) -> DataFrame:
    """Row of the least loss (earliest on ties); the last epoch where no loss is known."""
    row = F.struct(*[F.col(c) for c in log.columns if c not in keys])
    usable = F.col(loss).isNotNull() & ~F.isnan(loss)
    best = F.min_by(row, F.when(usable, F.struct(F.col(loss), F.col("epoch"))))
    picked = F.coalesce(best, F.max_by(row, F.col("epoch"))).alias("_row")
    return log.groupBy(*keys).agg(picked).select(*keys, "_row.*")


def final_checkpoint(log: DataFrame, keys: Sequence[str] = MODEL_KEYS) -> DataFrame:
    row = F.struct(*[F.col(c) for c in log.columns if c not in keys])
    return log.groupBy(*keys).agg(F.max_by(row, F.col("epoch")).alias("_row")).select(*keys, "_row.*")


def best_setting(scores: DataFrame, keys: Sequence[str], setting: str, score: str) -> DataFrame:
    """Setting of the highest score; the least setting wins a tie, as the first of an ascending grid."""
    order = F.struct(F.col(score), -F.col(setting))
    return scores.groupBy(*keys).agg(F.max_by(setting, order).alias(setting), F.max(score).alias(score))
