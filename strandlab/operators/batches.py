"""Fixed-size batches of series and what is computed inside a batch.

A batch has a fixed, small number of rows, so a batch may be one array.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlab.functions import arrays
from strandlab.functions.keys import key_bucket, order_key, unit_uniform
from strandlab.operators.ordering import number_rows, with_value_bucket
from strandlab.operators.prep import DATASET, SERIES, SERIES_ID

BATCH_SIZE = 8


def shuffled(df: DataFrame, seed: int, epoch: int = 0, keys: Sequence[str] = (DATASET,), name: str = "place") -> DataFrame:
    """Seeded random place of every row of a data set, from 1, anew for every epoch."""
    keyed = df.withColumn("_key", order_key(f"{seed}-{epoch}", SERIES_ID))
    return number_rows(keyed, keys, ["_key", SERIES_ID], key_bucket(F.col("_key")), name).drop("_key")


def in_order(df: DataFrame, keys: Sequence[str] = (DATASET,), name: str = "place") -> DataFrame:
    """Place by ``series_id``, whatever the gaps between the ids."""
    cut = with_value_bucket(df, SERIES_ID, "_range")
    return number_rows(cut, keys, [SERIES_ID], F.col("_range"), name).drop("_range")


def with_batches(placed: DataFrame, size: int = BATCH_SIZE, place: str = "place") -> DataFrame:
    return placed.withColumn("batch_id", F.floor((F.col(place) - 1) / size).cast("bigint"))


def pad_last_batch(batched: DataFrame, size: int = BATCH_SIZE, keys: Sequence[str] = (DATASET,)) -> DataFrame:
    """Repeat the last row of a short batch until the batch is full; adds ``copy`` (0 = the row itself)."""
    rest = [c for c in batched.columns if c not in keys]
    # the last row of every data set, found by an aggregate: no join, no sort
    ends = batched.groupBy(*keys).agg(F.max_by(F.struct(*rest), "place").alias("_last")).select(*keys, "_last.*")
    short = ends.where(F.col("place") % size != 0).select(*batched.columns)
    missing = (F.lit(size) - F.col("place") % size).cast("int")
    copies = short.withColumn("copy", F.explode(F.sequence(F.lit(1), missing)))
    return batched.withColumn("copy", F.lit(0)).unionByName(copies)


def batch_partners(batched: DataFrame, seed: int, keys: Sequence[str] = (DATASET,)) -> DataFrame:
    """Random permutation inside every batch: row ``i`` is paired with the row at place ``i`` of the permutation."""
    permuted = F.struct(order_key(seed, "batch_id", SERIES_ID).alias("key"), SERIES_ID, SERIES)
    ordered = F.struct("place", SERIES_ID, SERIES)
    packed = batched.groupBy(*keys, "batch_id").agg(
        F.sort_array(F.collect_list(ordered)).alias("_first"),
        F.sort_array(F.collect_list(permuted)).alias("_second"),
    )
    pairs = packed.select(*keys, "batch_id", F.explode(F.arrays_zip("_first", "_second")).alias("_p"))
    return pairs.select(
        *keys,
        "batch_id",
        F.col(f"_p._first.{SERIES_ID}").alias(SERIES_ID),
        F.col(f"_p._second.{SERIES_ID}").alias("partner_id"),
        F.col(f"_p._first.{SERIES}").alias("series_1"),
        F.col(f"_p._second.{SERIES}").alias("series_2"),
    )


DRAWS = 16


def gamma_draw(key: Column, tag: str, shape: float) -> Column:
    """Gamma number of a key, by rejection: the first accepted of ``DRAWS`` tries, each refused in less than 1 of 20 cases.

    Shapes below 1 are drawn one higher and scaled back by a power of another uniform number.
    """
    d = (shape + 1 if shape < 1 else shape) - 1 / 3
    c = 1 / math.sqrt(9 * d)
    number = lambda what, i: unit_uniform(order_key(key, F.lit(f"{tag}{what}"), i))

    def tried(i: Column) -> Column:
        normal = F.sqrt(-2 * F.log(number("n", i))) * F.cos(2 * math.pi * number("m", i))
        return F.struct(normal.alias("x"), F.pow(1 + c * normal, F.lit(3.0)).alias("v"), number("u", i).alias("u"))

    def accepted(t: Column) -> Column:
        room = 0.5 * t["x"] * t["x"] + d - d * t["v"] + d * F.log(F.greatest(t["v"], F.lit(1e-300)))
        return (t["v"] > 0) & (F.log(t["u"]) < room)

    tries = F.filter(F.transform(F.sequence(F.lit(0), F.lit(DRAWS - 1)), tried), accepted)
    drawn = F.coalesce(F.get(tries, 0)["v"], F.lit(1.0)) * d
    return drawn * F.pow(number("p", F.lit(0)), F.lit(1 / shape)) if shape < 1 else drawn


def mix_share(seed: int, alpha: float = 1.0, keys: Sequence[str] = (DATASET,)) -> Column:
    """One Beta(alpha, alpha) share per batch. Beta(1, 1) is the uniform number of the batch key."""
    key = order_key(f"{seed}-mix", *keys, "batch_id")
    if alpha == 1.0:
        return unit_uniform(key)

    both = F.struct(gamma_draw(key, "a", alpha).alias("a"), gamma_draw(key, "b", alpha).alias("b"))
    # both may vanish for a tiny alpha; the share is then one of the ends
    return arrays.let(both, lambda g: F.when(g["a"] + g["b"] > 0, g["a"] / (g["a"] + g["b"])).otherwise(F.round(unit_uniform(key))))


def mixed_rows(pairs: DataFrame, seed: int, alpha: float = 1.0, keys: Sequence[str] = (DATASET,)) -> DataFrame:
    """Mixed series ``share * x1 + (1 - share) * x2`` with the share of the batch."""
    # exploded, so that the share is drawn once per row and not once per step
    shared = pairs.withColumn("share", F.explode(F.array(mix_share(seed, alpha, keys))))
    return shared.withColumn("mixed", arrays.mix("series_1", "series_2", "share"))


def batch_similarities(mixed: DataFrame, keys: Sequence[str] = (DATASET,), against: str = "series_1") -> DataFrame:
    """Per row the dot products of its mixed vector with the vectors of its batch, in ``series_id`` order."""
    packed = mixed.groupBy(*keys, "batch_id").agg(
        F.sort_array(F.collect_list(F.struct(SERIES_ID, "mixed", against))).alias("_rows")
    )
    rows = packed.select(*keys, "batch_id", "_rows", F.explode("_rows").alias("_row"))
    sims = F.transform("_rows", lambda r: arrays.dot(F.col("_row.mixed"), r[against]))
    return rows.select(*keys, "batch_id", F.col(f"_row.{SERIES_ID}").alias(SERIES_ID), sims.alias("similarities"))


def contrastive_loss(mixed: DataFrame, temperature: float = 0.5, keys: Sequence[str] = (DATASET,)) -> DataFrame:
    """Mixing loss per batch.

    Every mixed row is compared with both source vectors of every row of the
    batch; the soft target has the share on its own first source and the rest
    on its own second source.
    """
    unit = mixed.select(
        *keys, "batch_id", SERIES_ID, "share",
        arrays.l2_normalise("mixed").alias("z"),
        arrays.l2_normalise("series_1").alias("z1"),
        arrays.l2_normalise("series_2").alias("z2"),
    )
    packed = unit.groupBy(*keys, "batch_id").agg(
        F.first("share").alias("share"),
        F.sort_array(F.collect_list(F.struct(SERIES_ID, "z", "z1", "z2"))).alias("_rows"),
    )

    rows = packed.select(*keys, "batch_id", "share", "_rows", F.posexplode("_rows").alias("_i", "_row"))
    against = lambda side: F.transform("_rows", lambda r: arrays.dot(F.col("_row.z"), r[side]) / F.lit(temperature))
    scored = rows.select(
        *keys, "batch_id", "share", "_i", F.size("_rows").alias("_n"),
        F.concat(against("z1"), against("z2")).alias("_logits"),
    ).withColumn("_log", arrays.log_softmax("_logits"))
    picked = F.col("share") * F.get("_log", F.col("_i")) + (1 - F.col("share")) * F.get("_log", F.col("_i") + F.col("_n"))
    return scored.groupBy(*keys, "batch_id").agg(F.avg(-picked).alias("loss"))
