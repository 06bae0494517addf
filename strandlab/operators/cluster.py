"""k-means over many data sets and many restarts at once.

A data set that a task can hold is clustered where it lies, as many restarts
side by side; tasks share its restarts. A larger one is clustered in rounds, see
``lloyd``: the centres go to every task once, and only sums are shuffled. Both
ways use the same start points and the same update.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.functions import arrays
from strandlab.functions.keys import key_bucket, order_key, unit_uniform
from strandlab.functions.scalars import closest_power_of_2
from strandlab.operators import metrics, screen
from strandlab.operators.blocks import BLOCK_BYTES, matrix
from strandlab.operators.joining import join_small
from strandlab.operators.lloyd import GAP_NUMBERS, block_sums
from strandlab.operators.lloyd import fit_rounds as _fit_rounds
from strandlab.operators.seeding import SEEDINGS, chunks
from strandlab.operators.neighbours import nearest_centre
from strandlab.operators.ordering import number_rows
from strandlab.operators.prep import DATASET, LABEL, SERIES, SERIES_ID
from strandlab.operators.task_state import STATE_BYTES
from strandlab.session import materialise

# Fixed values of the standard clustering.
RESTARTS = 100
MAX_ROUNDS = 500
TOLERANCE = 1e-4
SEED = 42
DECOMPOSER_SEEDS = (1, 3, 5, 7, 9)

RANGES_PER_GROUP = 4
WHOLE_BYTES = 128 << 20  # of a data set that is clustered where it lies, where the centres of a restart have few numbers
TASK_PRODUCTS = 1 << 31  # products of a row's numbers with those of the centres, in one round of the restarts of a task

_RESULT = f"{DATASET} string, restart int, inertia double, rounds int, centres array<array<double>>"


# --- interval features -------------------------------------------------------------------------


def draw_intervals(sizes: DataFrame, seed: int | None = None, key: str = DATASET) -> DataFrame:
    """Random intervals ``(start, len)`` per data set, from the seed (or a ``seed`` column) and the series length."""
    extra = [] if seed is not None else ["seed"]
    seed_col = F.lit(seed) if seed is not None else F.col("seed")
    count = closest_power_of_2("d", 2).cast("int") + 1
    least = F.greatest(F.lit(2), F.floor(F.col("d") * 0.05)).cast("bigint")
    drawn = sizes.withColumn("_least", least).select(
        key, "d", "_least", *extra, F.explode(F.sequence(F.lit(0), count - 1)).alias("interval")
    )
    u = lambda what: unit_uniform(order_key(seed_col, key, "interval", F.lit(what)))
    started = drawn.withColumn("start", F.floor(u("start") * (F.col("d") - F.col("_least"))))
    span = F.col("d") - F.col("start") - F.col("_least")
    return started.withColumn("len", F.col("_least") + F.floor(u("len") * span)).select(
        key, *extra, F.col("interval").cast("bigint").alias("interval"), "start", "len"
    )


def interval_features(df: DataFrame, intervals: DataFrame, key: str = DATASET, series: str = SERIES) -> DataFrame:
    """Replace every series by its interval means (``features``), in interval order."""
    extra = ["seed"] if "seed" in intervals.columns else []
    packed = intervals.groupBy(key, *extra).agg(
        F.sort_array(F.collect_list(F.struct("interval", "start", "len"))).alias("_intervals")
    )
    means = F.transform(
        "_intervals",
        lambda i: arrays.total(F.slice(series, (i["start"] + 1).cast("int"), i["len"].cast("int"))) / i["len"],
    )
    width = F.size("_intervals") * 3
    if extra:  # one row per seed: the seeds of a data set travel together
        seeds = packed.groupBy(key).agg(F.collect_list(F.struct(*extra, "_intervals")).alias("_seeds"))
        joined = join_small(df, seeds, key, numbers=F.size("_seeds") * F.size(F.col("_seeds")[0]["_intervals"]) * 3)
        df = joined.withColumn("_s", F.explode("_seeds")).select(*df.columns, "_s.*")
    else:
        df = join_small(df, packed, key, numbers=width)
    return df.withColumn("features", means).drop("_intervals")


# --- one round as a table expression -----------------------------------------------------------


def first_centres(df: DataFrame, k_table: DataFrame, seed: int = SEED, key: str = DATASET, series: str = SERIES) -> DataFrame:
    """The ``k`` rows of least order key of every data set as start centres."""
    # only keys are ordered; the vectors are looked up for the rows that win
    keyed = df.select(key, SERIES_ID, order_key(seed, SERIES_ID).alias("_key"))
    placed = number_rows(keyed, [key], ["_key"], key_bucket(F.col("_key")), "_place", per_group=k_table)
    chosen = placed.where(F.col("_place") <= F.col("k")).select(key, SERIES_ID, (F.col("_place") - 1).alias("cluster"))
    return df.select(key, SERIES_ID, F.col(series).alias("centre")).join(chosen, [key, SERIES_ID]).drop(SERIES_ID)


def lloyd_steps(df: DataFrame, centres: DataFrame, steps: int = 1, key: str = DATASET, series: str = SERIES) -> DataFrame:
    """Centres after a fixed number of rounds; a cluster without rows is dropped."""
    for _ in range(steps):
        assigned = nearest_centre(df.select(key, SERIES_ID, series), centres, key, series)
        centres = metrics.centres(assigned, (key, "cluster"), series).drop("n")
    return centres


# --- many restarts -----------------------------------------------------------------------------


def settings_of(df: DataFrame, tol: float, key: str = DATASET) -> DataFrame:
    """Rows, length, number of classes and absolute tolerance per data set."""
    classes = df.groupBy(key, LABEL).agg(F.lit(1).alias("_one")).groupBy(key).agg(F.count(LABEL).alias("k"))
    spread = vector_to_array(Summarizer.variance(array_to_vector(F.col(SERIES))))
    sizes = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size(SERIES)).cast("bigint").alias("d"), spread.alias("_var")
    )
    population = arrays.total("_var") / F.col("d") * (F.col("n") - 1) / F.col("n")
    return sizes.withColumn("tol", population * tol).drop("_var").join(classes, key)


def _fit_small(
    df: DataFrame, small: DataFrame, restarts: int, seed: int, max_iter: int, tasks: int | None, key: str, seeding: str
) -> DataFrame:
    """Cluster the data sets that a task can hold; ``tasks`` tasks share the restarts of one data set."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if tasks is None:
        for_cores = F.lit(-(-2 * cores // small.count()))
        for_work = F.ceil(restarts * F.col("n") * F.col("d") * F.col("k") / TASK_PRODUCTS)
        share = F.least(F.lit(restarts), F.greatest(for_cores, for_work)).cast("int")
    else:
        share = F.lit(tasks)
    small = small.withColumn("_tasks", share)
    groups = small.agg(F.sum("_tasks")).first()[0]
    rows = join_small(df.select(key, SERIES_ID, SERIES), small.select(key, "k", "tol", "_tasks"), key, written=True)
    copied = rows.withColumn("_task", F.explode(F.sequence(F.lit(0), F.col("_tasks") - 1)))
    start = SEEDINGS[seeding]

    def fit(keys: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by(SERIES_ID)
        x, ids = matrix(table), table[SERIES_ID].to_numpy()
        k, tol, tasks = (table[c][0].as_py() for c in ("k", "tol", "_tasks"))
        own, side, out = range(keys[1].as_py(), restarts, tasks), screen.side_by_side(k, len(x)), []
        for lo in range(0, len(own), side):
            starts = np.stack([start(x, ids, k, seed, restart) for restart in own[lo : lo + side]])
            for restart, centres, rounds in zip(own[lo : lo + side], *screen.fit(x, starts, tol, max_iter)):
                inertia = sum(float(block_sums(x[a:b], centres)[2].sum()) for a, b in chunks(x))
                out.append((restart, inertia, int(rounds), centres.tolist()))
        return pa.table({
            key: pa.array([keys[0].as_py()] * len(out), pa.string()),
            "restart": pa.array([o[0] for o in out], pa.int32()),
            "inertia": pa.array([o[1] for o in out], pa.float64()),
            "rounds": pa.array([o[2] for o in out], pa.int32()),
            "centres": pa.array([o[3] for o in out], pa.list_(pa.list_(pa.float64()))),
        })

    # ranges of rows and not hashes, so that groups of many rows do not meet in one task
    parts = min(RANGES_PER_GROUP * groups, 2 * RANGES_PER_GROUP * cores)
    return copied.repartitionByRange(max(1, parts), key, "_task").groupBy(key, "_task").applyInArrow(fit, _RESULT)


def kmeans(
    df: DataFrame,
    restarts: int = RESTARTS,
    seed: int = SEED,
    max_iter: int = MAX_ROUNDS,
    tol: float = TOLERANCE,
    block_bytes: int | None = None,
    tasks: int | None = None,
    key: str = DATASET,
    seeding: str = "oversampled",
    state_bytes: int = STATE_BYTES,
) -> DataFrame:
    """All restarts of all data sets: ``inertia``, ``rounds`` and ``centres`` per data set and restart.

    The number of clusters is the number of labels of the data set. A small
    data set, of at most ``block_bytes`` or else ``WHOLE_BYTES`` (one block
    where centres are wide enough for gaps, see ``lloyd``), is copied to
    several tasks only while there are fewer data sets than cores, or where its
    restarts are too much work for one; the result does not depend on
    ``tasks``. ``seeding`` is
    ``oversampled``, which reads a large data set a fixed number of times, or
    ``one_by_one``, which reads it once per start point.
    """
    settings = materialise(settings_of(df, tol, key), "kmeans-settings", 1)
    is_wide = F.col("k") * F.col("d") >= GAP_NUMBERS
    most = F.lit(block_bytes) if block_bytes is not None else F.when(is_wide, BLOCK_BYTES).otherwise(WHOLE_BYTES)
    fits_in_task = F.col("n") * F.col("d") * 8 <= most
    small, large = settings.where(fits_in_task), settings.where(~fits_in_task)
    fitted = None
    if not small.isEmpty():
        fitted = _fit_small(df, small, restarts, seed, max_iter, tasks, key, seeding)
    if not large.isEmpty():
        rounds = _fit_rounds(df, large, restarts, seed, max_iter, block_bytes or BLOCK_BYTES, key, seeding, state_bytes)
        fitted = rounds if fitted is None else fitted.unionByName(rounds)
    if fitted is None:
        return df.sparkSession.createDataFrame([], _RESULT)
    return fitted


def best_restart(fits: DataFrame, key: str = DATASET) -> DataFrame:
    """Restart of least inertia per data set, the first on a tie."""
    row = F.struct("inertia", "restart", "rounds", "centres")
    return fits.groupBy(key).agg(F.min_by(row, F.struct("inertia", "restart")).alias("_b")).select(key, "_b.*")


def centre_rows(best: DataFrame, key: str = DATASET) -> DataFrame:
    return best.select(key, F.posexplode("centres").alias("cluster", "centre"))


def cluster_rows(df: DataFrame, best: DataFrame, key: str = DATASET, series: str = SERIES) -> DataFrame:
    """Cluster of every row under the best restart."""
    return nearest_centre(df, centre_rows(best, key), key, series)
