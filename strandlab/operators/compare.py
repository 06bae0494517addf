"""Comparison of algorithms over data sets and runs.

A metric table is long: ``dataset_name, algorithm, run, value``. One block is
one run of one data set and holds one value per algorithm.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from strandlab.functions.scalars import mean_std_text
from strandlab.functions.tails import computed_critical_value
from strandlab.operators.ordering import running_total
from strandlab.operators.prep import DATASET

BLOCK = (DATASET, "run")

# Critical values q for k = 2, 3, 4, ... algorithms.
CRITICAL_VALUES = {
    ("nemenyi", 0.05): [
        1.959964, 2.343701, 2.569032, 2.727774, 2.849705, 2.94832, 3.030879, 3.101730, 3.163684, 3.218654,
        3.268004, 3.312739, 3.353618, 3.39123, 3.426041, 3.458425, 3.488685, 3.517073, 3.543799,
    ],
    ("nemenyi", 0.1): [
        1.644854, 2.052293, 2.291341, 2.459516, 2.588521, 2.692732, 2.779884, 2.854606, 2.919889, 2.977768,
        3.029694, 3.076733, 3.119693, 3.159199, 3.195743, 3.229723, 3.261461, 3.291224, 3.319233,
    ],
    ("bonferroni-dunn", 0.05): [1.960, 2.241, 2.394, 2.498, 2.576, 2.638, 2.690, 2.724, 2.773],
    ("bonferroni-dunn", 0.1): [1.645, 1.960, 2.128, 2.241, 2.326, 2.394, 2.450, 2.498, 2.539],
}


# --- tables ------------------------------------------------------------------------------------


def run_lists(cells: DataFrame, keys: Sequence[str] = (DATASET, "algorithm")) -> DataFrame:
    """Values of all runs as one list per data set and algorithm, in run order (as long as there are runs)."""
    packed = F.sort_array(F.collect_list(F.struct("run", "value")))
    return cells.groupBy(*keys).agg(packed.alias("_p")).select(*keys, F.col("_p.value").alias("values"))


def mean_std(cells: DataFrame, keys: Sequence[str] = (DATASET, "algorithm")) -> DataFrame:
    return cells.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def mean_std_cells(cells: DataFrame, keys: Sequence[str] = (DATASET, "algorithm")) -> DataFrame:
    return mean_std(cells, keys).select(*keys, mean_std_text("mean", "std").alias("text"))


def wide(long: DataFrame, columns: Sequence[str], value: str = "value", row: str = DATASET, by: str = "algorithm") -> DataFrame:
    """One column per algorithm. The names are given, so no extra job looks for them."""
    return long.groupBy(row).pivot(by, list(columns)).agg(F.first(value))


def side_by_side(*tables: DataFrame, key: str = DATASET) -> DataFrame:
    """Full outer join of wide metric tables; a data set missing on one side has nulls there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, key, "full")
    return out


def mean_over_runs(cells: DataFrame) -> DataFrame:
    """One block per data set instead of one per run."""
    return cells.groupBy(DATASET, "algorithm").agg(F.avg("value").alias("value")).withColumn("run", F.lit(0))


# --- blocks and ranks --------------------------------------------------------------------------


def _present() -> Column:
    """A value that counts: neither null nor NaN."""
    return F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))


def _one_cell_each(cells: DataFrame) -> DataFrame:
    """Fails on a block that holds an algorithm twice."""
    times = F.count(F.lit(1)).over(W.partitionBy(*BLOCK, "algorithm"))
    message = F.concat(
        F.lit("more than one value of "), F.col("algorithm"), F.lit(" in data set "), F.col(DATASET), F.lit(", run "), F.col("run").cast("string")
    )
    return cells.withColumn("_times", times).where(F.when(F.col("_times") > 1, F.raise_error(message).cast("boolean")).otherwise(True)).drop("_times")


def block_report(cells: DataFrame, algorithms: Sequence[str]) -> DataFrame:
    """Blocks with their number of different algorithms, of repeated cells, and whether each algorithm is there exactly once.

    A null or NaN value counts as missing.
    """
    return (
        cells.where(F.col("algorithm").isin(list(algorithms)))
        .groupBy(*BLOCK, "algorithm")
        .agg(F.count_if(_present()).alias("_n"), F.count(F.lit(1)).alias("_rows"))
        .groupBy(*BLOCK)
        .agg(F.count_if(F.col("_n") > 0).alias("n_algorithms"), F.sum(F.col("_rows") - 1).alias("n_repeated"))
        .withColumn("complete", (F.col("n_algorithms") == len(set(algorithms))) & (F.col("n_repeated") == 0))
    )


def complete_blocks(cells: DataFrame, algorithms: Sequence[str]) -> DataFrame:
    """Cells of the blocks that hold a value of every algorithm. The window sees one block, so one row per algorithm.

    A null or NaN value counts as missing; a block with two rows of one algorithm is an error.
    """
    listed = _one_cell_each(cells.where(F.col("algorithm").isin(list(algorithms))))
    counted = listed.withColumn("_k", F.count_if(_present()).over(W.partitionBy(*BLOCK)))
    return counted.where(F.col("_k") == len(set(algorithms))).drop("_k")


def ranked(cells: DataFrame, higher_is_better: bool = True) -> DataFrame:
    """Rank in the block, 1 is best; equal values share their mean rank. Adds ``ties``, rows of equal value.

    A NaN ranks last whichever side is better, and a null after it.
    """
    failed = F.when(F.col("value").isNull(), 2).when(F.isnan(F.col("value").cast("double")), 1).otherwise(0)
    order = F.desc("value") if higher_is_better else F.asc("value")
    in_block = W.partitionBy(*BLOCK).orderBy(failed, order)
    first = F.rank().over(in_block)
    ties = F.count(F.lit(1)).over(W.partitionBy(*BLOCK, "value"))
    return cells.withColumn("ties", ties).withColumn("_first", first).withColumn(
        "rank", F.col("_first") + (F.col("ties") - 1) / 2
    ).drop("_first")


def average_ranks(cells: DataFrame, higher_is_better: bool = True) -> DataFrame:
    return ranked(cells, higher_is_better).groupBy("algorithm").agg(F.avg("rank").alias("avg_rank"))


def _chi_square_tail(x: float, dof: int) -> float:
    """Finite sums for whole degrees of freedom, added up in logs so that many algorithms do not overflow."""
    if math.isnan(x) or dof < 1:
        return math.nan
    half = x / 2.0
    if half <= 0:
        return 1.0
    odd = dof % 2
    steps = [(i - 0.5 * odd) * math.log(half) - half - math.lgamma(i - 0.5 * odd + 1) for i in range(odd, (dof + odd) // 2)]
    return (math.erfc(math.sqrt(half)) if odd else 0.0) + math.fsum(math.exp(t) for t in steps)


@F.pandas_udf(T.DoubleType())
def chi_square_tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution; called on single result rows."""
    found = [None if pd.isna(a) else _chi_square_tail(float(a), int(b)) for a, b in zip(x, dof)]
    return pd.Series(found, dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return pd.Series([math.erfc(abs(float(a)) / math.sqrt(2.0)) for a in z], dtype="float64")


def _signed_rank_tail(t: float, n: int) -> float:
    """Two-sided p of the signed-rank statistic from its exact distribution (no ties)."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        for s in range(len(ways) - 1, rank - 1, -1):
            ways[s] += ways[s - rank]
    return min(1.0, 2.0 * sum(ways[: int(t) + 1]) / 2.0**n)


@F.pandas_udf(T.DoubleType())
def signed_rank_tail(t: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([_signed_rank_tail(float(a), int(b)) for a, b in zip(t, n)], dtype="float64")


def friedman(cells: DataFrame, higher_is_better: bool = True) -> DataFrame:
    """Tie-corrected Friedman statistic of complete blocks, one row with ``statistic`` and ``p_value``.

    Both are null where every block ties all its values, or where there is no block or one algorithm only.
    """
    sums = ranked(cells, higher_is_better).groupBy("algorithm").agg(
        F.sum("rank").alias("_r"),
        F.count(F.lit(1)).alias("_n"),
        # the rows of a tie of t values add up to t^3 - t
        F.sum(F.col("ties") * F.col("ties") - 1).alias("_t"),
    )
    one = sums.agg(
        F.count(F.lit(1)).alias("k"),
        F.max("_n").alias("n_blocks"),
        F.sum(F.col("_r") * F.col("_r")).alias("_r2"),
        F.sum("_t").alias("_ties"),
    )
    k, n = F.col("k").cast("double"), F.col("n_blocks").cast("double")
    raw = F.try_divide(F.lit(12.0), k * n * (k + 1)) * F.col("_r2") - 3.0 * n * (k + 1)
    correction = 1.0 - F.try_divide(F.col("_ties").cast("double"), n * k * (k * k - 1))
    # a correction of 0 up to rounding: nothing is ranked
    told_apart = (F.col("k") > 1) & (F.abs(correction) > 1e-12)
    out = one.withColumn("statistic", F.when(told_apart, F.try_divide(raw, correction)))
    p_value = F.when(F.col("statistic").isNotNull(), chi_square_tail("statistic", F.col("k") - 1))
    return out.select("k", "n_blocks", "statistic", p_value.alias("p_value"))


def critical_value(test: str, alpha: float, k: Column) -> Column:
    """Critical value for ``k`` algorithms; a number of algorithms without one is an error."""
    if (test, alpha) not in CRITICAL_VALUES:
        raise ValueError(f"no critical values for {test} at {alpha}")
    table = CRITICAL_VALUES[test, alpha]
    pairs = [F.lit(x) for n, q in enumerate(table, start=2) for x in (n, q)]
    message = F.concat(F.lit(f"critical values for {test} at {alpha} reach from 2 to {len(table) + 1} algorithms, not "), k.cast("string"))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), k.cast("int")), F.raise_error(message).cast("double"))


def _critical_difference(test: str, alpha: float, computed: bool) -> Column:
    k, n = F.col("k"), F.col("n_blocks")
    value = computed_critical_value(test, alpha, k) if computed else critical_value(test, alpha, k)
    return F.when(n > 0, value * F.sqrt(k * (k + 1) / (6.0 * n)))


def critical_difference(cells: DataFrame, test: str = "nemenyi", alpha: float = 0.05, computed: bool = False) -> DataFrame:
    """One row: algorithms, blocks and the least rank gap that counts as different (null without blocks).

    With ``computed`` the critical value is integrated, for any number of algorithms and any level, and not looked up.
    """
    per = cells.groupBy("algorithm").agg(F.count(F.lit(1)).alias("_n"))
    one = per.agg(F.count(F.lit(1)).alias("k"), F.max("_n").alias("n_blocks"))
    return one.withColumn("cd", _critical_difference(test, alpha, computed))


def rank_summary(
    cells: DataFrame, test: str = "nemenyi", alpha: float = 0.05, higher_is_better: bool = True, computed: bool = False
) -> DataFrame:
    """One row: all average ranks in order, with the critical difference. As many entries as algorithms."""
    per = ranked(cells, higher_is_better).groupBy("algorithm").agg(
        F.avg("rank").alias("avg_rank"), F.count(F.lit(1)).alias("_n")
    )
    one = per.agg(
        F.sort_array(F.collect_list(F.struct("avg_rank", "algorithm"))).alias("ranks"), F.max("_n").alias("n_blocks")
    ).withColumn("k", F.size("ranks"))
    return one.withColumn("cd", _critical_difference(test, alpha, computed))


def indistinct_groups(summary: DataFrame) -> DataFrame:
    """Longest runs of algorithms, in rank order, whose ends differ by no more than the critical difference."""
    reach = F.transform(
        "ranks",
        lambda a: F.size(F.filter("ranks", lambda b: b["avg_rank"] - a["avg_rank"] <= F.col("cd"))) - 1,
    )
    ends = summary.withColumn("_reach", reach).select("ranks", "_reach", F.posexplode("_reach").alias("first", "last"))
    longest = (F.col("first") == 0) | (F.get("_reach", F.col("first") - 1) < F.col("last"))
    return ends.where((F.col("last") > F.col("first")) & longest).select(
        F.col("first").cast("bigint").alias("first"),
        F.col("last").cast("bigint").alias("last"),
        F.get("ranks", F.col("first"))["algorithm"].alias("best"),
        F.get("ranks", F.col("last"))["algorithm"].alias("worst"),
    )


def ranks_with_significance(
    cells: DataFrame, test: str = "nemenyi", alpha: float = 0.05, higher_is_better: bool = True
) -> DataFrame:
    """Average ranks next to the Friedman p-value and the critical difference, so that both gates can be read off.

    ``gap`` is the distance to the best algorithm; beyond ``cd`` it counts as different.
    """
    key = F.lit(1).alias("_one")
    summary = rank_summary(cells, test, alpha, higher_is_better).select("cd", "ranks", key)
    p_value = friedman(cells, higher_is_better).select("p_value", key)
    rows = summary.join(p_value, "_one").select("cd", "p_value", "ranks", F.explode("ranks").alias("_r"))
    gap = F.col("_r.avg_rank") - F.col("ranks")[0]["avg_rank"]
    return rows.select("_r.algorithm", "_r.avg_rank", gap.alias("gap"), "cd", "p_value")


def ranked_list(cells: DataFrame, gate: float = 0.05, higher_is_better: bool = True) -> DataFrame:
    """Algorithms by average rank; empty unless the Friedman test is significant."""
    significant = friedman(cells, higher_is_better).where(F.col("p_value") < gate).select(F.lit(1).alias("_gate"))
    ranks = average_ranks(cells, higher_is_better).withColumn("_gate", F.lit(1))
    return ranks.join(significant, "_gate", "left_semi").drop("_gate").orderBy("avg_rank", "algorithm")


# --- two algorithms ----------------------------------------------------------------------------


def paired(cells: DataFrame, first: str, second: str) -> DataFrame:
    """Values of two algorithms side by side, blocks with both only. NaN counts as missing; a repeated cell is an error."""
    pick = lambda name: F.max(F.when((F.col("algorithm") == name) & _present(), F.col("value")))
    both = _one_cell_each(cells.where(F.col("algorithm").isin(first, second))).groupBy(*BLOCK)
    return both.agg(pick(first).alias("a"), pick(second).alias("b")).where("a is not null and b is not null")


def signed_ranks(pairs: DataFrame) -> DataFrame:
    """Distinct absolute differences with their mean rank, count and positive count; zeros are left out.

    Equal differences are merged first, and the running count is cut into
    value buckets, so nothing is ordered in a single task.
    """
    gaps = pairs.select((F.col("a") - F.col("b")).alias("_d")).where(F.col("_d") != 0)
    sized = gaps.groupBy(F.abs("_d").alias("abs_d")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_d") > 0).alias("n_positive")
    )
    upto = running_total(sized, [], "abs_d", "n", "_upto")
    return upto.withColumn("rank", F.col("_upto") - (F.col("n") - 1) / 2).drop("_upto")


# most differences whose signs are gone through rank by rank
COUNTED_DIFFERENCES = 60


def _signs_tail(ranks: Column, statistic: Column) -> Column:
    """Two-sided p over all signs of the given ranks (ties have mean ranks): ways to each sum, one rank after the other.

    Mean ranks are halves, so sums are counted in halves.
    """
    doubled = F.transform(ranks, lambda r: F.round(r * 2).cast("int"))
    total = F.aggregate(doubled, F.lit(0), lambda s, r: s + r)
    start = F.transform(F.sequence(F.lit(0), total), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    one_more = lambda ways, r: F.transform(ways, lambda w, i: w + F.when(i >= r, F.get(ways, i - r)).otherwise(0.0))
    ways = F.aggregate(doubled, start, one_more)
    upto = F.slice(ways, F.lit(1), F.round(statistic * 2).cast("int") + 1)
    tail = F.aggregate(upto, F.lit(0.0), lambda s, w: s + w) / F.pow(F.lit(2.0), F.size(ranks))
    return F.least(F.lit(1.0), tail * 2)


def wilcoxon(cells: DataFrame, first: str, second: str, method: str = "auto") -> DataFrame:
    """Signed-rank test of two algorithms, one row. ``better`` has the higher mean.

    ``method``: how the p-value is found. ``exact`` counts the sums of ranks, which needs differences without ties and zeros (null
    otherwise); ``approx`` is the normal one; ``auto`` is exact for at most 50 such differences, as usual. ``conditional`` goes through
    all signs of the ranks at hand, with ties and without the zeros, for at most ``COUNTED_DIFFERENCES`` differences (null otherwise).
    """
    if method not in ("auto", "exact", "approx", "conditional"):
        raise ValueError(f"unknown method {method}")
    pairs = paired(cells, first, second)
    ranks = signed_ranks(pairs)
    n = F.col("n").cast("double")
    one = ranks.agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n_positive") * F.col("rank")).alias("w_plus"),
        F.sum((F.col("n") - F.col("n_positive")) * F.col("rank")).alias("w_minus"),
        F.sum(n * n * n - n).alias("ties"),
        F.lit(1).alias("_one"),
    )
    means = pairs.agg(
        F.avg("a").alias("mean_first"),
        F.avg("b").alias("mean_second"),
        F.count_if(F.col("a") == F.col("b")).alias("n_zero"),
        F.lit(1).alias("_one"),
    )
    t = F.least("w_plus", "w_minus")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    scored = one.withColumn("statistic", t).withColumn("z", (t - n * (n + 1) / 4) / spread).join(means, "_one")
    countable = (F.col("ties") == 0) & (F.col("n_zero") == 0)
    if method == "conditional":
        # with few differences there are few different ones, so the limit leaves none out
        listed = ranks.limit(COUNTED_DIFFERENCES + 1).agg(F.collect_list(F.struct("rank", "n")).alias("_ranks"), F.lit(1).alias("_one"))
        repeated = F.flatten(F.transform("_ranks", lambda x: F.array_repeat(x["rank"].cast("double"), x["n"].cast("int"))))
        few = F.col("n").between(1, COUNTED_DIFFERENCES)
        p_value = F.when(few, _signs_tail(F.when(few, repeated).otherwise(F.array().cast("array<double>")), F.col("statistic")))
        better = F.when(F.col("mean_first") > F.col("mean_second"), first).otherwise(second)
        return scored.join(listed, "_one").select("n", "w_plus", "w_minus", "statistic", "z", p_value.alias("p_value"), better.alias("better"))
    exact = {"auto": countable & (F.col("n") <= 50), "exact": countable, "approx": F.lit(False)}[method]
    few = F.when(exact, F.col("n")).otherwise(F.lit(0))
    return scored.withColumn("_exact", signed_rank_tail(F.when(exact, t).otherwise(0.0), few)).withColumn(
        "_normal", normal_two_sided("z")
    ).select(
        "n", "w_plus", "w_minus", "statistic", "z",
        F.when(exact, F.col("_exact")).when(F.lit(method != "exact"), F.col("_normal")).alias("p_value"),
        F.when(F.col("mean_first") > F.col("mean_second"), first).otherwise(second).alias("better"),
    )


def improvements(ranks: DataFrame, pairs: Sequence[tuple[str, str]], digits: int = 2) -> DataFrame:
    """Gain in average rank of each model over its base, in percent of the base."""
    listed = ranks.sparkSession.createDataFrame(list(pairs), "algorithm string, base string")
    bases = ranks.select(F.col("algorithm").alias("base"), F.col("avg_rank").alias("base_rank"))
    joined = listed.join(ranks, "algorithm").join(bases, "base")
    gain = (F.col("base_rank") - F.col("avg_rank")) / F.col("base_rank") * 100
    return joined.select("algorithm", "base", F.round(gain, digits).alias("improvement"))


def mean_improvement(table: DataFrame, positive_only: bool = False) -> DataFrame:
    kept = table.where(F.col("improvement") > 0) if positive_only else table
    return kept.agg(F.avg("improvement").alias("mean_improvement"), F.count(F.lit(1)).alias("n"))


def summary_table(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean ± std text of every data set and algorithm, one column per algorithm, in the given order."""
    return wide(mean_std_cells(cells), columns, "text").select(DATASET, *columns).orderBy(DATASET)
