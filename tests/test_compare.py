import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlab.functions import tails
from strandlab.operators import compare, logs

SCHEMA = "dataset_name string, algorithm string, run int, value double"


def cube(spark, table):
    """Rows of a table {(dataset, run): {algorithm: value}}."""
    rows = [(d, a, r, float(v)) for (d, r), cells in table.items() for a, v in cells.items()]
    return spark.createDataFrame(rows, SCHEMA)


TIED = {
    ("x", 1): {"A": 3, "B": 3, "C": 1},
    ("x", 2): {"A": 5, "B": 4, "C": 1},
    ("y", 1): {"A": 2, "B": 2, "C": 2},
    ("y", 2): {"A": 9, "B": 1, "C": 4},
}


def test_ranks_share_ties_and_add_up(spark):
    rows = compare.ranked(cube(spark, TIED)).collect()
    got = {(r["dataset_name"], r["run"], r["algorithm"]): r["rank"] for r in rows}
    assert got["x", 1, "A"] == got["x", 1, "B"] == 1.5 and got["x", 1, "C"] == 3
    assert got["y", 1, "A"] == got["y", 1, "B"] == got["y", 1, "C"] == 2
    for block in TIED:
        assert sum(v for k, v in got.items() if k[:2] == block) == 6
    low = {(r["dataset_name"], r["run"], r["algorithm"]): r["rank"] for r in compare.ranked(cube(spark, TIED), False).collect()}
    assert low["x", 2, "C"] == 1


def test_incomplete_blocks_are_dropped_and_reported(spark):
    table = {**TIED, ("z", 1): {"A": 1, "B": 2}}
    cells = cube(spark, table)
    assert compare.complete_blocks(cells, ["A", "B", "C"]).count() == 12
    report = {(r["dataset_name"], r["run"]): r["complete"] for r in compare.block_report(cells, ["A", "B", "C"]).collect()}
    assert report["z", 1] is False and report["x", 1] is True


def friedman_by_hand(table, names):
    ranks = []
    ties = 0
    for cells in table.values():
        ranks.append([sum(v > cells[a] for v in cells.values()) + (sum(v == cells[a] for v in cells.values()) + 1) / 2 for a in names])
        for v in set(cells.values()):
            t = sum(w == v for w in cells.values())
            ties += t**3 - t
    n, k = len(ranks), len(names)
    sums = [sum(r[j] for r in ranks) for j in range(k)]
    raw = 12 / (k * n * (k + 1)) * sum(s * s for s in sums) - 3 * n * (k + 1)
    return raw / (1 - ties / (n * k * (k * k - 1)))


def test_friedman(spark):
    got = compare.friedman(cube(spark, TIED)).first()
    wanted = friedman_by_hand(TIED, ["A", "B", "C"])
    assert got["statistic"] == pytest.approx(wanted)
    assert got["p_value"] == pytest.approx(math.exp(-wanted / 2))


# tails of the chi-square distribution from printed tables
@pytest.mark.parametrize("x, dof, p", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (12.591587, 6, 0.05), (18.475307, 7, 0.01)])
def test_chi_square_tail(x, dof, p):
    assert compare._chi_square_tail(x, dof) == pytest.approx(p, rel=1e-5)


@pytest.mark.parametrize("k, q", [(2, 1.959964), (3, 2.343701), (8, 3.030879), (20, 3.543799)])
def test_critical_values(spark, k, q):
    assert spark.range(1).select(compare.critical_value("nemenyi", 0.05, F.lit(k)).alias("q")).first()["q"] == q
    with pytest.raises(ValueError):
        compare.critical_value("nemenyi", 0.2, F.lit(k))


def test_more_algorithms_than_critical_values(spark):
    table = {("x", r): {f"m{i}": (i * 7 + r) % 25 for i in range(25)} for r in range(3)}
    for fn in (compare.critical_difference, compare.rank_summary, compare.ranks_with_significance):
        with pytest.raises(Exception, match="from 2 to 20 algorithms, not 25"):
            fn(cube(spark, table)).collect()


def test_computed_critical_values_meet_the_fixed_ones():
    for (test, alpha), table in compare.CRITICAL_VALUES.items():
        if test == "nemenyi":
            for k, q in enumerate(table, start=2):
                assert tails.nemenyi_quantile(k, alpha) == pytest.approx(q, abs=1e-5)
        else:  # printed with three digits, one of them off by two units
            assert sum(abs(tails.dunn_quantile(k, alpha) - q) < 6e-4 for k, q in enumerate(table, start=2)) >= len(table) - 1
    # the range of two normal numbers is a normal number times the root of two
    assert tails.nemenyi_quantile(2, 0.01) == pytest.approx(2.575829, abs=1e-6)
    with pytest.raises(ValueError):
        tails.nemenyi_quantile(1, 0.05)
    with pytest.raises(ValueError):
        tails.dunn_quantile(3, 1.0)


def test_range_of_forty_numbers_by_simulation():
    rng = np.random.default_rng(0)
    spread = np.ptp(rng.normal(size=(200_000, 40)), axis=1)
    q = tails.nemenyi_quantile(40, 0.05) * math.sqrt(2)
    assert (spread > q).mean() == pytest.approx(0.05, abs=0.002)


def test_computed_difference_of_many_algorithms(spark):
    table = {("x", r): {f"m{i:02d}": (i * 7 + r) % 40 for i in range(40)} for r in range(3)}
    cells = cube(spark, table)
    got = compare.critical_difference(cells, alpha=0.2, computed=True).first()
    assert (got["k"], got["n_blocks"]) == (40, 3)
    assert got["cd"] == pytest.approx(tails.nemenyi_quantile(40, 0.2) * math.sqrt(40 * 41 / 18))
    assert compare.indistinct_groups(compare.rank_summary(cells, computed=True)).count() >= 1
    few = cube(spark, TIED)
    assert compare.critical_difference(few, computed=True).first()["cd"] == pytest.approx(compare.critical_difference(few).first()["cd"], rel=1e-5)
    assert compare.critical_difference(few.limit(0), computed=True).first()["cd"] is None


def test_all_tied_blocks_have_no_statistic(spark):
    got = compare.friedman(cube(spark, {("x", r): {"A": 1, "B": 1, "C": 1} for r in range(3)})).first()
    assert got["statistic"] is None and got["p_value"] is None and got["n_blocks"] == 3
    assert compare.friedman(cube(spark, TIED).limit(0)).first()["statistic"] is None


def test_chi_square_tail_of_many_algorithms():
    assert compare._chi_square_tail(2000.0, 1999) == pytest.approx(0.4899, abs=1e-3)
    assert compare._chi_square_tail(4000.0, 400) == 0.0 or compare._chi_square_tail(4000.0, 400) < 1e-300
    assert compare._chi_square_tail(0.0, 3) == 1.0


def test_nan_never_wins_and_repeats_are_errors(spark):
    nan = float("nan")
    table = {("x", 1): {"A": nan, "B": 2.0, "C": 1.0}, ("x", 2): {"A": 3.0, "B": 2.0, "C": 1.0}}
    cells = cube(spark, table)
    for better in (True, False):
        got = {r["algorithm"]: r["rank"] for r in compare.ranked(cells, better).where("run = 1").collect()}
        assert got["A"] == 3
    assert {r["run"] for r in compare.complete_blocks(cells, ["A", "B", "C"]).collect()} == {2}
    assert compare.paired(cells, "A", "B").count() == 1
    twice = cells.unionByName(cells.where("run = 2 and algorithm = 'A'"))
    with pytest.raises(Exception, match="more than one value of A"):
        compare.complete_blocks(twice, ["A", "B", "C"]).collect()
    with pytest.raises(Exception, match="more than one value of A"):
        compare.paired(twice, "A", "B").collect()
    # A twice and B missing is not complete
    odd = cells.where("run = 2 and algorithm <> 'B'").unionByName(cells.where("run = 2 and algorithm = 'A'"))
    report = compare.block_report(odd, ["A", "B", "C"]).first()
    assert (report["n_algorithms"], report["n_repeated"], report["complete"]) == (2, 1, False)


def test_wilcoxon_methods(spark):
    a, b = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [1.5, 2.25, 2.875, 5.0, 7.0, 2.0]
    cells = cube(spark, wilcoxon_table(a, b))
    p = {m: compare.wilcoxon(cells, "A", "B", m).first()["p_value"] for m in ("auto", "exact", "approx")}
    assert p["auto"] == p["exact"] and p["approx"] != p["exact"]
    tied = cube(spark, wilcoxon_table([1.0, 2.0, 3.0], [2.0, 1.0, 5.0]))
    assert compare.wilcoxon(tied, "A", "B", "exact").first()["p_value"] is None
    with pytest.raises(ValueError):
        compare.wilcoxon(cells, "A", "B", "guess")


def test_critical_difference(spark):
    got = compare.critical_difference(cube(spark, TIED)).first()
    assert got["cd"] == pytest.approx(2.343701 * math.sqrt(3 * 4 / (6 * 4)))


def groups_by_hand(ranks, cd):
    close = [(i, j) for i, j in itertools.combinations(range(len(ranks)), 2) if ranks[j] - ranks[i] <= cd]
    return {(i, j) for i, j in close if not any((a <= i and b > j) or (a < i and b >= j) for a, b in close)}


@pytest.mark.parametrize("cd", [0.0, 0.4, 0.9, 1.5, 9.0])
def test_indistinct_groups(spark, cd):
    ranks = [1.2, 1.5, 2.1, 3.0, 3.0, 4.2]
    one = spark.range(1).select(
        F.array(*[F.struct(F.lit(r).alias("avg_rank"), F.lit(f"m{i}").alias("algorithm")) for i, r in enumerate(ranks)]).alias("ranks"),
        F.lit(cd).alias("cd"),
    )
    got = {(r["first"], r["last"]) for r in compare.indistinct_groups(one).collect()}
    assert got == groups_by_hand(ranks, cd)


def test_gate(spark):
    assert compare.ranked_list(cube(spark, TIED), gate=0.0001).count() == 0
    names = [r["algorithm"] for r in compare.ranked_list(cube(spark, TIED), gate=1.0).collect()]
    assert names == ["A", "B", "C"]


def wilcoxon_table(a, b):
    return {(f"d{i}", 1): {"A": x, "B": y} for i, (x, y) in enumerate(zip(a, b))}


def test_wilcoxon_exact(spark):
    # seven differences 1..7, two of them negative (ranks 2 and 3): T = 5, p = 2 * 10 / 128
    diffs = [1, -2, -3, 4, 5, 6, 7]
    got = compare.wilcoxon(cube(spark, wilcoxon_table([10 + v for v in diffs], [10] * 7)), "A", "B").first()
    ways = sum(1 for bits in itertools.product([0, 1], repeat=7) if sum(r for r, b in zip(range(1, 8), bits) if b) <= 5)
    assert (got["n"], got["statistic"], got["better"]) == (7, 5.0, "A")
    assert got["p_value"] == pytest.approx(2 * ways / 2**7)


def test_wilcoxon_ties_and_zeros(spark):
    diffs = [0, 1, -1, 2, 2, 3, 0]
    got = compare.wilcoxon(cube(spark, wilcoxon_table(diffs, [0] * 7)), "A", "B").first()
    # |d| = 1, 1, 2, 2, 3 have ranks 1.5, 1.5, 3.5, 3.5, 5
    assert (got["n"], got["w_plus"], got["w_minus"]) == (5, 13.5, 1.5)
    z = (1.5 - 7.5) / math.sqrt(5 * 6 * 11 / 24 - 12 / 48)
    assert got["z"] == pytest.approx(z)
    assert got["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


@pytest.mark.parametrize("seed", range(6))
def test_wilcoxon_over_all_signs(spark, seed):
    """Ties and zeros: the p-value is the share of all signs of the ranks at hand."""
    rng = np.random.default_rng(seed)
    diffs = rng.integers(-3 - seed, 4 + seed, 11 if seed else 12).astype(float)
    got = compare.wilcoxon(cube(spark, wilcoxon_table(list(diffs), [0.0] * len(diffs))), "A", "B", "conditional").first()
    left = np.abs(diffs[diffs != 0])
    ranks = np.array([(left < v).sum() + ((left == v).sum() + 1) / 2 for v in left])
    t = min(ranks[diffs[diffs != 0] > 0].sum(), ranks[diffs[diffs != 0] < 0].sum())
    ways = sum(1 for bits in itertools.product([0, 1], repeat=len(ranks)) if (ranks * bits).sum() <= t + 1e-9)
    assert (got["n"], got["statistic"]) == (len(ranks), t)
    assert got["p_value"] == pytest.approx(min(1.0, 2 * ways / 2 ** len(ranks)))


def test_wilcoxon_over_all_signs_limits(spark):
    get = lambda diffs, m="conditional": compare.wilcoxon(cube(spark, wilcoxon_table(diffs, [0.0] * len(diffs))), "A", "B", m).first()["p_value"]
    assert get([0.0, 0.0]) is None and get([1.0] * 61) is None
    assert get([1.0] * 60) == pytest.approx(2 / 2**60)
    diffs = [1.0, -2.0, -3.0, 4.0, 5.0, 6.0, 7.0]
    assert get(diffs) == pytest.approx(get(diffs, "exact"))


def test_improvements(spark):
    ranks = spark.createDataFrame([("S", 3.95), ("B", 4.35), ("T", 5.0)], "algorithm string, avg_rank double")
    table = compare.improvements(ranks, [("S", "B"), ("T", "B")])
    got = {r["algorithm"]: r["improvement"] for r in table.collect()}
    assert got == {"S": 9.20, "T": -14.94}
    assert compare.mean_improvement(table, positive_only=True).first()["mean_improvement"] == pytest.approx(9.20)
    assert compare.mean_improvement(table).first()["mean_improvement"] == pytest.approx((9.20 - 14.94) / 2)


@pytest.mark.parametrize("new, base, gain", [(3.95, 4.35, 9.20), (4.44, 5.38, 17.47), (5.01, 5.38, 6.88), (1.71, 6.86, 75.07), (3.04, 3.71, 18.06)])
def test_published_gains(spark, new, base, gain):
    ranks = spark.createDataFrame([("new", new), ("base", base)], "algorithm string, avg_rank double")
    assert compare.improvements(ranks, [("new", "base")]).first()["improvement"] == pytest.approx(gain)


def test_run_lists_and_outer_join(spark):
    cells = cube(spark, {("x", 2): {"A": 2}, ("x", 1): {"A": 1}, ("y", 1): {"B": 5}})
    lists = {(r["dataset_name"], r["algorithm"]): r["values"] for r in compare.run_lists(cells).collect()}
    assert lists["x", "A"] == [1.0, 2.0]
    mean = compare.mean_std(cells)
    a = compare.wide(mean.where("algorithm = 'A'"), ["A"], "mean")
    b = compare.wide(mean.where("algorithm = 'B'"), ["B"], "mean")
    got = {r["dataset_name"]: (r["A"], r["B"]) for r in compare.side_by_side(a, b).collect()}
    assert got == {"x": (1.5, None), "y": (None, 5.0)}


# --- logs --------------------------------------------------------------------------------------


def log_of(spark, losses):
    rows = [("d", "m", i, 0.0, None if v is None else float(v)) for i, v in enumerate(losses)]
    return spark.createDataFrame(rows, "dataset_name string, model_name string, epoch long, train_loss double, val_loss double")


def stop_by_hand(losses, min_delta, patience):
    best, at, misses = math.inf, None, 0
    for i, v in enumerate(losses):
        if v + min_delta < best:
            best, at, misses = v, i, 0
        else:
            misses += 1
        if misses >= patience:
            return best, at, i
    return best, at, None


@pytest.mark.parametrize(
    "losses",
    [
        [1.0, 0.9, 0.8996, 0.8993, 0.8990, 0.5, 0.4],  # small gains do not move the best
        [1.0, 1.1, 1.2, 1.3, 0.1],
        [3.0, 2.0, 1.0],
        [1.0, 1.1, 0.9, 1.0, 1.0, 1.0],
    ],
)
def test_early_stop(spark, losses):
    got = logs.early_stop(log_of(spark, losses), 0.001, 3).first()
    assert (got["best_loss"], got["best_epoch"], got["stop_epoch"]) == stop_by_hand(losses, 0.001, 3)


def test_early_stopping_settings():
    assert logs.early_stopping_settings(500) == {"min_delta": 0.0005, "patience": 50}
    assert logs.early_stopping_settings(200, "contrastive") == {"min_delta": 0.0001, "patience": 100}


def test_checkpoints(spark):
    log = log_of(spark, [0.5, 0.2, float("nan"), 0.2, None])
    assert logs.best_checkpoint(log).first()["epoch"] == 1
    assert logs.final_checkpoint(log).first()["epoch"] == 4
    assert logs.best_checkpoint(log_of(spark, [None, None])).first()["epoch"] == 1


def test_best_setting_takes_first_on_ties(spark):
    scores = spark.createDataFrame([("d", 0.1, 0.7), ("d", 1.0, 0.9), ("d", 10.0, 0.9)], "dataset_name string, c double, score double")
    assert logs.best_setting(scores, ["dataset_name"], "c", "score").first()["c"] == 1.0
