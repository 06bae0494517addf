"""Queries of aggregation over runs, ranks and tests on the metric table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.catalog.base import ALGORITHMS, cells, long_series, query, rounded, table
from strandlab.operators import compare, prep

BASELINES = ["A4", "A2"]
PAIRS = [("A1", "A5"), ("A2", "A6"), ("A3", "A7")]
COLUMN_LIST = ", ".join(f"max(CASE WHEN algorithm = '{a}' THEN {{0}} END) AS {a}" for a in ALGORITHMS)

RANKS = """, ranked AS (SELECT *, rank() OVER (PARTITION BY dataset_name, run ORDER BY value DESC)
    + (count(*) OVER (PARTITION BY dataset_name, run, value) - 1) / 2.0 AS rnk,
    count(*) OVER (PARTITION BY dataset_name, run, value) AS ties FROM complete)"""
COMPLETE = """, complete AS (SELECT * FROM (SELECT *, count(value) OVER (PARTITION BY dataset_name, run) AS k_in FROM cells) WHERE k_in = 7)"""
AVG_RANKS = COMPLETE + RANKS + """, avg_ranks AS (SELECT algorithm, avg(rnk) AS avg_rank, count(*) AS n FROM ranked GROUP BY 1)"""
FRIEDMAN = AVG_RANKS + """, sums AS (SELECT algorithm, sum(rnk) AS r, count(*) AS n, sum(ties * ties - 1) AS t FROM ranked GROUP BY 1),
    one AS (SELECT count(*)::DOUBLE AS k, max(n)::DOUBLE AS n, sum(r * r) AS r2, sum(t)::DOUBLE AS t FROM sums),
    fried AS (SELECT k, n, (12.0 / (k * n * (k + 1)) * r2 - 3.0 * n * (k + 1)) / (1.0 - t / (n * k * (k * k - 1))) AS statistic FROM one),
    fried_p AS (SELECT *, exp(-statistic / 2) * (1 + statistic / 2 + pow(statistic / 2, 2) / 2) AS p_value FROM fried)"""
CD = AVG_RANKS + """, cd AS (SELECT 2.94832 * sqrt(7 * 8 / (6.0 * max(n))) AS cd, max(n) AS n FROM avg_ranks)"""


def _complete(spark, d):
    return compare.complete_blocks(cells(spark, d), ALGORITHMS)


@query("a04_run_lists", "cells", """SELECT dataset_name, algorithm, i AS pos, round(vals[i + 1], 6) AS value FROM
    (SELECT dataset_name, algorithm, vals, unnest(range(0, len(vals))) AS i FROM
    (SELECT dataset_name, algorithm, list(value ORDER BY run) AS vals FROM cells GROUP BY 1, 2))""")
def a04(spark, d):
    return long_series(compare.run_lists(cells(spark, d)), ["dataset_name", "algorithm"], "values")


@query("a05_mean_std", "cells", """SELECT dataset_name, algorithm, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std
    FROM cells GROUP BY 1, 2""")
def a05(spark, d):
    return rounded(compare.mean_std(cells(spark, d)), "mean", "std", digits=6)


@query("a05_mean_std_by_metric", "", """WITH long AS (
    SELECT 'S' || l_suppkey AS dataset_name, 'A' || l_linenumber AS algorithm, CAST(l_quantity AS BIGINT) % 5 AS run, m AS metric,
    round(avg(CASE m WHEN 'price' THEN l_extendedprice WHEN 'discount' THEN l_discount ELSE l_tax END / 0.99991::DOUBLE), 4) AS value
    FROM lineitem CROSS JOIN (VALUES ('price'), ('discount'), ('tax')) v(m) GROUP BY 1, 2, 3, 4)
    SELECT dataset_name, algorithm, round(avg(CASE WHEN metric = 'price' THEN value END), 6) AS price,
    round(avg(CASE WHEN metric = 'discount' THEN value END), 6) AS discount, round(avg(CASE WHEN metric = 'tax' THEN value END), 6) AS tax
    FROM long GROUP BY 1, 2""")
def a05_metric(spark, d):
    from strandlab.catalog.base import table

    per_run = (
        table(spark, d, "lineitem")
        .groupBy(
            F.concat(F.lit("S"), F.col("l_suppkey")).alias("dataset_name"),
            F.concat(F.lit("A"), F.col("l_linenumber")).alias("algorithm"),
            (F.col("l_quantity").cast("bigint") % 5).alias("run"),
        )
        .agg(*[F.round(F.avg(F.col(c) / 0.99991), 4).alias(n) for c, n in
               (("l_extendedprice", "price"), ("l_discount", "discount"), ("l_tax", "tax"))])
    )
    long = per_run.unpivot(["dataset_name", "algorithm", "run"], ["price", "discount", "tax"], "metric", "value")
    wide = long.groupBy("dataset_name", "algorithm").pivot("metric", ["price", "discount", "tax"]).agg(F.avg("value"))
    return rounded(wide, "price", "discount", "tax", digits=6)


def _off_ties(spark, d):
    """Means of prices that end in a five would be rounded differently by the two engines."""
    return cells(spark, d).withColumn("value", F.col("value") / 1.0000301)


@query("a06_mean_std_text", "cells", """SELECT dataset_name, algorithm, printf('%.2f', avg(value / 1.0000301::DOUBLE)) || ' ± '
    || printf('%.2f', stddev_pop(value / 1.0000301::DOUBLE)) AS text FROM cells GROUP BY 1, 2""")
def a06(spark, d):
    return compare.mean_std_cells(_off_ties(spark, d))


@query("a07_wide_by_algorithm", "cells", ", m AS (SELECT dataset_name, algorithm, round(avg(value), 6) AS mean FROM cells GROUP BY 1, 2) "
       f"SELECT dataset_name, {COLUMN_LIST.format('mean')} FROM m GROUP BY 1")
def a07(spark, d):
    return compare.wide(rounded(compare.mean_std(cells(spark, d)), "mean", digits=6), ALGORITHMS, "mean")


@query("a08_average_rank", "cells", AVG_RANKS + " SELECT algorithm, round(avg_rank, 6) AS avg_rank FROM avg_ranks")
def a08(spark, d):
    return rounded(compare.average_ranks(_complete(spark, d)), "avg_rank")


IMPROVE = AVG_RANKS + """, pairs(algorithm, base) AS (VALUES ('A1', 'A5'), ('A2', 'A6'), ('A3', 'A7')),
    gains AS (SELECT p.algorithm, p.base, (b.avg_rank - a.avg_rank) / b.avg_rank * 100 AS gain FROM pairs p
    JOIN avg_ranks a ON a.algorithm = p.algorithm JOIN avg_ranks b ON b.algorithm = p.base)"""


@query("a09_improvement", "cells", IMPROVE + " SELECT algorithm, base, round(gain, 6) AS improvement FROM gains")
def a09(spark, d):
    return compare.improvements(compare.average_ranks(_complete(spark, d)), PAIRS, 6)


@query("w01_block_ranks", "cells", COMPLETE + RANKS + " SELECT dataset_name, algorithm, run, rnk AS rank FROM ranked")
def w01(spark, d):
    return compare.ranked(_complete(spark, d)).select("dataset_name", "algorithm", "run", F.col("rank").cast("double"))


PAIRED = """, pairs AS (SELECT dataset_name, run, max(CASE WHEN algorithm = 'A1' THEN value END) AS a,
    max(CASE WHEN algorithm = 'A2' THEN value END) AS b FROM cells GROUP BY 1, 2),
    gaps AS (SELECT a - b AS d FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
    sr AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rnk,
    count(*) OVER (PARTITION BY abs(d)) AS t FROM gaps)"""


@query("w02_signed_ranks", "cells", PAIRED + """ SELECT round(abs(d), 6) AS abs_d, max(rnk) AS rank, count(*) AS n,
    count(*) FILTER (d > 0) AS n_positive FROM sr GROUP BY abs(d)""")
def w02(spark, d):
    ranks = compare.signed_ranks(compare.paired(cells(spark, d), "A1", "A2"))
    return ranks.select(F.round("abs_d", 6).alias("abs_d"), F.col("rank").cast("double"), "n", "n_positive")


@query("w02_signed_ranks_with_ties", "", """WITH g AS (SELECT l_discount * 100 - l_tax * 100 AS d0 FROM lineitem),
    gaps AS (SELECT round(d0) AS d FROM g WHERE round(d0) <> 0),
    c AS (SELECT abs(d) AS abs_d, count(*) AS n, count(*) FILTER (d > 0) AS n_positive FROM gaps GROUP BY 1)
    SELECT abs_d, n, n_positive, sum(n) OVER (ORDER BY abs_d) - (n - 1) / 2.0 AS rank FROM c""")
def w02_ties(spark, d):
    from strandlab.catalog.base import table

    whole = lambda c: F.col(c) * 100
    pairs = table(spark, d, "lineitem").select(F.round(whole("l_discount") - whole("l_tax")).alias("a"), F.lit(0.0).alias("b"))
    return compare.signed_ranks(pairs).select("abs_d", "n", "n_positive", F.col("rank").cast("double"))


@query("w08_sorted_by_rank", "cells", AVG_RANKS + " SELECT algorithm, round(avg_rank, 6) AS avg_rank FROM avg_ranks ORDER BY 2, 1")
def w08(spark, d):
    return rounded(compare.average_ranks(_complete(spark, d)), "avg_rank").orderBy("avg_rank", "algorithm")


@query("t01_complete_blocks", "cells", """SELECT dataset_name, run, count(value) AS n_algorithms, 0::BIGINT AS n_repeated, count(value) = 7 AS complete
    FROM cells GROUP BY 1, 2""")
def t01(spark, d):
    return compare.block_report(cells(spark, d), ALGORITHMS)


SPOILT = """, spoilt AS (SELECT dataset_name, algorithm, run, CASE WHEN run = 1 AND algorithm = 'A3' THEN 'NaN'::DOUBLE
    WHEN run = 2 AND algorithm = 'A5' THEN NULL ELSE value END AS value FROM cells)"""


def _spoilt(spark, d):
    """The metric table with failed and missing values in two of the runs."""
    bad = F.when((F.col("run") == 1) & (F.col("algorithm") == "A3"), float("nan")).when(
        ~((F.col("run") == 2) & (F.col("algorithm") == "A5")), F.col("value")
    )
    return cells(spark, d).withColumn("value", bad)


@query("t01_blocks_with_nan_and_duplicates", "cells", SPOILT + """, twice AS (SELECT * FROM spoilt UNION ALL SELECT * FROM spoilt WHERE run = 3 AND algorithm = 'A1')
    SELECT dataset_name, run, count(DISTINCT CASE WHEN value IS NOT NULL AND NOT isnan(value) THEN algorithm END) AS n_algorithms,
    count(*) - count(DISTINCT algorithm) AS n_repeated, count(*) = 7 AND count(*) FILTER (value IS NOT NULL AND NOT isnan(value)) = 7 AS complete
    FROM twice GROUP BY 1, 2""")
def t01_spoilt(spark, d):
    rows = _spoilt(spark, d)
    return compare.block_report(rows.unionByName(rows.where("run = 3 and algorithm = 'A1'")), ALGORITHMS)


@query("w01_ranks_with_nan", "cells", SPOILT + """ SELECT dataset_name, algorithm, run, rank() OVER (PARTITION BY dataset_name, run
    ORDER BY CASE WHEN value IS NULL THEN 2 WHEN isnan(value) THEN 1 ELSE 0 END, value DESC)
    + (count(*) OVER (PARTITION BY dataset_name, run, value) - 1) / 2.0 AS rank FROM spoilt""")
def w01_spoilt(spark, d):
    return compare.ranked(_spoilt(spark, d)).select("dataset_name", "algorithm", "run", F.col("rank").cast("double"))


@query("t05_ranks_without_spoilt_blocks", "cells", SPOILT + """, complete AS (SELECT * FROM (SELECT *,
    count(*) FILTER (value IS NOT NULL AND NOT isnan(value)) OVER (PARTITION BY dataset_name, run) AS k_in FROM spoilt) WHERE k_in = 7)""" + RANKS + """
    SELECT algorithm, round(avg(rnk), 6) AS avg_rank FROM ranked GROUP BY 1""")
def t05_spoilt(spark, d):
    return rounded(compare.average_ranks(compare.complete_blocks(_spoilt(spark, d), ALGORITHMS)), "avg_rank")


@query("t01_incomplete_blocks", "", """WITH c AS (SELECT 'U' || user_id AS dataset_name, event_type AS algorithm, event_id % 5 AS run,
    avg(value) AS value FROM events GROUP BY 1, 2, 3),
    k AS (SELECT *, count(value) OVER (PARTITION BY dataset_name, run) AS k FROM c)
    SELECT dataset_name, algorithm, run, round(value, 6) AS value FROM k WHERE k = 5""")
def t01_incomplete(spark, d):
    from strandlab.catalog.base import events

    typed = events(spark, d).groupBy(
        F.concat(F.lit("U"), F.col("user_id")).alias("dataset_name"),
        F.col("event_type").alias("algorithm"),
        (F.col("event_id") % 5).alias("run"),
    ).agg(F.avg("value").alias("value"))
    names = ["click", "error", "purchase", "signup", "view"]
    return rounded(compare.complete_blocks(typed, names), "value")


@query("t02_friedman", "cells", FRIEDMAN + """ SELECT k::BIGINT AS k, n::BIGINT AS n_blocks, round(statistic, 6) AS statistic,
    round(p_value, 6) AS p_value FROM fried_p""")
def t02(spark, d):
    return rounded(compare.friedman(_complete(spark, d)), "statistic", "p_value")


@query("t02_friedman_mean_over_runs", "cells", """, cells2 AS (SELECT dataset_name, algorithm, 0 AS run, round(avg(value), 6) AS value FROM cells GROUP BY 1, 2)
    """ + FRIEDMAN.replace("FROM cells)", "FROM cells2)") + """ SELECT k::BIGINT AS k, n::BIGINT AS n_blocks, round(statistic, 6) AS statistic,
    round(p_value, 6) AS p_value FROM fried_p""")
def t02_mean(spark, d):
    averaged = rounded(compare.mean_over_runs(cells(spark, d)), "value")
    return rounded(compare.friedman(compare.complete_blocks(averaged, ALGORITHMS)), "statistic", "p_value")


@query("t03_critical_difference", "cells", CD + """, q(test, alpha, q) AS (VALUES ('bonferroni-dunn', 0.05, 2.638), ('bonferroni-dunn', 0.1, 2.394),
    ('nemenyi', 0.05, 2.94832), ('nemenyi', 0.1, 2.692732))
    SELECT test, alpha::DOUBLE AS alpha, n AS n_blocks, round(q * sqrt(7 * 8 / (6.0 * n)), 6) AS cd FROM cd CROSS JOIN q""")
def t03(spark, d):
    blocks = _complete(spark, d)
    tables = [
        compare.critical_difference(blocks, test, alpha).select(
            F.lit(test).alias("test"), F.lit(alpha).alias("alpha"), "n_blocks", F.round("cd", 6).alias("cd")
        )
        for test, alpha in sorted(compare.CRITICAL_VALUES)
    ]
    return reduce(DataFrame.unionByName, tables)


@query("t03_computed_difference", "cells", CD + """, q(alpha, q) AS (VALUES (0.05, 2.94832), (0.1, 2.692732)),
    each AS (SELECT algorithm FROM cells GROUP BY 1), two AS (SELECT alpha, q FROM q)
    SELECT alpha::DOUBLE AS alpha, (SELECT count(*) FROM each) AS k, n AS n_blocks, round(q * sqrt(7 * 8 / (6.0 * n)), 4) AS cd FROM cd CROSS JOIN two""")
def t03_computed(spark, d):
    """The critical value integrated for the number of algorithms at hand."""
    blocks = _complete(spark, d)
    tables = [compare.critical_difference(blocks, "nemenyi", a, computed=True).select(F.lit(a).alias("alpha"), "k", "n_blocks", F.round("cd", 4).alias("cd")) for a in (0.05, 0.1)]
    return tables[0].unionByName(tables[1])


@query("t04_indistinct_groups", "cells", CD + """, s AS (SELECT algorithm, avg_rank, row_number() OVER (ORDER BY avg_rank, algorithm) - 1 AS p FROM avg_ranks),
    close AS (SELECT a.p AS first, b.p AS last, a.algorithm AS best, b.algorithm AS worst FROM s a JOIN s b ON b.p > a.p, cd
    WHERE b.avg_rank - a.avg_rank <= cd.cd)
    SELECT * FROM close c WHERE NOT EXISTS (SELECT 1 FROM close o WHERE (o.first <= c.first AND o.last > c.last) OR (o.first < c.first AND o.last >= c.last))""")
def t04(spark, d):
    return compare.indistinct_groups(compare.rank_summary(_complete(spark, d)))


@query("t05_ranked_list", "cells", FRIEDMAN + """ SELECT algorithm, round(avg_rank, 6) AS avg_rank FROM avg_ranks
    WHERE (SELECT p_value FROM fried_p) < 0.99 ORDER BY 2, 1""")
def t05(spark, d):
    # the supplied prices have no real winner, so the gate is opened; 0.05 is the default
    return rounded(compare.ranked_list(_complete(spark, d), gate=0.99), "avg_rank")


@query("t05_ranks_with_significance", "cells", FRIEDMAN + """, cd AS (SELECT 2.94832 * sqrt(7 * 8 / (6.0 * max(n))) AS cd FROM avg_ranks)
    SELECT algorithm, round(avg_rank, 6) AS avg_rank, round(avg_rank - min(avg_rank) OVER (), 6) AS gap, round(cd, 6) AS cd, round(p_value, 6) AS p_value
    FROM avg_ranks, cd, fried_p""")
def t05_significance(spark, d):
    return rounded(compare.ranks_with_significance(_complete(spark, d)), "avg_rank", "gap", "cd", "p_value")


@query("t06_wilcoxon", "cells", PAIRED + """, w AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN rnk ELSE 0 END) AS w_plus,
    sum(CASE WHEN d < 0 THEN rnk ELSE 0 END) AS w_minus, sum(t * t - 1)::DOUBLE AS ties FROM sr),
    m AS (SELECT avg(a) AS ma, avg(b) AS mb FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL)
    SELECT n, w_plus, w_minus, least(w_plus, w_minus) AS statistic,
    round(z, 6) AS z, round(2 * (SELECT sum(CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(abs(z) + i / 2000.0, 2) / 2))
    / 6000.0 FROM range(0, 20001) g(i)) / sqrt(2 * pi()), 6) AS p_value, CASE WHEN ma > mb THEN 'A1' ELSE 'A2' END AS better
    FROM (SELECT *, (least(w_plus, w_minus) - n * (n + 1) / 4.0) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM w), m""")
def t06(spark, d):
    test = compare.wilcoxon(cells(spark, d), "A1", "A2", method="approx")
    return rounded(test, "z", "p_value").withColumns({c: F.col(c).cast("double") for c in ("w_plus", "w_minus", "statistic")})


# nations as data sets: few pairs, means rounded to hundreds so that differences tie
NATIONS = """WITH pairs AS (SELECT s_nationkey, max(v) FILTER (l_linenumber = 1) - max(v) FILTER (l_linenumber = 2) AS d FROM (SELECT s_nationkey, l_linenumber,
    round(avg(l_extendedprice::DOUBLE / 0.99991) / 100) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber IN (1, 2) GROUP BY 1, 2) GROUP BY 1),
    sr AS (SELECT d, row_number() OVER (ORDER BY abs(d)) AS place, (2 * (rank() OVER (ORDER BY abs(d))) + count(*) OVER (PARTITION BY abs(d)) - 1)::BIGINT AS twice FROM pairs WHERE d <> 0),
    ways0 AS (SELECT 0::BIGINT AS total, 1::HUGEINT AS n)""" + "".join(
    f""", ways{k} AS (SELECT total, sum(n)::HUGEINT AS n FROM (SELECT * FROM ways{k - 1} UNION ALL SELECT total + twice, n FROM ways{k - 1} JOIN sr ON place = {k}) GROUP BY 1)"""
    for k in range(1, 26)) + """, st AS (SELECT count(*) AS n, least(sum(twice) FILTER (d > 0), sum(twice) FILTER (d < 0)) AS t FROM sr)
    SELECT st.n, t / 2.0::DOUBLE AS statistic, round(least(1.0, 2 * (SELECT sum(n) FROM ways25 WHERE total <= t)::DOUBLE / pow(2.0::DOUBLE, st.n)), 9) AS p_value FROM st"""


@query("t06_wilcoxon_all_signs", "", NATIONS)
def t06_signs(spark, d):
    """Two line numbers compared over the nations of the suppliers, through all signs of the tied ranks."""
    lines = table(spark, d, "lineitem").where("l_linenumber IN (1, 2)")
    joined = lines.join(table(spark, d, "supplier"), lines["l_suppkey"] == F.col("s_suppkey"))
    value = F.round(F.avg(F.col("l_extendedprice").cast("double") / 0.99991) / 100)
    rows = joined.groupBy(F.col("s_nationkey").cast("string").alias("dataset_name"), F.concat(F.lit("A"), F.col("l_linenumber")).alias("algorithm"), F.lit(1).alias("run")).agg(value.alias("value"))
    test = compare.wilcoxon(rows, "A1", "A2", method="conditional")
    return rounded(test, "p_value", digits=9).select("n", F.col("statistic").cast("double").alias("statistic"), "p_value")


@query("t07_improvement_means", "cells", IMPROVE + """, g2 AS (SELECT round(gain, 2) AS g FROM gains)
    SELECT 'all' AS kind, round(avg(g), 6) AS mean_improvement, count(*) AS n FROM g2
    UNION ALL SELECT 'positive', round(avg(g), 6), count(*) FROM g2 WHERE g > 0""")
def t07(spark, d):
    table = compare.improvements(compare.average_ranks(_complete(spark, d)), PAIRS)
    every = compare.mean_improvement(table).withColumn("kind", F.lit("all"))
    positive = compare.mean_improvement(table, positive_only=True).withColumn("kind", F.lit("positive"))
    return rounded(every.unionByName(positive), "mean_improvement")


@query("t08_summary_table", "cells", """, m AS (SELECT dataset_name, algorithm,
    printf('%.2f', avg(value / 1.0000301::DOUBLE)) || ' ± ' || printf('%.2f', stddev_pop(value / 1.0000301::DOUBLE)) AS text FROM cells GROUP BY 1, 2)
    """ + f"SELECT dataset_name, {COLUMN_LIST.format('text')} FROM m GROUP BY 1 ORDER BY 1")
def t08(spark, d):
    return compare.summary_table(_off_ties(spark, d), prep.column_order(ALGORITHMS, BASELINES))


@query("j03_side_by_side", "cells", """, m AS (SELECT dataset_name, algorithm, round(avg(value), 6) AS mean FROM cells GROUP BY 1, 2),
    l AS (SELECT dataset_name, max(CASE WHEN algorithm = 'A1' THEN mean END) AS A1, max(CASE WHEN algorithm = 'A2' THEN mean END) AS A2
    FROM m WHERE mean > 30000 AND algorithm IN ('A1', 'A2') GROUP BY 1),
    r AS (SELECT dataset_name, max(mean) AS A3 FROM m WHERE algorithm = 'A3' AND mean > 45000 GROUP BY 1)
    SELECT coalesce(l.dataset_name, r.dataset_name) AS dataset_name, A1, A2, A3 FROM l FULL JOIN r ON l.dataset_name = r.dataset_name""")
def j03(spark, d):
    means = rounded(compare.mean_std(cells(spark, d)), "mean", digits=6).drop("std")
    left = compare.wide(means.where("mean > 30000 and algorithm in ('A1', 'A2')"), ["A1", "A2"], "mean")
    right = compare.wide(means.where("mean > 45000 and algorithm = 'A3'"), ["A3"], "mean")
    return compare.side_by_side(left, right)
