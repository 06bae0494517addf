"""Queries of classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlab.catalog.base import long_series, parts, query, rounded
from strandlab.catalog.scoring import MACRO
from strandlab.operators import classify, margin, metrics
from strandlab.operators.logs import best_setting
from strandlab.plans import evaluate

# --- linear margin machines on two numbers per series, solved again in the check SQL ---------------

NEWTON_STEPS = 24
HALVES = """, halves AS (SELECT dataset_name, series_id, label, part, list_avg(series[1:32]) AS a, list_avg(series[33:64]) AS b FROM parts)"""
GRID = "unnest([" + ", ".join(f"{c!r}::DOUBLE" for c in classify.C_GRID) + "])"


def scaled_sql(name: str, fit: str) -> str:
    """Both numbers standardised with the moments of the rows where ``fit`` holds."""
    return f""", {name} AS (SELECT h.dataset_name, series_id, label, part, (a - ma) / sa AS a, (b - mb) / sb AS b FROM halves h JOIN
    (SELECT dataset_name, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM halves WHERE {fit} GROUP BY 1) USING (dataset_name))"""


def newton_sql(out: str, rows: str, fit: str, machines: str) -> str:
    """Weights ``u, v, t`` of each machine by full Newton steps from 0: a 3 x 3 system over the rows inside the margin, by Cramer's rule."""
    sql = f", {out}0 AS (SELECT *, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v, 0.0::DOUBLE AS t FROM ({machines}))"
    for k in range(1, NEWTON_STEPS + 1):
        sql += f""", {out}{k} AS (SELECT dataset_name, c, class,
        (r1 * (m22 * m33 - m23 * m23) - m12 * (r2 * m33 - m23 * r3) + m13 * (r2 * m23 - m22 * r3)) / det AS u,
        (m11 * (r2 * m33 - m23 * r3) - r1 * (m12 * m33 - m23 * m13) + m13 * (m12 * r3 - r2 * m13)) / det AS v,
        (m11 * (m22 * r3 - r2 * m23) - m12 * (m12 * r3 - r2 * m13) + r1 * (m12 * m23 - m22 * m13)) / det AS t FROM
        (SELECT *, m11 * (m22 * m33 - m23 * m23) - m12 * (m12 * m33 - m23 * m13) + m13 * (m12 * m23 - m22 * m13) AS det FROM
        (SELECT dataset_name, c, class, 1 + 2 * c * sum(a * a) AS m11, 2 * c * sum(a * b) AS m12, 2 * c * sum(a) AS m13, 1 + 2 * c * sum(b * b) AS m22,
        2 * c * sum(b) AS m23, 1e-10 + 2 * c * count(*) AS m33, 2 * c * sum(y * a) AS r1, 2 * c * sum(y * b) AS r2, 2 * c * sum(y) AS r3 FROM
        (SELECT m.*, a, b, CASE WHEN label = class THEN 1 ELSE -1 END AS y FROM {out}{k - 1} m JOIN {rows} r ON m.dataset_name = r.dataset_name WHERE {fit})
        WHERE y * (u * a + v * b + t) < 1 GROUP BY 1, 2, 3)))"""
    return sql + f", {out} AS (SELECT * FROM {out}{NEWTON_STEPS})"


def predicted_sql(out: str, rows: str, where: str, machines: str) -> str:
    return f""", {out} AS (SELECT r.dataset_name, c, series_id, label, arg_max(class, u * a + v * b + t) AS prediction FROM {rows} r
    JOIN {machines} m ON m.dataset_name = r.dataset_name WHERE {where} GROUP BY 1, 2, 3, 4)"""


ON_TRAIN = HALVES + scaled_sql("onto", "part = 'train'") + newton_sql(
    "w", "onto", "part = 'train'", f"SELECT dataset_name, label AS class, {GRID} AS c FROM (SELECT DISTINCT dataset_name, label FROM parts WHERE part = 'train')"
)
SCORED = ON_TRAIN + predicted_sql("tried", "onto", "part = 'valid'", "w") + """
    , scored AS (SELECT dataset_name, c, avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END) AS score FROM tried GROUP BY 1, 2)"""
REFITTED = SCORED + """, best AS (SELECT dataset_name, c FROM scored QUALIFY row_number() OVER (PARTITION BY dataset_name ORDER BY score DESC, c) = 1)""" + scaled_sql(
    "anew", "part <> 'test'") + newton_sql("f", "anew", "part <> 'test'", """SELECT dataset_name, label AS class, c
    FROM (SELECT DISTINCT dataset_name, label FROM parts WHERE part <> 'test') JOIN best USING (dataset_name)""") + predicted_sql("told", "anew", "part = 'test'", "f")


def half_means(spark, d):
    """Every series as the means of its two halves."""
    mean = lambda start: F.aggregate(F.slice("series", start, 32), F.lit(0.0), lambda s, x: s + x) / 32
    return parts(spark, d).withColumn("series", F.array(mean(1), mean(33)))


@query("k01_margin_weights", "parts", ON_TRAIN + """ SELECT dataset_name, c, class AS label, unnest([0, 1, 2])::BIGINT AS pos,
    unnest([round(u, 5), round(v, 5), round(t, 5)]) + 0.0 AS value FROM w""")
def k01_weights(spark, d):
    """Weights of all linear machines of the grid, by the rounds in which only sums are shuffled."""
    rows = half_means(spark, d)
    train = rows.where("part = 'train'")
    grid = rows.select("dataset_name").distinct().withColumn("c", F.explode(F.array(*[F.lit(c) for c in classify.C_GRID])))
    machines = margin.fit_margin(classify.prepared(train, train), train, grid, margin.Linear(), block_bytes=0)
    each = machines.select("dataset_name", "c", F.explode(F.arrays_zip("classes", "weights")).alias("m"))
    return long_series(each.select("dataset_name", "c", F.col("m.classes").alias("label"), F.col("m.weights").alias("w")), ["dataset_name", "c", "label"], "w", 5)


@query("k03_margin_scores", "parts", SCORED + " SELECT dataset_name, c, round(score, 6) AS score FROM scored")
def k03_margin(spark, d):
    return rounded(classify.grid_scores(half_means(spark, d), features=margin.Linear()), "score")


@query("k04_margin_predictions", "parts", REFITTED + " SELECT dataset_name, c, series_id, label, prediction FROM told")
def k04_margin(spark, d):
    return classify.grid_classify(half_means(spark, d), features=margin.Linear())


@query("k07_margin_evaluation", "parts", REFITTED + """, nf AS (SELECT dataset_name, 2::BIGINT AS n_features, count(DISTINCT label) AS n_classes FROM parts WHERE part = 'train' GROUP BY 1)"""
       + MACRO.format(src="told", p="prediction").replace("SELECT dataset_name, round(sum", ", macro AS (SELECT dataset_name, round(sum") + """)
    SELECT dataset_name, 'test' AS data_part, n_features, n_classes, accuracy, precision, recall, f1 FROM macro JOIN nf USING (dataset_name)""")
def k07_margin(spark, d):
    return rounded(evaluate.classify_and_evaluate(half_means(spark, d), features=margin.Linear()), "accuracy", "precision", "recall", "f1")


# --- RBF machines on Fourier features --------------------------------------------------------------


@query("k01_rbf_svm")
def k01(spark, d):
    """Hinge-loss machine on Fourier features of one data set that holds all rows."""
    rows = parts(spark, d).withColumn("dataset_name", F.lit("all"))
    ready = classify.prepared(rows, rows.where("part = 'train'"))
    model = classify.rbf_linear_svc(ready.where("part = 'train'"))
    predicted = classify.svc_predictions(model, ready.where("part = 'test'"))
    return rounded(metrics.macro_scores(predicted), "accuracy", "precision", "recall", "f1", digits=3)


@query("k02_impute_and_standardise", "parts", """, h AS (SELECT dataset_name, series_id, part, unnest(range(0, 64)) AS pos, unnest(series) AS v FROM parts),
    f AS (SELECT dataset_name, series_id, part, pos, CASE WHEN pos = 7 THEN 2.0 WHEN (series_id + pos) % 11 = 0 THEN 0.0 ELSE v END AS v FROM h),
    m AS (SELECT dataset_name, pos, avg(v) AS mean, stddev_pop(v) AS std FROM f WHERE part = 'train' GROUP BY 1, 2)
    SELECT f.dataset_name, series_id, f.pos, round((v - mean) / CASE WHEN std = 0 THEN 1 ELSE std END, 6) + 0.0 AS value, round(1 / 63.0::DOUBLE, 6) AS gamma
    FROM f JOIN m ON f.dataset_name = m.dataset_name AND f.pos = m.pos""")
def k02(spark, d):
    holed = F.transform(
        "series", lambda x, i: F.when(i == 7, F.lit(2.0)).when((F.col("series_id") + i) % 11 == 0, F.lit(float("nan"))).otherwise(x)
    )
    rows = parts(spark, d).withColumn("series", holed)
    ready = classify.prepared(rows, rows.where("part = 'train'"))
    return long_series(ready, ["dataset_name", "series_id", F.round("gamma", 6).alias("gamma")])


@query("k03_grid_scores")
def k03(spark, d):
    return rounded(classify.grid_scores(parts(spark, d)), "score", digits=4)


@query("k03_chosen_setting")
def k03_chosen(spark, d):
    return best_setting(classify.grid_scores(parts(spark, d)), ["dataset_name"], "c", "score")


@query("k04_test_predictions")
def k04(spark, d):
    return classify.grid_classify(parts(spark, d)).drop("c")


@query("k07_classify_and_evaluate")
def k07(spark, d):
    return rounded(evaluate.classify_and_evaluate(parts(spark, d)), "accuracy", "precision", "recall", "f1", digits=4)
