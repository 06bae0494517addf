"""Queries of clustering and classification scores, distances and k-means."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlab.catalog.base import graded, long_series, parts, predictions, query, rounded, series
from strandlab.operators import cluster, lloyd, metrics, neighbours, prep
from strandlab.operators.blocks import dataset_sizes
from strandlab.plans import evaluate
from strandlab.session import materialise

# --- external ----------------------------------------------------------------------------------

CONT = """, cont AS (SELECT dataset_name, label, cluster, count(*) AS n_cell FROM {src} GROUP BY 1, 2, 3),
    ct AS (SELECT *, sum(n_cell) OVER (PARTITION BY dataset_name, label)::BIGINT AS n_label, sum(n_cell) OVER (PARTITION BY dataset_name, cluster)::BIGINT AS n_cluster,
    sum(n_cell) OVER (PARTITION BY dataset_name)::BIGINT AS n FROM cont),
    ps AS (SELECT dataset_name, max(n)::DOUBLE AS n, sum(n_cell * n_cell)::DOUBLE AS c2, sum(n_cell * n_label)::DOUBLE AS a2, sum(n_cell * n_cluster)::DOUBLE AS b2,
    sum(n_cell / n::DOUBLE * ln(n_cell::DOUBLE * n / (n_label::DOUBLE * n_cluster))) AS mi, -sum(n_cell / n::DOUBLE * ln(n_label / n::DOUBLE)) AS ha,
    -sum(n_cell / n::DOUBLE * ln(n_cluster / n::DOUBLE)) AS hb FROM ct GROUP BY 1),
    pc AS (SELECT *, c2 - n AS tp, a2 - c2 AS fn, b2 - c2 AS fp, n * n - (b2 - c2) - (a2 - c2) - c2 AS tn FROM ps),
    ext AS (SELECT dataset_name, CASE WHEN fn = 0 AND fp = 0 THEN 1 ELSE 2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)) END AS ari,
    CASE WHEN ha = 0 AND hb = 0 THEN 1 WHEN ha = 0 OR hb = 0 THEN 0 ELSE greatest(mi, 0) / ((ha + hb) / 2) END AS nmi,
    CASE WHEN tp = 0 THEN 0 ELSE sqrt(tp / (a2 - n)) * sqrt(tp / (b2 - n)) END AS fmi FROM pc)"""


@query("a10_contingency", "pred", CONT.format(src="pred") + " SELECT * FROM ct")
def a10(spark, d):
    return metrics.contingency(predictions(spark, d))


for _name, _col in (("c04_adjusted_rand", "ari"), ("c05_mutual_information", "nmi"), ("c06_fowlkes_mallows", "fmi")):

    @query(_name, "pred", CONT.format(src="pred") + f" SELECT dataset_name, round({_col}, 6) AS {_col} FROM ext")
    def external(spark, d, col=_col):
        return metrics.external_scores(predictions(spark, d)).select("dataset_name", F.round(col, 6).alias(col))


@query("k05_accuracy", "graded", "SELECT dataset_name, round(avg((label = prediction)::INT), 6) AS accuracy FROM graded GROUP BY 1")
def k05(spark, d):
    return rounded(metrics.macro_scores(graded(spark, d)), "accuracy").select("dataset_name", "accuracy")


MACRO = """, cl AS (SELECT dataset_name, label AS l FROM {src} UNION SELECT dataset_name, {p} FROM {src}),
    pl AS (SELECT c.dataset_name, c.l, count(*) FILTER (g.label = c.l AND g.{p} = c.l) AS tp, count(*) FILTER (g.label = c.l) AS t, count(*) FILTER (g.{p} = c.l) AS p
    FROM cl c JOIN {src} g ON g.dataset_name = c.dataset_name GROUP BY 1, 2)
    SELECT dataset_name, round(sum(tp) / sum(t)::DOUBLE, 6) AS accuracy, round(avg(CASE WHEN p = 0 THEN 0 ELSE tp / p::DOUBLE END), 6) AS precision,
    round(avg(CASE WHEN t = 0 THEN 0 ELSE tp / t::DOUBLE END), 6) AS recall, round(avg(CASE WHEN t + p = 0 THEN 0 ELSE 2 * tp / (t + p)::DOUBLE END), 6) AS f1 FROM pl GROUP BY 1"""


@query("k06_macro_scores", "graded", MACRO.format(src="graded", p="prediction"))
def k06(spark, d):
    return rounded(metrics.macro_scores(graded(spark, d)), "accuracy", "precision", "recall", "f1")


@query("k06_macro_scores_of_flags", "pred", MACRO.format(src="pred", p="cluster"))
def k06_flags(spark, d):
    return rounded(metrics.macro_scores(predictions(spark, d), predicted="cluster"), "accuracy", "precision", "recall", "f1")


# --- internal ----------------------------------------------------------------------------------

# clusters of the check: the labels themselves
OWN = """, own AS (SELECT dataset_name, series_id, label AS cluster, series FROM ser)"""
SPREAD = """, st AS (SELECT dataset_name, cluster, unnest(range(0, len(series))) AS pos, unnest(series) AS v FROM {src}),
    mn AS (SELECT dataset_name, cluster, list(m ORDER BY pos) AS centre FROM (SELECT dataset_name, cluster, pos, avg(v) AS m FROM st GROUP BY 1, 2, 3) GROUP BY 1, 2),
    gm AS (SELECT dataset_name, list(m ORDER BY pos) AS overall FROM (SELECT dataset_name, pos, avg(v) AS m FROM st GROUP BY 1, 2) GROUP BY 1),
    sp AS (SELECT o.dataset_name, o.cluster, count(*) AS n, avg(list_distance(series, centre)) AS scatter, sum(pow(list_distance(series, centre), 2)) AS within
    FROM {src} o JOIN mn ON o.dataset_name = mn.dataset_name AND o.cluster = mn.cluster GROUP BY 1, 2),
    ch AS (SELECT sp.dataset_name, sum(sp.n * pow(list_distance(mn.centre, gm.overall), 2)) * (sum(sp.n) - count(*)) / (sum(within) * (count(*) - 1)) AS chs
    FROM sp JOIN mn ON sp.dataset_name = mn.dataset_name AND sp.cluster = mn.cluster JOIN gm ON sp.dataset_name = gm.dataset_name GROUP BY 1),
    db AS (SELECT dataset_name, avg(worst) AS dbs FROM (SELECT a.dataset_name, a.cluster, max((a.scatter + b.scatter) / list_distance(ma.centre, mb.centre)) AS worst
    FROM sp a JOIN sp b ON a.dataset_name = b.dataset_name AND a.cluster <> b.cluster JOIN mn ma ON ma.dataset_name = a.dataset_name AND ma.cluster = a.cluster
    JOIN mn mb ON mb.dataset_name = b.dataset_name AND mb.cluster = b.cluster GROUP BY 1, 2) GROUP BY 1)"""
SIL = """, pd AS (SELECT a.dataset_name, a.series_id, a.cluster, b.cluster AS other, sum(list_distance(a.series, b.series)) AS total, count(*) AS n
    FROM {src} a JOIN {src} b ON a.dataset_name = b.dataset_name GROUP BY 1, 2, 3, 4),
    ab AS (SELECT dataset_name, series_id, max(CASE WHEN cluster = other AND n > 1 THEN total / (n - 1) END) AS a, min(CASE WHEN cluster <> other THEN total / n END) AS b
    FROM pd GROUP BY 1, 2), sw AS (SELECT dataset_name, series_id, CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM ab),
    ss AS (SELECT dataset_name, avg(silhouette) AS ss FROM sw GROUP BY 1)"""


def _own(spark, d):
    return series(spark, d).withColumn("cluster", F.col("label"))


@query("c07_calinski_harabasz", "ser", OWN + SPREAD.format(src="own") + " SELECT dataset_name, round(chs, 6) AS chs FROM ch")
def c07(spark, d):
    return rounded(metrics.centre_scores(_own(spark, d)), "chs").select("dataset_name", "chs")


@query("c08_davies_bouldin", "ser", OWN + SPREAD.format(src="own") + " SELECT dataset_name, round(dbs, 6) AS dbs FROM db")
def c08(spark, d):
    return rounded(metrics.centre_scores(_own(spark, d)), "dbs").select("dataset_name", "dbs")


@query("c09_silhouette", "ser", OWN + SIL.format(src="own") + " SELECT dataset_name, round(ss, 6) AS ss FROM ss")
def c09(spark, d):
    return rounded(neighbours.silhouette_score(_own(spark, d)), "ss")


@query("j05_distance_sums", "ser", OWN + SIL.format(src="own") + " SELECT dataset_name, series_id, cluster, other, round(total, 6) AS total FROM pd")
def j05(spark, d):
    # small tiles, so that the grid has several lines at this size
    return rounded(neighbours.distance_sums(_own(spark, d), tile_rows=64), "total")


# --- nearest centre and k-means ----------------------------------------------------------------

START = """, ks AS (SELECT dataset_name, count(DISTINCT label) AS k FROM ser GROUP BY 1),
    c0 AS (SELECT dataset_name, rn - 1 AS cluster, series AS centre FROM (SELECT s.*, k, row_number() OVER (PARTITION BY s.dataset_name ORDER BY md5('42-' || series_id)) AS rn
    FROM {src} s JOIN ks ON s.dataset_name = ks.dataset_name) WHERE rn <= k)"""
ASSIGN = """, n{i} AS (SELECT s.dataset_name, s.series_id, arg_min(c.cluster, struct_pack(d := list_distance(s.series, c.centre), c := c.cluster)) AS cluster,
    min(list_distance(s.series, c.centre)) AS distance FROM {src} s JOIN c{i} c ON s.dataset_name = c.dataset_name GROUP BY 1, 2)"""
UPDATE = """, c{j} AS (SELECT dataset_name, cluster, list(m ORDER BY pos) AS centre FROM (SELECT dataset_name, cluster, pos, avg(v) AS m FROM
    (SELECT s.dataset_name, n.cluster, unnest(range(0, len(s.series))) AS pos, unnest(s.series) AS v FROM {src} s JOIN n{i} n ON s.dataset_name = n.dataset_name AND s.series_id = n.series_id)
    GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


def lloyd_sql(steps: int, src: str = "ser") -> str:
    out = START.format(src=src)
    for i in range(steps):
        out += ASSIGN.format(i=i, src=src) + UPDATE.format(i=i, j=i + 1, src=src)
    return out + ASSIGN.format(i=steps, src=src)


def _start(df):
    k = df.groupBy("dataset_name", "label").agg(F.lit(1).alias("_o")).groupBy("dataset_name").agg(F.count("label").alias("k"))
    return cluster.first_centres(df, k)


@query("j04_nearest_centre", "ser", lloyd_sql(0) + " SELECT dataset_name, series_id, cluster, round(distance, 6) AS distance FROM n0")
def j04(spark, d):
    rows = series(spark, d)
    return rounded(neighbours.nearest_centre(rows, _start(rows)), "distance").select("dataset_name", "series_id", "cluster", "distance")


CENTRE_ROWS = " SELECT dataset_name, cluster, unnest(range(0, len(centre))) AS pos, unnest(list_transform(centre, lambda x: round(x, 6))) AS value FROM c{0}"


@query("c01_lloyd_step", "ser", lloyd_sql(1) + CENTRE_ROWS.format(1))
def c01_step(spark, d):
    rows = series(spark, d)
    return long_series(cluster.lloyd_steps(rows, _start(rows), 1), ["dataset_name", "cluster"], "centre")


@query("c01_three_lloyd_steps", "ser", lloyd_sql(3) + CENTRE_ROWS.format(3))
def c01_three(spark, d):
    rows = series(spark, d)
    return long_series(cluster.lloyd_steps(rows, _start(rows), 3), ["dataset_name", "cluster"], "centre")


@query("c01_kmeans")
def c01(spark, d):
    fits = cluster.kmeans(series(spark, d))
    return cluster.best_restart(fits).select("dataset_name", "restart", "rounds", F.size("centres").alias("k"), F.round("inertia", 4).alias("inertia"))


@query("c02_seeding")
def c02(spark, d):
    """Start centres of all restarts: the centres after no round."""
    starts = cluster.kmeans(series(spark, d), max_iter=0)
    return long_series(starts.select("dataset_name", "restart", F.posexplode("centres").alias("cluster", "centre")), ["dataset_name", "restart", "cluster"], "centre")


# start points drawn by the same hash keys in SQL: the first row of each race, then the least keys of each round
FORCED = {"restarts": 2, "block_bytes": 16 << 10}  # several blocks per data set, so that the rounds over blocks run
TWO_64 = "18446744073709551616::UHUGEINT"
DRAWS = f""", s2 AS (SELECT dataset_name || '/' || r AS dataset_name, r, series_id, series FROM ser CROSS JOIN (VALUES (0), (1)) v(r)),
    km AS (SELECT dataset_name || '/' || r AS dataset_name, count(DISTINCT label) AS k FROM ser CROSS JOIN (VALUES (0), (1)) v(r) GROUP BY 1),
    h0 AS (SELECT dataset_name, series_id, pick, ((series_id::UHUGEINT + ({cluster.SEED} * 1000003 + r * 10007 + pick)::UHUGEINT * 11400714819323198485::UHUGEINT) % {TWO_64})::UBIGINT AS x
    FROM s2 CROSS JOIN (SELECT unnest(list_concat(range(0, 5), range(100, 132))) AS pick)),
    h1 AS (SELECT dataset_name, series_id, pick, ((xor(x, x >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % {TWO_64})::UBIGINT AS x FROM h0),
    h2 AS (SELECT dataset_name, series_id, pick, ((xor(x, x >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % {TWO_64})::UBIGINT AS x FROM h1),
    us AS (SELECT dataset_name, series_id, pick, ((xor(x, x >> 31) >> 11)::DOUBLE + 0.5) / 9007199254740992 AS u FROM h2),
    d0 AS (SELECT dataset_name, series_id, series FROM s2 JOIN us USING (dataset_name, series_id) WHERE pick = 0
    QUALIFY row_number() OVER (PARTITION BY dataset_name ORDER BY -ln(u), series_id) = 1)""" + "".join(f""",
    e{t} AS (SELECT s.dataset_name, s.series_id, s.series, min(pow(list_distance(s.series, c.series), 2)) AS d2 FROM s2 s JOIN d{t - 1} c USING (dataset_name) GROUP BY ALL),
    d{t} AS (SELECT * FROM d{t - 1} UNION ALL SELECT dataset_name, series_id, series FROM (SELECT dataset_name, series_id, series, k,
    row_number() OVER (PARTITION BY dataset_name ORDER BY -ln(u) / d2, series_id) AS rn FROM e{t} JOIN us USING (dataset_name, series_id) JOIN km USING (dataset_name)
    WHERE pick = {t} AND d2 > 1e-9) WHERE rn <= 2 * k)""" for t in range(1, 5)) + """,
    nc AS (SELECT s.dataset_name, s.series_id, arg_min(c.series_id, struct_pack(d := list_distance(s.series, c.series), c := c.series_id)) AS candidate FROM s2 s JOIN d4 c USING (dataset_name) GROUP BY 1, 2),
    cw AS (SELECT c.dataset_name, c.series_id, c.series, w FROM d4 c JOIN (SELECT dataset_name, candidate AS series_id, count(*) AS w FROM nc GROUP BY 1, 2) USING (dataset_name, series_id))"""


def picks_sql(most: int) -> str:
    """Start centres among the weighted candidates, up to ``most`` of them, as ``c0``."""
    sql = """, q0 AS (SELECT dataset_name, 0 AS cluster, series FROM cw JOIN us USING (dataset_name, series_id) WHERE pick = 100
    QUALIFY row_number() OVER (PARTITION BY dataset_name ORDER BY -ln(u) / w, series_id) = 1)"""
    for j in range(1, most):
        sql += f""", g{j} AS (SELECT c.dataset_name, c.series_id, c.series, w, min(pow(list_distance(c.series, q.series), 2)) AS d2 FROM cw c JOIN q{j - 1} q USING (dataset_name) GROUP BY ALL),
    q{j} AS (SELECT * FROM q{j - 1} UNION ALL (SELECT dataset_name, {j} AS cluster, series FROM g{j} JOIN us USING (dataset_name, series_id) JOIN km USING (dataset_name) WHERE pick = {100 + j} AND d2 > 1e-9 AND k > {j}
    QUALIFY row_number() OVER (PARTITION BY dataset_name ORDER BY -ln(u) / (w * d2), series_id) = 1))"""
    return sql + f", c0 AS (SELECT dataset_name, cluster, series AS centre FROM q{most - 1})"


ROUNDS_SQL = DRAWS + picks_sql(10) + "".join(ASSIGN.format(i=i, src="s2") + UPDATE.format(i=i, j=i + 1, src="s2") for i in range(3))


@query("c02_candidate_weights", "ser", DRAWS + """ SELECT split_part(dataset_name, '/', 1) AS dataset_name, split_part(dataset_name, '/', 2)::BIGINT AS restart, series_id, w AS weight FROM cw""")
def c02_weights(spark, d):
    """Candidates of the oversampled start points and the rows nearest to each, over blocks."""
    rows = series(spark, d)
    sizes = cluster.settings_of(rows, cluster.TOLERANCE)
    blocks = lloyd.blocks_of(rows, sizes, FORCED["block_bytes"])
    weighed = lloyd.candidates(blocks, lloyd.start_states(sizes, FORCED["restarts"]), cluster.SEED)
    each = weighed.select("dataset_name", F.col("restart").cast("bigint").alias("restart"), F.explode(F.arrays_zip("chosen", "counts")).alias("c"))
    return each.select("dataset_name", "restart", F.col("c.chosen.id").alias("series_id"), F.col("c.counts").cast("bigint").alias("weight"))


@query("c01_kmeans_over_blocks", "ser", ROUNDS_SQL + """ SELECT split_part(dataset_name, '/', 1) AS dataset_name, split_part(dataset_name, '/', 2)::BIGINT AS restart, cluster,
    unnest(range(0, len(centre))) AS pos, unnest(list_transform(centre, lambda x: round(x, 6))) + 0.0 AS value FROM c3""")
def c01_blocks(spark, d):
    """Start points, then three rounds over blocks, with bounds and summed changes."""
    fits = cluster.kmeans(series(spark, d), max_iter=3, tol=0.0, **FORCED)
    each = fits.select("dataset_name", F.col("restart").cast("bigint").alias("restart"), F.posexplode("centres").alias("cluster", "centre"))
    return long_series(each.withColumn("cluster", F.col("cluster").cast("bigint")), ["dataset_name", "restart", "cluster"], "centre")


@query("c01_costs_over_blocks", "ser", ROUNDS_SQL + ASSIGN.format(i=3, src="s2") + """ SELECT split_part(dataset_name, '/', 1) AS dataset_name, split_part(dataset_name, '/', 2)::BIGINT AS restart,
    round(sum(pow(distance, 2)), 6) AS inertia FROM n3 GROUP BY 1, 2""")
def c01_costs(spark, d):
    fits = cluster.kmeans(series(spark, d), max_iter=3, tol=0.0, **FORCED)
    return rounded(fits.select("dataset_name", F.col("restart").cast("bigint").alias("restart"), "inertia"), "inertia")


U = "(('0x' || substr(md5({seed} || '-' || dataset_name || '-' || i || '-{what}'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0"
INTERVALS = """, iv0 AS (SELECT dataset_name, {seed} AS seed, d, greatest(2, floor(d * 0.05)::BIGINT) AS least, unnest(range(0, 33)) AS i FROM
    (SELECT dataset_name, max(len(series)) AS d FROM ser GROUP BY 1) {seeds}),
    iv1 AS (SELECT *, floor(""" + U.format(seed="seed", what="start") + """ * (d - least))::BIGINT AS start FROM iv0),
    iv AS (SELECT dataset_name, seed, i AS interval, start, least + floor(""" + U.format(seed="seed", what="len") + """ * (d - start - least))::BIGINT AS len FROM iv1),
    ft AS (SELECT s.dataset_name, v.seed, s.series_id, s.label, list(list_sum(s.series[v.start + 1:v.start + v.len]) / v.len ORDER BY v.interval) AS series
    FROM ser s JOIN iv v ON s.dataset_name = v.dataset_name GROUP BY 1, 2, 3, 4)"""
ONE_SEED = INTERVALS.format(seed="1", seeds="")
FIVE_SEEDS = INTERVALS.format(seed="sd", seeds="CROSS JOIN (VALUES (1), (3), (5), (7), (9)) v(sd)")


@query("r06_interval_features", "ser", ONE_SEED + """ SELECT dataset_name, series_id, pos, round(value, 6) AS value FROM
    (SELECT dataset_name, series_id, unnest(range(0, 33)) AS pos, unnest(series) AS value FROM ft)""")
def r06(spark, d):
    rows = series(spark, d)
    features = cluster.interval_features(rows, cluster.draw_intervals(dataset_sizes(rows), 1))
    return long_series(features, ["dataset_name", "series_id"], "features")


@query("c03_raw_steps", "ser", ONE_SEED + lloyd_sql(2, "ft") + " SELECT dataset_name, series_id, cluster FROM n2")
def c03(spark, d):
    """Interval features, then two rounds from fixed starts."""
    rows = evaluate.raw_features(series(spark, d), 1)
    centres = cluster.lloyd_steps(rows, _start(rows), 2)
    return neighbours.nearest_centre(rows, centres).select("dataset_name", "series_id", "cluster")


@query("c11_seed_sweep", "ser", FIVE_SEEDS + """ SELECT dataset_name, seed::BIGINT AS seed, series_id, label, pos, round(value, 6) AS value FROM
    (SELECT dataset_name, seed, series_id, label, unnest(range(0, len(series))) AS pos, unnest(series) AS value FROM ft)""")
def c11(spark, d):
    rows = series(spark, d)
    swept = evaluate.raw_features_of_seeds(rows, cluster.DECOMPOSER_SEEDS)
    return long_series(swept.withColumn("seed", F.col("seed").cast("bigint")), ["dataset_name", "seed", "series_id", "label"], "features")


@query("c11_seed_sweep_scores")
def c11_scores(spark, d):
    return evaluate.cluster_raw(parts(spark, d), cluster.DECOMPOSER_SEEDS)


@query("c10_scores_of_fixed_clusters", "ser", lloyd_sql(3) + """, own AS (SELECT s.dataset_name, s.series_id, s.label, n.cluster, s.series FROM ser s
    JOIN n3 n ON s.dataset_name = n.dataset_name AND s.series_id = n.series_id)""" + CONT.format(src="own") + SPREAD.format(src="own") + SIL.format(src="own") + """
    , nk AS (SELECT dataset_name, max(len(series)) AS n_features, count(DISTINCT label) AS n_classes FROM ser GROUP BY 1)
    SELECT nk.*, round(ari, 6) AS ari, round(nmi, 6) AS nmi, round(fmi, 6) AS fmi, round(chs, 6) AS chs, round(dbs, 6) AS dbs, round(ss, 6) AS ss
    FROM nk JOIN ext USING (dataset_name) JOIN ch USING (dataset_name) JOIN db USING (dataset_name) JOIN ss USING (dataset_name)""")
def c10(spark, d):
    rows = series(spark, d)
    clustered = materialise(neighbours.nearest_centre(rows, cluster.lloyd_steps(rows, _start(rows), 3)), "clustered")
    return rounded(evaluate.clustering_scores(clustered), "ari", "nmi", "fmi", "chs", "dbs", "ss")


BY_MODEL = """, own AS (SELECT dataset_name || '/m' || ((series_id // 4) % 2) || '/' || sd AS dataset_name, series_id, label, label % (sd + 2) AS cluster, series
    FROM ser CROSS JOIN (VALUES (1), (2)) v(sd))"""


@query("c10_scores_by_model_and_seed", "ser", BY_MODEL + CONT.format(src="own") + SPREAD.format(src="own") + SIL.format(src="own") + """
    , nk AS (SELECT dataset_name, max(len(series)) AS n_features, count(DISTINCT label) AS n_classes FROM own GROUP BY 1),
    every AS (SELECT * FROM nk JOIN ext USING (dataset_name) JOIN ch USING (dataset_name) JOIN db USING (dataset_name) JOIN ss USING (dataset_name))
    SELECT split_part(dataset_name, '/', 1) AS dataset_name, split_part(dataset_name, '/', 2) AS model_name, split_part(dataset_name, '/', 3)::BIGINT AS seed,
    n_features, n_classes, round(ari, 6) AS ari, round(nmi, 6) AS nmi, round(fmi, 6) AS fmi, round(chs, 6) AS chs, round(dbs, 6) AS dbs, round(ss, 6) AS ss FROM every""")
def c10_by_model(spark, d):
    """Two models and two seeds in one table; each combination is scored as a data set of its own."""
    rows = series(spark, d).withColumn("seed", F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))))
    rows = rows.withColumn("model_name", F.concat(F.lit("m"), (F.floor(F.col("series_id") / 4) % 2).cast("string")))
    rows = rows.withColumn("cluster", F.col("label") % (F.col("seed") + 2))
    scores = evaluate.scores_by(evaluate.clustering_scores, rows, ["dataset_name", "model_name", "seed"])
    return rounded(scores, "ari", "nmi", "fmi", "chs", "dbs", "ss")


@query("c10_rejected_datasets", "ser", """, holed AS (SELECT dataset_name, series_id, CASE WHEN dataset_name = 'ds1' AND series_id % 7 = 1 THEN 1 ELSE 0 END AS bad FROM ser)
    SELECT dataset_name, CASE WHEN sum(bad) > 0 THEN 'missing values' ELSE 'one cluster' END AS reason FROM holed
    GROUP BY 1 HAVING sum(bad) > 0 OR dataset_name = 'ds2'""")
def c10_rejected(spark, d):
    """One data set has holes, another ends in one cluster; both are reported."""
    hole = (F.col("dataset_name") == "ds1") & (F.col("series_id") % 7 == 1)
    holed = series(spark, d).withColumn("series", F.transform("series", lambda x, i: F.when(~(hole & (i == 3)), x)))
    kept, rejected = prep.reject_missing(holed)
    clustered = kept.withColumn("cluster", F.when(F.col("dataset_name") == "ds2", 0).otherwise(F.col("label") % 3))
    single = evaluate.one_cluster_datasets(evaluate.clustering_scores(clustered))
    return rejected.select("dataset_name", F.lit("missing values").alias("reason")).unionByName(single)


@query("c10_cluster_and_evaluate")
def c10_full(spark, d):
    results, _ = evaluate.cluster_and_evaluate(series(spark, d), "representation")
    return results
