"""Queries of batches, mixing, losses in a batch, and training logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlab.catalog.base import month_number, query, rounded, series, table, training_log
from strandlab.functions import arrays, scalars
from strandlab.operators import batches, logs

PADDED = """, sizes AS (SELECT dataset_name, max(place) AS n FROM batched GROUP BY 1),
    padded AS (SELECT dataset_name, series_id, batch_id, 0 AS copy FROM batched UNION ALL
    SELECT b.dataset_name, b.series_id, b.batch_id, unnest(range(1, 9 - s.n % 8)) FROM batched b JOIN sizes s ON b.dataset_name = s.dataset_name
    WHERE b.place = s.n AND s.n % 8 <> 0)"""
PARTNERS = """, perm AS (SELECT *, row_number() OVER (PARTITION BY dataset_name, batch_id ORDER BY place) AS i,
    row_number() OVER (PARTITION BY dataset_name, batch_id ORDER BY md5('42-' || batch_id || '-' || series_id)) AS j FROM batched),
    pairs AS (SELECT a.dataset_name, a.batch_id, a.series_id, b.series_id AS partner_id, a.series AS s1, b.series AS s2
    FROM perm a JOIN perm b ON a.dataset_name = b.dataset_name AND a.batch_id = b.batch_id AND a.i = b.j),
    shared AS (SELECT *, (('0x' || substr(md5('42-mix-' || dataset_name || '-' || batch_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0 AS share FROM pairs),
    mixed AS (SELECT *, list_transform(s1, lambda x, i: share * x + (1 - share) * s2[i]) AS m FROM shared)"""


def _batched(spark, d):
    return batches.with_batches(batches.in_order(series(spark, d)))


def _mixed(spark, d):
    return batches.mixed_rows(batches.batch_partners(_batched(spark, d), 42), 42)


@query("w03_batch_ids", "batched", "SELECT dataset_name, series_id, place, batch_id FROM batched")
def w03(spark, d):
    return _batched(spark, d).select("dataset_name", "series_id", "place", "batch_id")


@query("w03_batches_of_a_shuffled_epoch", "ser", """SELECT dataset_name, series_id,
    (row_number() OVER (PARTITION BY dataset_name ORDER BY md5('42-3-' || series_id)) - 1) // 8 AS batch_id FROM ser""")
def w03_shuffled(spark, d):
    return batches.with_batches(batches.shuffled(series(spark, d), 42, 3)).select("dataset_name", "series_id", "batch_id")


@query("w04_padded_batches", "batched", PADDED + " SELECT dataset_name, series_id, batch_id, copy::BIGINT AS copy FROM padded")
def w04(spark, d):
    padded = batches.pad_last_batch(_batched(spark, d))
    return padded.select("dataset_name", "series_id", "batch_id", F.col("copy").cast("bigint"))


@query("j06_batch_partners", "batched", PARTNERS + " SELECT dataset_name, batch_id, series_id, partner_id FROM pairs")
def j06(spark, d):
    return batches.batch_partners(_batched(spark, d), 42).drop("series_1", "series_2")


@query("j07_batch_similarities", "batched", PARTNERS + """, c AS (SELECT *, row_number() OVER (PARTITION BY dataset_name, batch_id ORDER BY series_id) - 1 AS pos FROM mixed)
    SELECT a.dataset_name, a.batch_id, a.series_id, b.pos, round(list_inner_product(a.m, b.s1), 6) AS similarity
    FROM c a JOIN c b ON a.dataset_name = b.dataset_name AND a.batch_id = b.batch_id""")
def j07(spark, d):
    rows = batches.batch_similarities(_mixed(spark, d))
    return rows.select("dataset_name", "batch_id", "series_id", F.posexplode("similarities").alias("pos", "_s")).select(
        "dataset_name", "batch_id", "series_id", F.col("pos").cast("bigint"), F.round("_s", 6).alias("similarity")
    )


@query("r07_mixed_rows", "batched", PARTNERS + """ SELECT dataset_name, batch_id, series_id, partner_id, pos, round(value, 6) AS value FROM
    (SELECT dataset_name, batch_id, series_id, partner_id, unnest(range(0, 64)) AS pos, unnest(m) AS value FROM mixed)""")
def r07(spark, d):
    rows = _mixed(spark, d).select("dataset_name", "batch_id", "series_id", "partner_id", F.posexplode("mixed").alias("pos", "value"))
    return rounded(rows.withColumn("pos", F.col("pos").cast("bigint")), "value")


def _unit(what: str, i: str) -> str:
    return f"(('0x' || substr(md5(k || '-{what}-' || {i}), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0"


def _gamma_ctes(tag: str, shape: float) -> str:
    """Gamma number of each batch key below shape 1, by the same rejection rule."""
    d = shape + 1 - 1 / 3
    return f""", {tag}0 AS (SELECT *, pow(1 + x / sqrt(9 * {d!r}::DOUBLE), 3) AS v FROM (SELECT k, i,
        sqrt(-2 * ln({_unit(tag + "n", "i")})) * cos(2 * pi() * {_unit(tag + "m", "i")}) AS x, {_unit(tag + "u", "i")} AS u FROM bk CROSS JOIN range(0, 16) g(i))),
    {tag}1 AS (SELECT k, arg_min(v, i) AS v FROM {tag}0 WHERE v > 0 AND ln(u) < 0.5 * x * x + {d!r}::DOUBLE - {d!r}::DOUBLE * v + {d!r}::DOUBLE * ln(v) GROUP BY 1),
    {tag} AS (SELECT k, v * {d!r}::DOUBLE * pow({_unit(tag + "p", "0")}, 1 / {shape!r}::DOUBLE) AS {tag} FROM {tag}1)"""


@query("r07_mixed_rows_beta", "batched", PARTNERS + """, bk AS (SELECT DISTINCT dataset_name, batch_id, md5('42-mix-' || dataset_name || '-' || batch_id) AS k FROM mixed)"""
       + _gamma_ctes("a", 0.4) + _gamma_ctes("b", 0.4) + """, s AS (SELECT dataset_name, batch_id, a / (a + b) AS beta FROM bk JOIN a USING (k) JOIN b USING (k))
    SELECT dataset_name, batch_id, series_id, partner_id, pos, round(beta, 6) AS share, round(value, 6) AS value FROM (SELECT dataset_name, batch_id, series_id, partner_id, beta,
    unnest(range(0, 64)) AS pos, unnest(list_transform(list_zip(s1, s2), lambda z: beta * z[1] + (1 - beta) * z[2])) AS value FROM mixed JOIN s USING (dataset_name, batch_id))""")
def r07_beta(spark, d):
    rows = batches.mixed_rows(batches.batch_partners(_batched(spark, d), 42), 42, alpha=0.4)
    long = rows.select("dataset_name", "batch_id", "series_id", "partner_id", "share", F.posexplode("mixed").alias("pos", "value"))
    return rounded(long.withColumn("pos", F.col("pos").cast("bigint")), "share", "value")


@query("r08_contrastive_loss", "batched", PARTNERS + """, u AS (SELECT dataset_name, batch_id, series_id, share,
    list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS z, list_transform(s1, lambda x: x / sqrt(list_inner_product(s1, s1))) AS z1,
    list_transform(s2, lambda x: x / sqrt(list_inner_product(s2, s2))) AS z2 FROM mixed),
    l AS (SELECT a.dataset_name, a.batch_id, a.series_id, a.share, list_inner_product(a.z, b.z1) / 0.5 AS l1, list_inner_product(a.z, b.z2) / 0.5 AS l2,
    a.series_id = b.series_id AS own FROM u a JOIN u b ON a.dataset_name = b.dataset_name AND a.batch_id = b.batch_id),
    r AS (SELECT dataset_name, batch_id, series_id, ln(sum(exp(l1) + exp(l2))) AS lse,
    max(CASE WHEN own THEN share * l1 + (1 - share) * l2 END) AS picked FROM l GROUP BY 1, 2, 3)
    SELECT dataset_name, batch_id, round(avg(lse - picked), 6) AS loss FROM r GROUP BY 1, 2""")
def r08(spark, d):
    return rounded(batches.contrastive_loss(_mixed(spark, d)), "loss")


# --- logs --------------------------------------------------------------------------------------


@query("w05_early_stop", "", """WITH RECURSIVE log AS (SELECT 'T' || o_orderstatus AS dataset_name, o_orderpriority AS model_name,
    CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS BIGINT) AS epoch, round(avg(o_totalprice) / 99991, 6) AS val_loss FROM orders GROUP BY 1, 2, 3),
    o AS (SELECT *, row_number() OVER (PARTITION BY dataset_name, model_name ORDER BY epoch) AS i FROM log),
    f AS (SELECT dataset_name, model_name, i, val_loss AS best, epoch AS best_epoch, 0::BIGINT AS misses, NULL::BIGINT AS stop_epoch FROM o WHERE i = 1
    UNION ALL SELECT f.dataset_name, f.model_name, o.i,
    CASE WHEN f.stop_epoch IS NULL AND o.val_loss + 0.0005 < f.best THEN o.val_loss ELSE f.best END,
    CASE WHEN f.stop_epoch IS NULL AND o.val_loss + 0.0005 < f.best THEN o.epoch ELSE f.best_epoch END,
    CASE WHEN f.stop_epoch IS NOT NULL THEN f.misses WHEN o.val_loss + 0.0005 < f.best THEN 0 ELSE f.misses + 1 END,
    CASE WHEN f.stop_epoch IS NOT NULL THEN f.stop_epoch WHEN o.val_loss + 0.0005 < f.best THEN NULL WHEN f.misses + 1 >= 8 THEN o.epoch END
    FROM f JOIN o ON o.dataset_name = f.dataset_name AND o.model_name = f.model_name AND o.i = f.i + 1)
    SELECT dataset_name, model_name, best AS best_loss, best_epoch, misses, stop_epoch FROM f
    QUALIFY row_number() OVER (PARTITION BY dataset_name, model_name ORDER BY i DESC) = 1""")
def w05(spark, d):
    settings = logs.early_stopping_settings(80)
    return logs.early_stop(training_log(spark, d), settings["min_delta"], settings["patience"])


@query("w06_best_checkpoint", "log", """SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY dataset_name, model_name ORDER BY val_loss, epoch) = 1""")
def w06(spark, d):
    return logs.best_checkpoint(training_log(spark, d))


@query("w06_fallback_to_last", "log", """, l AS (SELECT * REPLACE (CASE WHEN model_name <> '5-LOW' THEN val_loss END AS val_loss) FROM log)
    SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY dataset_name, model_name ORDER BY val_loss NULLS LAST,
    CASE WHEN model_name <> '5-LOW' THEN epoch ELSE -epoch END) = 1""")
def w06_last(spark, d):
    known = F.when(F.col("model_name") != "5-LOW", F.col("val_loss"))
    return logs.best_checkpoint(training_log(spark, d).withColumn("val_loss", known))


@query("w07_final_checkpoint", "log", """SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY dataset_name, model_name ORDER BY epoch DESC) = 1""")
def w07(spark, d):
    return logs.final_checkpoint(training_log(spark, d))


STEPS = """, days AS (SELECT 'T' || o_orderstatus AS dataset_name, o_orderpriority AS model_name,
    CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS BIGINT) AS epoch, o_orderdate AS step, avg(o_totalprice) / 99991 AS loss, count(*) AS n
    FROM orders GROUP BY 1, 2, 3, 4), means AS (SELECT dataset_name, model_name, epoch, round(sum(loss * n) / sum(n), 6) AS loss FROM days GROUP BY 1, 2, 3)"""


def _epoch_means(spark, d):
    steps = (
        table(spark, d, "orders")
        .groupBy(
            F.concat(F.lit("T"), F.col("o_orderstatus")).alias("dataset_name"),
            F.col("o_orderpriority").alias("model_name"),
            month_number().alias("epoch"),
            F.col("o_orderdate").alias("step"),
        )
        .agg((F.avg("o_totalprice") / 99991).alias("loss"), F.count(F.lit(1)).alias("n"))
    )
    return rounded(logs.epoch_means(steps), "loss")


@query("w09_epoch_means", "log", STEPS + " SELECT * FROM means")
def w09(spark, d):
    return _epoch_means(spark, d)


@query("w09_running_best", "log", STEPS + """ SELECT *, min(loss) OVER w AS best_so_far, max(loss) OVER w AS worst_so_far FROM means
    WINDOW w AS (PARTITION BY dataset_name, model_name ORDER BY epoch ROWS UNBOUNDED PRECEDING)""")
def w09_running(spark, d):
    return logs.running_best(_epoch_means(spark, d), "loss")


@query("w10_best_setting", "", """WITH s AS (SELECT l_suppkey, l_linenumber::BIGINT AS c, round(avg(l_discount / 0.99991::DOUBLE), 2) AS score FROM lineitem GROUP BY 1, 2)
    SELECT l_suppkey, c, score FROM s QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, c) = 1""")
def w10(spark, d):
    scores = table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_linenumber").cast("bigint").alias("c")).agg(
        F.round(F.avg(F.col("l_discount") / 0.99991), 2).alias("score")
    )
    return logs.best_setting(scores, ["l_suppkey"], "c", "score")


RAMP = "CASE WHEN epoch < 5 THEN 0 ELSE 0.9 * pow((greatest(epoch - 5, 0)) / 75.0::DOUBLE, 1.5) END"


@query("r11_hint_coefficient", "log", f"SELECT dataset_name, model_name, epoch, round({RAMP}, 6) + 0.0 AS train_c, 0.0::DOUBLE AS valid_c FROM log")
def r11(spark, d):
    ramp = scalars.hint_coefficient("epoch", 80, final=0.9, start=0.0, rate=1.5, start_epoch=5)
    valid = scalars.hint_coefficient("epoch", 80, final=0.9, mode="valid")
    return training_log(spark, d).select("dataset_name", "model_name", "epoch", F.round(ramp, 6).alias("train_c"), valid.alias("valid_c"))


@query("r12_total_loss", "log", f"SELECT dataset_name, model_name, epoch, round((1 - ({RAMP})) * train_loss + ({RAMP}) * val_loss, 6) AS loss FROM log")
def r12(spark, d):
    ramp = scalars.hint_coefficient("epoch", 80, final=0.9, start=0.0, rate=1.5, start_epoch=5)
    total = scalars.total_loss("train_loss", "val_loss", ramp)
    return training_log(spark, d).select("dataset_name", "model_name", "epoch", F.round(total, 6).alias("loss"))
