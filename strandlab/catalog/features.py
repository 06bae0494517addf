"""Queries of statistics, array functions and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlab.catalog.base import events, long_series, parts, query, rounded, series, table
from strandlab.functions import arrays, registry, scalars
from strandlab.operators import ordering, prep, scaling, stats

KEYS = ["dataset_name", "series_id"]


def _steps_of(expr: str, source: str = "ser", where: str = "") -> str:
    return f"SELECT dataset_name, series_id, unnest(range(0, len({expr}))) AS pos, unnest({expr}) AS value FROM {source} {where}"


def _rounded_steps(expr: str, source: str = "ser") -> str:
    return f"SELECT dataset_name, series_id, pos, round(value, 6) AS value FROM ({_steps_of(expr, source)})"


# --- aggregates --------------------------------------------------------------------------------


@query("a01_class_and_feature_counts", "ser", "SELECT dataset_name, count(DISTINCT label) AS n_classes, max(len(series)) AS n_features FROM ser GROUP BY 1")
def a01(spark, d):
    return stats.class_and_feature_counts(series(spark, d))


FIVE = "round(median({0}), 6) AS median, round(avg({0}), 6) AS mean, round(stddev_pop({0}), 6) AS std, min({0}) AS min, max({0}) AS max"


@query("a02_five_numbers", "", f"SELECT user_id, {FIVE.format('value')} FROM events GROUP BY 1")
def a02(spark, d):
    return rounded(stats.five_numbers(events(spark, d), ["user_id"], "value"), "median", "mean", "std")


@query("a02_five_numbers_of_prices", "", f"SELECT l_returnflag, l_linestatus, {FIVE.format('l_extendedprice').replace(', 6)', ', 4)')} FROM lineitem GROUP BY 1, 2")
def a02_prices(spark, d):
    numbers = stats.five_numbers(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return rounded(numbers, "median", "mean", "std", digits=4)


@query("a02_quantiles_of_prices", "", """SELECT l_returnflag, l_linestatus, round(quantile_cont(p, 0.1), 4) AS low, round(quantile_cont(p, 0.5), 4) AS middle, round(quantile_cont(p, 0.95), 4) AS high
    FROM (SELECT l_returnflag, l_linestatus, l_extendedprice::DOUBLE AS p FROM lineitem) GROUP BY 1, 2""")
def a02_quantiles(spark, d):
    """Three quantiles of all groups in the same two passes."""
    found = ordering.group_quantiles(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.1, 0.5, 0.95])
    return found.select("l_returnflag", "l_linestatus", *[F.round(F.col("quantiles")[i], 4).alias(n) for i, n in enumerate(("low", "middle", "high"))])


@query("a03_five_numbers_of_series", "steps", f"SELECT dataset_name, {FIVE.format('value')} FROM steps GROUP BY 1")
def a03(spark, d):
    return rounded(stats.five_numbers_of_series(series(spark, d)), "median", "mean", "std")


@query("a11_step_ranges", "parts", """, s AS (SELECT dataset_name, unnest(range(0, 64)) AS pos, unnest(series) AS value FROM parts WHERE part = 'train')
    SELECT dataset_name, pos, min(value) AS low, max(value) AS high FROM s GROUP BY 1, 2""")
def a11(spark, d):
    fit = scaling.step_ranges(parts(spark, d).where("part = 'train'"))
    return fit.withColumn("pos", F.col("pos").cast("bigint"))


PAIRS = """, nested AS (SELECT dataset_name, series_id, part, list_transform(range(0, 32), lambda i: [series[2 * i + 1], series[2 * i + 2]]) AS steps FROM parts),
    flat AS (SELECT dataset_name, series_id, part, t, unnest(range(0, 2)) AS channel, unnest(step) AS value FROM
    (SELECT dataset_name, series_id, part, unnest(range(0, 32)) AS t, unnest(steps) AS step FROM nested))"""


def _nested(spark, d):
    """Series folded into 32 steps of two channels."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.array(F.get("series", 2 * i), F.get("series", 2 * i + 1)))
    return parts(spark, d).withColumn("steps", pairs)


@query("a12_channel_ranges", "parts", PAIRS + " SELECT dataset_name, channel, min(value) AS low, max(value) AS high FROM flat GROUP BY 1, 2")
def a12(spark, d):
    fit = scaling.channel_ranges(_nested(spark, d))
    return fit.withColumn("channel", F.col("channel").cast("bigint"))


@query("a12_merged_ranges", "parts", PAIRS + " SELECT dataset_name, channel, min(value) AS low, max(value) AS high FROM flat GROUP BY 1, 2")
def a12_merged(spark, d):
    rows = _nested(spark, d)
    fits = [scaling.channel_ranges(rows.where(F.col("part") == p)) for p in ("train", "valid", "test")]
    return scaling.merge_ranges(*fits).withColumn("channel", F.col("channel").cast("bigint"))


@query("a13_audit", "", """SELECT l_returnflag, count(*) FILTER (l_linenumber = 1) AS n_nan, count(*) FILTER (l_linenumber = 2) AS n_pos_inf,
    count(*) FILTER (l_linenumber = 3) AS n_neg_inf FROM lineitem GROUP BY 1""")
def a13(spark, d):
    odd = (
        F.when(F.col("l_linenumber") == 1, F.lit(float("nan")))
        .when(F.col("l_linenumber") == 2, F.lit(float("inf")))
        .when(F.col("l_linenumber") == 3, F.lit(float("-inf")))
        .otherwise(F.col("l_extendedprice"))
    )
    return table(spark, d, "lineitem").withColumn("v", odd).groupBy("l_returnflag").agg(*stats.audit_counts("v"))


@query("a14_processed_and_removed", "ser", """, holed AS (SELECT dataset_name || '-' || label AS dataset_name, series_id % 97 = 0 AS bad FROM ser),
    per AS (SELECT dataset_name, bool_or(bad) AS bad, count(*) AS n FROM holed GROUP BY 1)
    SELECT count(*) AS n_datasets, count(*) FILTER (bad) AS n_datasets_removed, sum(n)::BIGINT AS n_rows,
    coalesce(sum(n) FILTER (bad), 0)::BIGINT AS n_rows_removed FROM per""")
def a14(spark, d):
    from strandlab.catalog.preparing import _holed

    rows = _holed(spark, d)
    return stats.processed_and_removed(rows, prep.reject_missing(rows)[1])


# --- scalar and array functions ----------------------------------------------------------------


@query("f01_closest_power_of_2", "", """WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS r FROM lineitem),
    p AS (SELECT *, pow(2.0, floor(log2(r))) AS low FROM r)
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN r - low < 2 * low - r THEN low ELSE 2 * low END AS power FROM p""")
def f01(spark, d):
    power = scalars.closest_power_of_2("l_extendedprice", F.col("l_quantity"))
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint"), power.alias("power"))


@query("f01_ties_go_up", "", """WITH r AS (SELECT p_partkey, p_size / 4.0::DOUBLE AS r FROM part),
    p AS (SELECT *, pow(2.0, floor(log2(r))) AS low FROM r)
    SELECT p_partkey, CASE WHEN r = low OR r - low < 2 * low - r THEN low ELSE 2 * low END AS power FROM p""")
def f01_ties(spark, d):
    return table(spark, d, "part").select("p_partkey", scalars.closest_power_of_2("p_size", 4).alias("power"))


@query("f02_representation_size", "", """WITH e AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
    r AS (SELECT user_id, n, n / 2.0::DOUBLE AS r, pow(2.0, floor(log2(n / 2.0::DOUBLE))) AS low FROM e)
    SELECT user_id, n AS length, (CASE WHEN r = low OR r - low < 2 * low - r THEN low ELSE 2 * low END)::BIGINT AS size FROM r""")
def f02(spark, d):
    lengths = events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("length"))
    return lengths.withColumn("size", scalars.representation_size(F.sequence(F.lit(1), "length"), 2))


@query("f03_prefix", "", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 3 = 1 THEN c_name ELSE c_mktsegment || '_' || c_name END AS name FROM customer""")
def f03(spark, d):
    third = F.col("c_custkey") % 3
    prefix = F.when(third == 0, "").when(third == 2, F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", scalars.prefixed("c_name", prefix).alias("name"))


@query("f04_flatten_nested", "parts", PAIRS + """ SELECT dataset_name, series_id, t * 2 + channel AS pos, round(value, 6) AS value FROM flat""")
def f04(spark, d):
    return long_series(_nested(spark, d).withColumn("flat", arrays.flatten_nested("steps", 2)), KEYS, "flat")


@query("f05_flatten_list_of_arrays", "ser", """SELECT dataset_name, label, sum(len(series))::BIGINT AS n, round(sum(list_sum(series)), 6) AS total FROM ser GROUP BY 1, 2""")
def f05(spark, d):
    flat = series(spark, d).select("dataset_name", "label", F.explode("series").alias("v"))
    return flat.groupBy("dataset_name", "label").agg(F.count("v").alias("n"), F.round(F.sum("v"), 6).alias("total"))


@query("f06_tuples_to_matrix", "", """SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS l_linenumber, v.pos, v.value FROM lineitem,
    LATERAL (VALUES (0::BIGINT, l_quantity), (1, l_discount), (2, l_tax)) v(pos, value)""")
def f06(spark, d):
    tuples = F.array(F.struct(F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"), F.col("l_tax").alias("c")))
    rows = table(spark, d, "lineitem").withColumn("m", arrays.tuples_to_matrix(tuples, ["a", "b", "c"]))
    return rows.select("l_orderkey", "l_partkey", F.col("l_linenumber").cast("bigint"), F.posexplode(F.col("m")[0]).alias("pos", "value")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


@query("f07_series_length", "ser", "SELECT dataset_name, series_id, len(series) AS length FROM ser")
def f07(spark, d):
    return series(spark, d).select(*KEYS, arrays.series_length("series").alias("length"))


@query("f08_expand_steps", "ser", """SELECT dataset_name, series_id, pos, len(step) AS width, round(step[1], 6) AS value FROM (""" + _steps_of("list_transform(series, lambda x: [x])").replace("AS value", "AS step") + ")")
def f08(spark, d):
    rows = series(spark, d).select(*KEYS, F.posexplode(arrays.expand_steps("series")).alias("pos", "step"))
    return rows.select(*KEYS, F.col("pos").cast("bigint"), F.size("step").cast("bigint").alias("width"), F.round(F.col("step")[0], 6).alias("value"))


@query("f09_cast_series", "ser", """SELECT dataset_name, series_id, pos, value::FLOAT::DOUBLE AS as_float, trunc(value * 100)::BIGINT AS as_long FROM (""" + _steps_of("series") + ")")
def f09(spark, d):
    rows = series(spark, d)
    hundred = F.transform("series", lambda x: x * 100)
    both = F.arrays_zip(arrays.cast_series("series", "float").alias("f"), arrays.cast_series(hundred, "long").alias("l"))
    steps = rows.select(*KEYS, F.posexplode(both).alias("pos", "z"))
    return steps.select(*KEYS, F.col("pos").cast("bigint"), F.col("z.f").cast("double").alias("as_float"), F.col("z.l").alias("as_long"))


@query("f10_panel", "ser", "SELECT dataset_name, series_id, 1::BIGINT AS channels, len(series) AS steps, round(list_sum(series), 6) AS total FROM ser")
def f10(spark, d):
    rows = series(spark, d)
    panel = rows.withColumn("panel", arrays.as_panel("series", dict(rows.dtypes)["series"]))
    again = panel.withColumn("panel", arrays.as_panel("panel", dict(panel.dtypes)["panel"]))
    return again.select(
        *KEYS, F.size("panel").cast("bigint").alias("channels"), F.size(F.col("panel")[0]).cast("bigint").alias("steps"),
        F.round(arrays.total(F.col("panel")[0]), 6).alias("total"),
    )


@query("f11_reverse_time", "ser", _rounded_steps("list_reverse(series)"))
def f11(spark, d):
    return long_series(series(spark, d).withColumn("series", arrays.reverse_time("series")), KEYS)


@query("f12_last_state", "ser", "SELECT dataset_name, series_id, round(series[-1], 6) AS last FROM ser")
def f12(spark, d):
    return series(spark, d).select(*KEYS, F.round(arrays.last_state("series"), 6).alias("last"))


@query("f13_l2_normalise", "ser", _rounded_steps("list_transform(series, lambda x: x / greatest(sqrt(list_inner_product(series, series)), 1e-12))"))
def f13(spark, d):
    return long_series(series(spark, d).withColumn("series", arrays.l2_normalise("series")), KEYS)


SOFTMAX = "list_transform(series, lambda x: x - list_max(series) - ln(list_sum(list_transform(series, lambda y: exp(y - list_max(series))))))"


@query("f14_log_softmax", "ser", _rounded_steps(SOFTMAX))
def f14(spark, d):
    return long_series(series(spark, d).withColumn("series", arrays.log_softmax("series")), KEYS)


@query("f14_soft_cross_entropy", "ser", f""", t AS (SELECT dataset_name, series_id, series, {SOFTMAX} AS logs FROM ser)
    SELECT dataset_name, series_id, round(-(0.7 * logs[1] + 0.3 * logs[64]), 6) AS loss FROM t""")
def f14_loss(spark, d):
    size = F.size("series")
    target = F.transform("series", lambda x, i: F.when(i == 0, 0.7).when(i == size - 1, 0.3).otherwise(0.0))
    return series(spark, d).select(*KEYS, F.round(arrays.soft_cross_entropy("series", target), 6).alias("loss"))


# one step is made constant in the fit to show the rule for it
SCALED = """, p2 AS (SELECT dataset_name, series_id, part, list_transform(series, lambda x, i: CASE WHEN i = 6 THEN 1.5 ELSE x END) AS series FROM parts),
    s AS (SELECT dataset_name, series_id, part, unnest(range(0, 64)) AS pos, unnest(series) AS value FROM p2),
    fit AS (SELECT dataset_name, pos, min(value) AS low, max(value) AS high, avg(value) AS mean, stddev_pop(value) AS std FROM s WHERE part = 'train' GROUP BY 1, 2)"""


def _with_constant_step(spark, d):
    fixed = F.transform("series", lambda x, i: F.when(i == 5, F.lit(1.5)).otherwise(x))
    return parts(spark, d).withColumn("series", fixed)


@query("f15_min_max_steps", "parts", SCALED + """ SELECT s.dataset_name, series_id, s.pos, round(-1 + (value - low) * 2 / CASE WHEN high = low THEN 1 ELSE high - low END, 6) + 0.0 AS value
    FROM s JOIN fit ON s.dataset_name = fit.dataset_name AND s.pos = fit.pos""")
def f15(spark, d):
    rows = _with_constant_step(spark, d)
    fit = scaling.step_ranges(rows.where("part = 'train'"))
    return long_series(scaling.scale_steps(rows, fit, -1.0, 1.0), KEYS)


@query("f16_min_max_channels", "parts", PAIRS + """, fit AS (SELECT dataset_name, channel, min(value) AS low, max(value) AS high FROM flat WHERE part = 'train' GROUP BY 1, 2)
    SELECT flat.dataset_name, series_id, t * 2 + flat.channel AS pos, round((value - low) / (high - low), 6) AS value
    FROM flat JOIN fit ON flat.dataset_name = fit.dataset_name AND flat.channel = fit.channel""")
def f16(spark, d):
    rows = _nested(spark, d)
    scaled = scaling.scale_channels(rows, scaling.channel_ranges(rows.where("part = 'train'")))
    return long_series(scaled.withColumn("flat", F.flatten("steps")), KEYS, "flat")


@query("f17_normaliser", "parts", SCALED + """ SELECT s.dataset_name, series_id, s.pos, round((value - low) / CASE WHEN high = low THEN 1 ELSE high - low END, 6) + 0.0 AS value
    FROM s JOIN fit ON s.dataset_name = fit.dataset_name AND s.pos = fit.pos""")
def f17(spark, d):
    return long_series(_with_constant_step(spark, d).transform(scaling.make_normaliser(True, (0.0, 1.0))), KEYS)


@query("f18_impute", "ser", """SELECT dataset_name, series_id, pos, CASE WHEN (series_id + pos) % 7 < 2 THEN 0.0 ELSE round(value, 6) END AS value FROM (""" + _steps_of("series") + ")")
def f18(spark, d):
    seventh = lambda i: (F.col("series_id") + i) % 7
    holed = F.transform("series", lambda x, i: F.when(seventh(i) == 0, F.lit(None)).when(seventh(i) == 1, F.lit(float("nan"))).otherwise(x))
    return long_series(series(spark, d).withColumn("series", arrays.impute(holed)), KEYS)


@query("f19_standardise", "parts", SCALED + """ SELECT s.dataset_name, series_id, s.pos, round((value - mean) / CASE WHEN std = 0 THEN 1 ELSE std END, 6) + 0.0 AS value
    FROM s JOIN fit ON s.dataset_name = fit.dataset_name AND s.pos = fit.pos""")
def f19(spark, d):
    rows = _with_constant_step(spark, d)
    return long_series(scaling.standardise_steps(rows, scaling.step_moments(rows.where("part = 'train'"))), KEYS)


@query("f20_compose", "ser", """SELECT dataset_name, series_id, pos, round(value, 6) AS value FROM (""" + _steps_of("list_reverse(list_transform(series, lambda x: x * 2))") + ") WHERE pos < 64")
def f20(spark, d):
    double = lambda df: df.withColumn("series", F.transform("series", lambda x: x * 2))
    backwards = lambda df: df.withColumn("series", arrays.reverse_time("series"))
    return long_series(registry.compose(backwards, None, double)(series(spark, d)), KEYS)


# --- functions by name -------------------------------------------------------------------------


@query("s02_cast_by_type", "", """SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, value, event_type FROM events""")
def s02(spark, d):
    digits = F.regexp_extract("props", "([0-9]+)", 1).cast("binary")
    raw = events(spark, d).select(F.col("event_id").cast("string"), digits.alias("k"), F.col("value").cast("string"), "event_type")
    return registry.cast_by_type(raw, {"event_id": "nominal", "k": "nominal", "value": "numeric", "event_type": "string"})


@query("x02_pluggable_casts", "", """SELECT s_suppkey, upper(s_name) AS s_name, round(s_acctbal) AS s_acctbal FROM supplier""")
def x02(spark, d):
    casts = {"name": F.upper, "money": F.round}
    return registry.cast_by_type(
        table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), {"s_name": "name", "s_acctbal": "money"}, casts
    )


@query("x03_pre_step", "ser", "SELECT dataset_name, series_id, round(sqrt(list_inner_product(series, series)) * (1 + label), 6) AS length FROM ser")
def x03(spark, d):
    measure = lambda df: df.select(*KEYS, F.round(F.sqrt(arrays.dot("series", "series")), 6).alias("length"))
    return registry.compose(measure, lambda df: df.withColumn("series", F.transform("series", lambda x: x * (1 + F.col("label")))))(series(spark, d))


@query("x04_loss_by_name", "ser", """, r AS (SELECT dataset_name, series, list_reverse(series) AS back FROM ser),
    s AS (SELECT dataset_name, unnest(series) AS x, unnest(back) AS y FROM r)
    SELECT dataset_name, round(avg(pow(x - y, 2)), 6) AS mse, round(avg(abs(x - y)), 6) AS l1 FROM s GROUP BY 1""")
def x04(spark, d):
    rows = series(spark, d).withColumn("back", arrays.reverse_time("series"))
    return rounded(
        rows.groupBy("dataset_name").agg(registry.loss("mse_loss", "series", "back").alias("mse"), registry.loss("l1_loss", "series", "back").alias("l1")),
        "mse", "l1",
    )
