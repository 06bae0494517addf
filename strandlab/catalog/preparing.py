"""Queries of row preparation, splits, set operations and joins of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlab.catalog.base import cells, events, long_series, parts, query, series, table
from strandlab.operators import batches, prep, split

SPLIT_NAMES = {"a": ("train", "test"), "b": ("train", "valid")}


def split_ctes(tag: str, source: str, share: float) -> str:
    """Check CTEs of the exact split of ``source`` into ``{tag}`` with column ``part``."""
    big, small = SPLIT_NAMES[tag]
    return f""", {tag}1 AS (SELECT dataset_name, label, count(*) AS n_class FROM {source} GROUP BY 1, 2),
    {tag}2 AS (SELECT *, CAST(sum(n_class) OVER (PARTITION BY dataset_name) AS BIGINT) AS n FROM {tag}1),
    {tag}3 AS (SELECT *, n - CAST(ceil({share}::DOUBLE * n) AS BIGINT) AS n_train FROM {tag}2),
    {tag}4 AS (SELECT *, (n_class * n_train) // n AS base, (n_class * n_train) % n AS rest FROM {tag}3),
    {tag}5 AS (SELECT *, n_train - sum(base) OVER (PARTITION BY dataset_name) AS missing,
        row_number() OVER (PARTITION BY dataset_name ORDER BY rest DESC, label) AS place FROM {tag}4),
    {tag}6 AS (SELECT dataset_name, label, base + CASE WHEN place <= missing THEN 1 ELSE 0 END AS quota FROM {tag}5),
    {tag}7 AS (SELECT s.*, q.quota, row_number() OVER (PARTITION BY s.dataset_name, s.label ORDER BY md5('42-' || s.series_id)) AS rn
        FROM {source} s JOIN {tag}6 q ON s.dataset_name = q.dataset_name AND s.label = q.label),
    {tag} AS (SELECT dataset_name, series_id, label, CASE WHEN rn <= quota THEN '{big}' ELSE '{small}' END AS part FROM {tag}7)"""


HALVES = split_ctes("a", "ser", 0.5)
PLAN = HALVES + """, kept AS (SELECT dataset_name, series_id, label FROM a WHERE part = 'train'
    QUALIFY count(*) OVER (PARTITION BY dataset_name, label) > 1)""" + split_ctes("b", "kept", 0.35)


@query("p01_features", "steps", "SELECT dataset_name, series_id, pos, round(value, 6) AS value FROM steps")
def p01(spark, d):
    return long_series(prep.features(series(spark, d)), ["dataset_name", "series_id"])


@query("p01_targets", "ser", "SELECT dataset_name, series_id, label FROM ser")
def p01_targets(spark, d):
    return prep.targets(series(spark, d))


@query("p02_drop_unnamed", "", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def p02(spark, d):
    written = table(spark, d, "supplier").withColumnRenamed("s_nationkey", "Unnamed: 0")
    return prep.drop_unnamed(written)


@query("p03_skip_datasets", "", """SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey, c_acctbal FROM customer
    WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def p03(spark, d):
    skipped = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    kept = prep.skip_datasets(table(spark, d, "customer"), skipped, "c_nationkey")
    return kept.select("c_custkey", F.col("c_nationkey").cast("bigint"), "c_acctbal")


@query("p03_keep_datasets", "", """SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey, c_acctbal FROM customer
    WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def p03_keep(spark, d):
    wanted = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    kept = prep.keep_datasets(table(spark, d, "customer"), wanted, "c_nationkey")
    return kept.select("c_custkey", F.col("c_nationkey").cast("bigint"), "c_acctbal")


@query("p04_test_part", "parts", "SELECT dataset_name, series_id, label FROM parts WHERE part = 'test'")
def p04(spark, d):
    return prep.clustering_parts(parts(spark, d), "raw").select("dataset_name", "series_id", "label")


# every 97th series loses a number, so the data sets that hold one are rejected
HOLED = """, holed AS (SELECT dataset_name || '-' || label AS dataset_name, series_id, label, series_id % 97 = 0 AS bad FROM ser)"""


def _holed(spark, d):
    rows = series(spark, d).withColumn("dataset_name", F.concat_ws("-", "dataset_name", "label"))
    broken = F.transform("series", lambda x, i: F.when((F.col("series_id") % 97 == 0) & (i == 3), F.lit(float("nan"))).otherwise(x))
    return rows.withColumn("series", broken)


@query("p05_kept_datasets", "ser", HOLED + """ SELECT dataset_name, series_id, label FROM holed
    WHERE dataset_name NOT IN (SELECT dataset_name FROM holed WHERE bad)""")
def p05(spark, d):
    kept, _ = prep.reject_missing(_holed(spark, d))
    return kept.select("dataset_name", "series_id", "label")


@query("p05_rejected_datasets", "ser", HOLED + """ SELECT dataset_name, count(*) FILTER (bad) AS n_missing, count(*) AS n_rows
    FROM holed GROUP BY 1 HAVING count(*) FILTER (bad) > 0""")
def p05_report(spark, d):
    return prep.reject_missing(_holed(spark, d))[1]


@query("p06_drop_singletons", "", """SELECT o_custkey, o_orderpriority, o_orderkey FROM orders
    QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderpriority) > 1""")
def p06(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey")
    return prep.drop_singleton_classes(rows, ["o_custkey", "o_orderpriority"], "o_orderkey")


@query("p07_stratified_split", "ser", HALVES + " SELECT dataset_name, series_id, label, part FROM a")
def p07(spark, d):
    return split.stratified_split(series(spark, d), 0.5).select("dataset_name", "series_id", "label", "part")


@query("p07_split_of_customers", "", "WITH rows_in AS (SELECT c_mktsegment AS dataset_name, c_custkey AS series_id, c_nationkey AS label FROM customer)"
       + split_ctes("b", "rows_in", 0.35) + " SELECT dataset_name, series_id, label::BIGINT AS label, part FROM b")
def p07_customers(spark, d):
    rows = table(spark, d, "customer").select(
        F.col("c_mktsegment").alias("dataset_name"), F.col("c_custkey").alias("series_id"), F.col("c_nationkey").cast("bigint").alias("label")
    )
    return split.stratified_split(rows, 0.35, ("train", "valid"))


@query("p08_split_plan", "ser", PLAN + """ SELECT * FROM b UNION ALL SELECT * FROM a WHERE part = 'test'""")
def p08(spark, d):
    return split.split_parts(series(spark, d)).select("dataset_name", "series_id", "label", "part")


@query("p08_split_as_defined", "parts", """, kept AS (SELECT dataset_name, series_id, label FROM parts WHERE part <> 'test'
    QUALIFY count(*) OVER (PARTITION BY dataset_name, label) > 1)""" + split_ctes("b", "kept", 0.35)
       + " SELECT * FROM b UNION ALL SELECT dataset_name, series_id, label, part FROM parts WHERE part = 'test'")
def p08_defined(spark, d):
    given = parts(spark, d).withColumn("part", F.when(F.col("part") == "test", "test").otherwise("train"))
    return split.split_parts(given, strategy="as_defined").select("dataset_name", "series_id", "label", "part")


@query("p09_without_labels", "ser", "SELECT dataset_name, series_id, len(series) AS n_steps FROM ser")
def p09(spark, d):
    rows = prep.with_mode(series(spark, d), "without_labels")
    return rows.select(*[c for c in rows.columns if c != "series"], F.size("series").cast("bigint").alias("n_steps"))


@query("p10_display_names", "cells", """SELECT dataset_name, CASE algorithm WHEN 'A1' THEN 'Raw data' WHEN 'A2' THEN 'Teacher'
    WHEN 'A3' THEN 'Student' ELSE algorithm END AS model, run, value FROM cells""")
def p10(spark, d):
    names = {"A1": "Raw data", "A2": "Teacher", "A3": "Student"}
    return cells(spark, d).select("dataset_name", prep.rename_values("algorithm", names).alias("model"), "run", "value")


@query("p11_model_key", "", """SELECT p_partkey, p_brand || ' - ' || p_type AS model_encoder_pair FROM part""")
def p11(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("model_name"), F.col("p_type").alias("encoder_name"))
    return rows.select("p_partkey", prep.model_key().alias("model_encoder_pair"))


@query("p12_needed_columns", "", "SELECT l_suppkey, l_extendedprice FROM lineitem")
def p12(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice")


@query("p13_first_source_wins", "", """SELECT user_id, event_type, event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1""")
def p13(spark, d):
    rows = events(spark, d).select("user_id", "event_type", "event_id", "value")
    return prep.first_source_wins(rows, ["user_id", "event_type"], "event_id")


@query("p14_seeded_shuffle", "ser", """SELECT dataset_name, series_id, e AS epoch,
    row_number() OVER (PARTITION BY dataset_name, e ORDER BY md5('42-' || e || '-' || series_id)) AS place
    FROM ser CROSS JOIN (VALUES (0::BIGINT), (1)) v(e)""")
def p14(spark, d):
    rows = series(spark, d).select("dataset_name", "series_id")
    by_epoch = [batches.shuffled(rows, 42, e).withColumn("epoch", F.lit(e).cast("bigint")) for e in (0, 1)]
    return prep.union_parts(*by_epoch)


@query("u01_merge_train_test", "parts", "SELECT dataset_name, series_id, label FROM parts WHERE part <> 'valid'")
def u01(spark, d):
    rows = parts(spark, d).select("dataset_name", "series_id", "label", "part")
    return prep.union_parts(rows.where("part = 'train'"), rows.where("part = 'test'")).drop("part")


@query("u02_all_parts", "parts", "SELECT dataset_name, series_id, label, part FROM parts")
def u02(spark, d):
    rows = parts(spark, d).select("dataset_name", "series_id", "label", "part")
    return prep.union_parts(*[rows.where(F.col("part") == p) for p in ("train", "test", "valid")])


@query("u03_fold_markers", "parts", """SELECT dataset_name, series_id, label, (CASE part WHEN 'train' THEN -1 ELSE 0 END)::BIGINT AS fold
    FROM parts WHERE part <> 'test'""")
def u03(spark, d):
    rows = parts(spark, d).select("dataset_name", "series_id", "label", "part")
    folds = prep.predefined_folds(rows.where("part = 'train'"), rows.where("part = 'valid'"))
    return folds.select("dataset_name", "series_id", "label", F.col("fold").cast("bigint"))


@query("u04_append_runs", "", """SELECT l_suppkey AS dataset_id, 'returned' AS source, l_discount AS ari, NULL::DOUBLE AS nmi FROM lineitem WHERE l_returnflag = 'R'
    UNION ALL SELECT l_suppkey, 'other', NULL, l_tax FROM lineitem WHERE l_returnflag <> 'R'""")
def u04(spark, d):
    rows = table(spark, d, "lineitem")
    first = rows.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("dataset_id"), F.lit("returned").alias("source"), F.col("l_discount").alias("ari"))
    second = rows.where("l_returnflag <> 'R'").select(F.col("l_suppkey").alias("dataset_id"), F.lit("other").alias("source"), F.col("l_tax").alias("nmi"))
    return prep.union_results(first, second)


@query("u05_name_difference", "", """SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def u05(spark, d):
    return prep.name_difference(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("u06_distinct_values", "", "SELECT DISTINCT p_brand, p_type FROM part")
def u06(spark, d):
    return table(spark, d, "part").select("p_brand", "p_type").distinct()


@query("j01_match_parts", "parts", """SELECT dataset_name, count(*) FILTER (part = 'train') AS n_train, count(*) FILTER (part = 'valid') AS n_valid,
    count(*) FILTER (part = 'test') AS n_test FROM parts GROUP BY 1""")
def j01(spark, d):
    return prep.join_parts(parts(spark, d))


@query("j02_attach_labels", "steps", "SELECT dataset_name, series_id, label, pos, round(value, 6) AS value FROM steps")
def j02(spark, d):
    rows = series(spark, d)
    return long_series(prep.attach_labels(rows.drop("label"), rows), ["dataset_name", "series_id", "label"])
