import math

import pytest
from pyspark.sql import functions as F

from strandlab.functions import arrays, keys, registry, scalars


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("m, v, power", [(100, 3, 32), (6, 2, 4), (64, 1, 64), (5, 1, 4), (7, 1, 8), (3, 4, 1), (1, 8, 0.125), (2**29, 1, 2**29)])
def test_closest_power(spark, m, v, power):
    assert one(spark, scalars.closest_power_of_2(F.lit(m), v)) == power


@pytest.mark.parametrize("m, v", [(1, 0), (0, 2), (-4, 2)])
def test_closest_power_fails(spark, m, v):
    with pytest.raises(Exception, match="must"):
        one(spark, scalars.closest_power_of_2(F.lit(m), v))


def test_prefix(spark):
    assert one(spark, scalars.prefixed(F.lit("base"), F.lit("p"))) == "p_base"
    assert one(spark, scalars.prefixed(F.lit("base"), F.lit(""))) == "base"
    assert one(spark, scalars.prefixed(F.lit("base"), F.lit(None).cast("string"))) == "base"
    assert one(spark, scalars.prefixed(F.lit("base"), None)) == "base"


def test_coefficient(spark):
    c = scalars.hint_coefficient(F.lit(250), 500, final=0.9, rate=1.5)
    assert one(spark, c) == pytest.approx(0.9 * 0.5**1.5)
    assert one(spark, scalars.hint_coefficient(F.lit(3), 500, final=0.9, start_epoch=5)) == 0.0
    assert one(spark, scalars.hint_coefficient(F.lit(3), 500, mode="valid", valid_value=0.25)) == 0.25
    with pytest.raises(ValueError):
        scalars.hint_coefficient(F.lit(3), 500, mode="other")


def test_two_decimals(spark):
    for value in (1.005, 0.125, 2.675, -3.14159):
        assert one(spark, scalars.two_decimals(F.lit(value))) == f"{value:.2f}"


def test_array_functions(spark):
    a = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, arrays.l2_normalise(a)) == [0.6, 0.8]
    assert one(spark, arrays.l2_normalise(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    logs = one(spark, arrays.log_softmax(a))
    assert sum(math.exp(v) for v in logs) == pytest.approx(1.0)
    assert logs[1] - logs[0] == pytest.approx(1.0)
    assert one(spark, arrays.distance(a, F.array(F.lit(0.0), F.lit(0.0)))) == 5.0
    assert one(spark, arrays.impute(F.array(F.lit(1.0), F.lit(float("nan")), F.lit(None).cast("double")))) == [1.0, 0.0, 0.0]
    nested = F.array(F.array(F.array(F.lit(1), F.lit(2))), F.array(F.array(F.lit(3))))
    assert one(spark, arrays.flatten_nested(nested, 3)) == [1, 2, 3]
    assert one(spark, arrays.expand_steps(a)) == [[3.0], [4.0]]
    assert one(spark, arrays.reverse_time(a)) == [4.0, 3.0]
    assert one(spark, arrays.last_state(a)) == 4.0
    with pytest.raises(ValueError):
        arrays.as_panel(a, "string")
    with pytest.raises(ValueError):
        arrays.cast_series(a, "text")


def test_missing(spark):
    assert one(spark, arrays.has_missing(F.array(F.lit(1.0), F.lit(float("nan")))))
    assert one(spark, arrays.has_missing(F.array(F.lit(1.0), F.lit(None).cast("double"))))
    assert one(spark, arrays.has_missing(F.lit(None).cast("array<double>")))
    assert not one(spark, arrays.has_missing(F.array(F.lit(1.0))))


def test_uniform_is_uniform(spark):
    u = spark.range(4000).select(keys.unit_uniform(keys.order_key(1, "id")).alias("u"))
    row = u.agg(F.min("u").alias("a"), F.max("u").alias("b"), F.avg("u").alias("m"), F.var_pop("u").alias("v")).first()
    assert 0 < row["a"] and row["b"] < 1
    assert row["m"] == pytest.approx(0.5, abs=0.02)
    assert row["v"] == pytest.approx(1 / 12, abs=0.005)


def test_casts_and_losses(spark):
    df = spark.createDataFrame([("7", "1.5", "z")], "a string, b string, c string")
    out = registry.cast_by_type(df, {"a": "nominal", "b": "numeric", "c": "other"})
    assert out.dtypes == [("a", "bigint"), ("b", "double"), ("c", "string")]
    with pytest.raises(Exception):
        registry.cast_by_type(spark.createDataFrame([("x1",)], "a string"), {"a": "nominal"}).collect()
    with pytest.raises(ValueError):
        registry.loss("other", "a", "b")


def test_compose_right_to_left(spark):
    add = lambda df: df.withColumn("id", F.col("id") + 1)
    double = lambda df: df.withColumn("id", F.col("id") * 2)
    rows = registry.compose(add, None, double)(spark.range(3)).collect()
    assert sorted(r["id"] for r in rows) == [1, 3, 5]
