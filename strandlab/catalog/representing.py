"""Queries of batch encoding, losses between representations, and the teacher-to-student fit."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from strandlab.catalog.base import events, parts, query, rounded, series
from strandlab.functions import arrays, registry
from strandlab.operators import distill, encoders
from strandlab.operators.gram import series_gram
from strandlab.operators.blocks import dataset_sizes
from strandlab.plans import extract
from strandlab.session import materialise

KEYS = ["dataset_name", "series_id"]
WEIGHTS = "layer int, name string, row_no int, weights array<double>"


def number(*at: int) -> float:
    """Example weight of a position."""
    return round(math.sin(1.0 + sum((i + 2) * (a + 1) for i, a in enumerate(at))), 4)


def example_layer(no: int, **matrices: tuple[int, int]) -> list[tuple]:
    """Weight rows of one layer from the shapes of its matrices."""
    rows = []
    for n, (name, (height, width)) in enumerate(matrices.items()):
        for i in range(height):
            rows.append((no, name, i, [number(no, n, i, j) for j in range(width)]))
    return rows


def recurrent_layer(no: int, gates: int, inputs: int, units: int) -> list[tuple]:
    return example_layer(no, w_ih=(gates * units, inputs), w_hh=(gates * units, units), b_ih=(1, gates * units), b_hh=(1, gates * units))


def picked(rows: list[tuple], name: str, layer: int = 0) -> list[list[float]]:
    return [r[3] for r in sorted(rows, key=lambda r: r[2]) if r[0] == layer and r[1] == name]


def _gate(rows, i: int, x: str, h: str, layer: int = 0) -> tuple[str, str]:
    """Input side and hidden side of gate ``i`` of a one-unit layer as SQL."""
    one = lambda name: picked(rows, name, layer)
    return (f"({one('w_ih')[i][0]} * {x} + {one('b_ih')[0][i]})", f"({one('w_hh')[i][0]} * {h} + {one('b_hh')[0][i]})")


def sig(x: str) -> str:
    return f"(1 / (1 + exp(-({x}))))"


RNN = recurrent_layer(0, 1, 1, 1)
LSTM = recurrent_layer(0, 4, 1, 1)
GRU = recurrent_layer(0, 3, 1, 1)
RNN_DECODER = [(0, n, i, [v / 2 for v in w]) for _, n, i, w in RNN]
OUTPUT = [(0, "w", 0, [1.25]), (0, "b", 0, [-0.125])]


def _table(spark, rows):
    return spark.createDataFrame(rows, WEIGHTS)


def _tanh_cell(rows, x: str, h: str) -> str:
    a, b = _gate(rows, 0, x, h)
    return f"tanh({a} + {b})"


@query("r01_recurrent_tanh", "ser", f"""SELECT dataset_name, series_id, round(list_reduce(series, lambda h, x: {_tanh_cell(RNN, 'x', 'h')}, 0.0::DOUBLE), 6) AS state FROM ser""")
def r01_tanh(spark, d):
    coded = encoders.encode_recurrent(series(spark, d), _table(spark, RNN), "rnn")
    return coded.select(*KEYS, F.round(F.col("repr")[0], 6).alias("state"))


_L = [" + ".join(_gate(LSTM, i, "s.series[t + 1]", "h")) for i in range(4)]
_C = f"{sig(_L[1])} * c + {sig(_L[0])} * tanh({_L[2]})"


@query("r01_recurrent_lstm", "", f"""WITH RECURSIVE ser AS (SELECT 'ds' || (vec_id % 4) AS dataset_name, vec_id AS series_id, CAST(embedding AS DOUBLE[]) AS series FROM embeddings),
    run AS (SELECT dataset_name, series_id, 0 AS t, 0.0::DOUBLE AS h, 0.0::DOUBLE AS c FROM ser UNION ALL
    SELECT s.dataset_name, s.series_id, t + 1, {sig(_L[3])} * tanh({_C}), {_C} FROM run JOIN ser s ON run.series_id = s.series_id WHERE t < len(s.series))
    SELECT dataset_name, series_id, round(h, 6) AS state FROM run WHERE t = 64""")
def r01_lstm(spark, d):
    coded = encoders.encode_recurrent(series(spark, d), _table(spark, LSTM), "LSTM")
    return coded.select(*KEYS, F.round(F.col("repr")[0], 6).alias("state"))


_G = [_gate(GRU, i, "s.series[t + 1]", "h") for i in range(3)]
_Z = sig(" + ".join(_G[1]))
_N = f"tanh({_G[2][0]} + {sig(' + '.join(_G[0]))} * {_G[2][1]})"


@query("r01_recurrent_gru", "", f"""WITH RECURSIVE ser AS (SELECT 'ds' || (vec_id % 4) AS dataset_name, vec_id AS series_id, CAST(embedding AS DOUBLE[]) AS series FROM embeddings),
    run AS (SELECT dataset_name, series_id, 0 AS t, 0.0::DOUBLE AS h FROM ser UNION ALL
    SELECT s.dataset_name, s.series_id, t + 1, (1 - {_Z}) * {_N} + {_Z} * h FROM run JOIN ser s ON run.series_id = s.series_id WHERE t < len(s.series))
    SELECT dataset_name, series_id, round(h, 6) AS state FROM run WHERE t = 64""")
def r01_gru(spark, d):
    coded = encoders.encode_recurrent(series(spark, d), _table(spark, GRU), "gru")
    return coded.select(*KEYS, F.round(F.col("repr")[0], 6).alias("state"))


@query("r02_recurrent_decoding", "", f"""WITH RECURSIVE ser AS (SELECT 'ds' || (vec_id % 4) AS dataset_name, vec_id AS series_id, CAST(embedding AS DOUBLE[]) AS series FROM embeddings),
    enc AS (SELECT series_id, 0 AS t, 0.0::DOUBLE AS h FROM ser UNION ALL
    SELECT s.series_id, t + 1, {_tanh_cell(RNN, 's.series[t + 1]', 'h')} FROM enc JOIN ser s ON enc.series_id = s.series_id WHERE t < 64),
    back AS (SELECT series_id, list(h ORDER BY t DESC) AS states FROM enc WHERE t > 0 GROUP BY 1),
    dec AS (SELECT series_id, 0 AS t, 0.0::DOUBLE AS h FROM back UNION ALL
    SELECT b.series_id, t + 1, {_tanh_cell(RNN_DECODER, 'b.states[t + 1]', 'h')} FROM dec JOIN back b ON dec.series_id = b.series_id WHERE t < 64)
    SELECT dataset_name, ser.series_id, (t - 1)::BIGINT AS pos, round(1.25 * h - 0.125, 6) AS value FROM dec JOIN ser ON dec.series_id = ser.series_id WHERE t > 0""")
def r02(spark, d):
    out = encoders.reconstruct_recurrent(
        series(spark, d), _table(spark, RNN), _table(spark, RNN_DECODER), _table(spark, OUTPUT), "rnn"
    )
    steps = out.select(*KEYS, F.posexplode("decoded").alias("pos", "value"))
    return rounded(steps.withColumn("pos", F.col("pos").cast("bigint")), "value")


KERNELS = [7, 5, 3]
WIDTHS = [64, 6, 5, 4]


def _conv_rows() -> list[tuple]:
    rows = []
    for no, k in enumerate(KERNELS):
        outs, ins = WIDTHS[no + 1], WIDTHS[no]
        rows += example_layer(no, w=(outs, ins * k), b=(1, outs), mean=(1, outs), var=(1, outs), scale=(1, outs), shift=(1, outs))
    rows = [(no, n, i, [abs(v) + 0.5 for v in w] if n == "var" else w) for no, n, i, w in rows]
    return rows + example_layer(3, w=(3, WIDTHS[3]), b=(1, 3))


CONV = _conv_rows()
HEAD = [(no, n, i, [abs(v) + 0.5 for v in w] if n == "var" else w) for no, n, i, w in
        example_layer(0, w=(4, 3), b=(1, 4), mean=(1, 4), var=(1, 4), scale=(1, 4), shift=(1, 4)) + example_layer(1, w=(2, 4), b=(1, 2))]


def _dense_sql(rows: list[tuple], x: str, layer: int, kernel: int = 1, last: bool = False) -> str:
    """One dense layer as a list expression over the list ``x``."""
    out = []
    get = lambda name: picked(rows, name, layer)
    for i, w in enumerate(get("w")):
        tap = w[kernel // 2 :: kernel]
        value = f"(list_inner_product({x}, {tap}::DOUBLE[]) + {get('b')[0][i]})"
        if not last:
            at = lambda name: get(name)[0][i]
            value = f"greatest(({value} - {at('mean')}) * ({at('scale')} / sqrt({at('var')} + 0.00001::DOUBLE)) + {at('shift')}, 0)"
        out.append(value)
    return "[" + ", ".join(out) + "]"


DENSE = f""", l0 AS (SELECT dataset_name, series_id, {_dense_sql(CONV, 'series', 0, 7)} AS v FROM ser), l1 AS (SELECT dataset_name, series_id, {_dense_sql(CONV, 'v', 1, 5)} AS v FROM l0),
    l2 AS (SELECT dataset_name, series_id, {_dense_sql(CONV, 'v', 2, 3)} AS v FROM l1), l3 AS (SELECT dataset_name, series_id, {_dense_sql(CONV, 'v', 3, 1, True)} AS v FROM l2)"""


@query("r03_conv_encoder", "ser", DENSE + " SELECT dataset_name, series_id, unnest(range(0, 3)) AS pos, unnest(list_transform(v, lambda x: round(x, 6))) AS value FROM l3")
def r03(spark, d):
    coded = encoders.encode_dense(series(spark, d), encoders.centre_taps(_table(spark, CONV), KERNELS))
    return _vector(coded)


@query("r04_projection_head", "ser", DENSE + f""", h0 AS (SELECT dataset_name, series_id, {_dense_sql(HEAD, 'v', 0)} AS v FROM l3),
    h1 AS (SELECT dataset_name, series_id, {_dense_sql(HEAD, 'v', 1, 1, True)} AS v FROM h0)
    SELECT dataset_name, series_id, unnest(range(0, 2)) AS pos, unnest(list_transform(v, lambda x: round(x, 6))) AS value FROM h1""")
def r04(spark, d):
    body = encoders.centre_taps(_table(spark, CONV), KERNELS)
    return _vector(encoders.encode_dense(series(spark, d), body, _table(spark, HEAD)))


def _vector(coded):
    long = coded.select(*KEYS, F.posexplode("repr").alias("pos", "value"))
    return rounded(long.withColumn("pos", F.col("pos").cast("bigint")), "value")


@query("r05_whole_series_pooling", "", """SELECT user_id, dim, round(max(CASE dim WHEN 0 THEN value WHEN 1 THEN -value ELSE sin(value) END), 6) AS value
    FROM events CROSS JOIN (VALUES (0::BIGINT), (1), (2)) v(dim) GROUP BY 1, 2""")
def r05(spark, d):
    steps = events(spark, d).select("user_id", F.array(F.col("value"), -F.col("value"), F.sin("value")).alias("vector"))
    pooled = encoders.pool_series(steps, ["user_id"])
    return rounded(pooled.withColumn("dim", F.col("dim").cast("bigint")), "value")


@query("r09_reconstruction_loss", "parts", """, h AS (SELECT dataset_name, part, unnest(series) AS x, unnest(list_transform(series, lambda x, i: series[greatest(i - 1, 1)])) AS y FROM parts)
    SELECT dataset_name, part, round(avg(pow(x - y, 2)), 6) AS mse, round(avg(abs(x - y)), 6) AS l1 FROM h GROUP BY 1, 2""")
def r09(spark, d):
    """The step before stands in for the reconstruction."""
    before = F.transform("series", lambda x, i: F.get("series", F.greatest(i - 1, F.lit(0))))
    rows = parts(spark, d).withColumn("x_hat", before)
    return rounded(
        rows.groupBy("dataset_name", "part").agg(registry.loss("mse_loss", "series", "x_hat").alias("mse"), registry.loss("l1_loss", "series", "x_hat").alias("l1")),
        "mse", "l1",
    )


@query("r10_hint_loss", "parts", """SELECT dataset_name, part, round(avg((pow(series[63] - series[1], 2) + pow(series[64] - series[2], 2)) / 2), 6) AS hint FROM parts GROUP BY 1, 2""")
def r10(spark, d):
    states = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.array(F.get("series", 2 * i), F.get("series", 2 * i + 1)))
    rows = parts(spark, d).withColumn("states", states).withColumn("teacher", F.slice("series", 1, 2))
    return rounded(rows.groupBy("dataset_name", "part").agg(registry.hint_loss("states", "teacher").alias("hint")), "hint")


# --- teacher to student ------------------------------------------------------------------------


@query("r13_gram_sums", "ser", """SELECT dataset_name, i, j, round(sum(series[i + 1] * series[j + 1]), 6) AS product, count(*) AS n
    FROM ser CROSS JOIN range(0, 64) a(i) CROSS JOIN range(0, 64) b(j) GROUP BY 1, 2, 3""")
def r13_gram(spark, d):
    rows = series_gram(series(spark, d))
    long = rows.select("dataset_name", F.col("i").cast("bigint"), "n", F.posexplode("product").alias("j", "product"))
    return rounded(long.withColumn("j", F.col("j").cast("bigint")), "product")


def _log(fits):
    return fits.select("dataset_name", "epoch", F.round("train_loss", 6).alias("train_loss"), F.round("val_loss", 6).alias("val_loss"))


@query("r13_student_fit")
def r13(spark, d):
    return _log(extract.fit_student(parts(spark, d), extract.make_encoder("principal")))


# first encoder and decoder as cosines, so that the check can repeat an epoch; the teacher is the first four steps
COSINE_START = ", e0 AS (SELECT i, j, cos(0.7 * (i + 1) * (j + 1)) / 8 AS w FROM range(0, 64) a(i) CROSS JOIN range(0, 4) b(j)), f0 AS (SELECT j, i, sin(0.3 * (i + 1) * (j + 1)) / 2 AS d FROM range(0, 64) a(i) CROSS JOIN range(0, 4) b(j))"


def _epoch_sql(e: int) -> str:
    """Losses at epoch ``e`` and, from them, the gradients and the weights of the first step."""
    by = "dataset_name, " if e else ""
    same = lambda left, right: f" AND {left}.dataset_name = {right}.dataset_name" if e else ""
    return f""", sw{e} AS (SELECT g.dataset_name, g.part, g.i, w.j, sum(g.v * w.w) AS v FROM gs g JOIN e{e} w ON g.j = w.i{same('g', 'w')} GROUP BY ALL),
    mm{e} AS (SELECT s.dataset_name, s.part, w.j, s.j AS l, sum(w.w * s.v) AS v FROM sw{e} s JOIN e{e} w ON s.i = w.i{same('s', 'w')} GROUP BY ALL),
    dd{e} AS (SELECT {'a.' + by if e else ''}a.j, b.j AS l, sum(a.d * b.d) AS v FROM f{e} a JOIN f{e} b ON a.i = b.i{same('a', 'b')} GROUP BY ALL),
    recon{e} AS (SELECT t.dataset_name, t.part, (t.v - 2 * x.v + y.v) / 64 AS v FROM (SELECT dataset_name, part, sum(v) AS v FROM gs WHERE i = j GROUP BY ALL) t
    JOIN (SELECT s.dataset_name, s.part, sum(s.v * f.d) AS v FROM sw{e} s JOIN f{e} f ON s.i = f.i AND s.j = f.j{same('s', 'f')} GROUP BY ALL) x USING (dataset_name, part)
    JOIN (SELECT m.dataset_name, m.part, sum(m.v * c.v) AS v FROM mm{e} m JOIN dd{e} c ON m.j = c.j AND m.l = c.l{same('m', 'c')} GROUP BY ALL) y USING (dataset_name, part)),
    gap{e} AS (SELECT t.dataset_name, (t.v - 2 * x.v + y.v) / 4 AS v FROM (SELECT dataset_name, sum(v) AS v FROM mm{e} WHERE part = 'train' AND j = l GROUP BY ALL) t
    JOIN (SELECT g.dataset_name, sum(g.v * w.w) AS v FROM gs g JOIN e{e} w ON g.i = w.i AND g.j = w.j{same('g', 'w')} WHERE part = 'train' AND g.j < 4 GROUP BY ALL) x USING (dataset_name)
    JOIN (SELECT dataset_name, sum(v) AS v FROM gs WHERE part = 'train' AND i = j AND i < 4 GROUP BY ALL) y USING (dataset_name))"""


def _step_sql() -> str:
    """The first step has the length of the rate in every number, whatever the size of the gradient."""
    step = lambda g: f"0.001 * {g} / (abs({g}) + 1e-8)"
    return f""", sd AS (SELECT g.dataset_name, g.i, f.j, sum(g.v * f.d) AS v FROM gs g JOIN f0 f ON g.j = f.i WHERE part = 'train' GROUP BY ALL),
    ge AS (SELECT s.dataset_name, s.i, c.l AS j, 2.0 / 64 * (sum(s.v * c.v) - any_value(sd.v)) AS g FROM sw0 s JOIN dd0 c ON s.j = c.j JOIN sd ON sd.dataset_name = s.dataset_name AND sd.i = s.i AND sd.j = c.l
    WHERE part = 'train' GROUP BY ALL), gf AS (SELECT m.dataset_name, m.j, f.i, 2.0 / 64 * (sum(m.v * f.d) - any_value(s.v)) AS g FROM mm0 m JOIN f0 f ON m.l = f.j
    JOIN sw0 s ON s.dataset_name = m.dataset_name AND s.part = m.part AND s.i = f.i AND s.j = m.j WHERE m.part = 'train' GROUP BY ALL),
    e1 AS (SELECT dataset_name, i, j, w - {step('g')} AS w FROM ge JOIN e0 USING (i, j)), f1 AS (SELECT dataset_name, j, i, d - {step('g')} AS d FROM gf JOIN f0 USING (i, j))"""


@query("r13_first_epochs", "parts", """, gs AS (SELECT dataset_name, part, i, j, sum(series[i + 1] * series[j + 1]) / count(*) AS v FROM parts CROSS JOIN range(0, 64) a(i) CROSS JOIN range(0, 64) b(j)
    WHERE part <> 'test' GROUP BY ALL)""" + COSINE_START + _epoch_sql(0) + _step_sql() + _epoch_sql(1) + """, ep AS (SELECT 0::BIGINT AS epoch, dataset_name, part, v FROM recon0 UNION ALL SELECT 1, dataset_name, part, v FROM recon1),
    gp AS (SELECT 0::BIGINT AS epoch, dataset_name, v, 0.0::DOUBLE AS c FROM gap0 UNION ALL SELECT 1, dataset_name, v, 0.9 * pow(1 / 10.0::DOUBLE, 1.5) FROM gap1)
    SELECT t.dataset_name, epoch, round((1 - c) * t.v + c * gp.v, 6) AS train_loss, round(u.v, 6) AS val_loss
    FROM ep t JOIN ep u USING (epoch, dataset_name) JOIN gp USING (epoch, dataset_name) WHERE t.part = 'train' AND u.part = 'valid'""")
def r13_epochs(spark, d):
    """Losses before and after the first step, from given first weights and a teacher of four steps."""
    def start(t, k):
        i, j = np.arange(1, t + 1)[:, None], np.arange(1, k + 1)[None, :]
        return np.cos(0.7 * i * j) / 8, np.sin(0.3 * i * j).T / 2

    rows = parts(spark, d).withColumn("teacher", F.slice("series", 1, 4))
    fits = distill.fit_students(distill.gram_parts(rows, "teacher"), dataset_sizes(rows), 10, start=start)
    return _log(fits.where("epoch < 2"))


@query("r14_autoencoder_fit")
def r14(spark, d):
    return _log(extract.fit_student(parts(spark, d), None))


@query("r15_teacher_choice")
def r15(spark, d):
    """Teachers side by side: the log of a student of the interval teacher and of a supplied network."""
    supplied = lambda df: encoders.encode_dense(df, encoders.centre_taps(_table(spark, CONV), KERNELS))
    teachers = {"intervals": extract.make_encoder("intervals"), "supplied": extract.make_encoder("supplied", run=supplied)}
    logs = [
        _log(extract.fit_student(parts(spark, d), t)).withColumn("teacher", F.lit(name))
        for name, t in teachers.items()
    ]
    return logs[0].unionByName(logs[1])


@query("r16_extract_representations", "parts", """SELECT dataset_name, checkpoint, part, count(*) AS n, 32::BIGINT AS size, count(DISTINCT label) AS n_classes
    FROM parts CROSS JOIN (VALUES ('best'), ('final')) v(checkpoint) GROUP BY 1, 2, 3""")
def r16(spark, d):
    rows = parts(spark, d)
    fits = materialise(extract.fit_student(rows, extract.make_encoder("principal")), "students")
    coded = extract.extract(rows, fits, "student", "principal")
    return coded.groupBy("dataset_name", "checkpoint", "part").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("repr")).cast("bigint").alias("size"), F.count_distinct("label").alias("n_classes")
    )


CUT = {"ds0": 64, "ds1": 48, "ds2": 32, "ds3": 20}


@query("r17_sizes_per_dataset", "ser", """SELECT dataset_name, count(*) AS n, max(CASE dataset_name WHEN 'ds0' THEN 64 WHEN 'ds1' THEN 48 WHEN 'ds2' THEN 32 ELSE 20 END)::BIGINT AS length,
    max(CASE dataset_name WHEN 'ds0' THEN 32 WHEN 'ds1' THEN 32 WHEN 'ds2' THEN 16 ELSE 8 END)::BIGINT AS size FROM ser GROUP BY 1""")
def r17(spark, d):
    """Series of a different length per data set, encoded in one job."""
    length = F.element_at(F.create_map(*[F.lit(x) for kv in CUT.items() for x in kv]), F.col("dataset_name"))
    rows = parts(spark, d).withColumn("series", F.slice("series", F.lit(1), length))
    coded = extract.make_encoder("principal").fit(rows).encode(rows)
    return coded.groupBy("dataset_name").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("series")).cast("bigint").alias("length"), F.max(F.size("repr")).cast("bigint").alias("size")
    )


@query("x01_encoders_by_name", "parts", """SELECT encoder, dataset_name, part, count(*) AS n, max(CASE encoder WHEN 'intervals' THEN 33 ELSE 32 END)::BIGINT AS size
    FROM parts CROSS JOIN (VALUES ('intervals'), ('principal')) v(encoder) GROUP BY 1, 2, 3""")
def x01(spark, d):
    rows = parts(spark, d)
    coded = [
        extract.make_encoder(name).fit(rows).encode(rows).select(F.lit(name).alias("encoder"), "dataset_name", "part", "repr")
        for name in ("intervals", "principal")
    ]
    both = coded[0].unionByName(coded[1])
    return both.groupBy("encoder", "dataset_name", "part").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("repr")).cast("bigint").alias("size")
    )
