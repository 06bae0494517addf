import numpy as np
import pytest
from conftest import series_rows
from pyspark.sql import functions as F

from strandlab.catalog.representing import WEIGHTS, recurrent_layer
from strandlab.operators import classify, distill, encoders, logs, margin, metrics, neighbours
from strandlab.operators.blocks import dataset_sizes
from strandlab.operators.gram import series_gram
from strandlab.plans import evaluate, extract


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def matrices(rows, layer):
    out = {}
    for no, name, i, w in rows:
        if no == layer:
            out.setdefault(name, {})[i] = w
    return {n: np.array([r[i] for i in sorted(r)]) for n, r in out.items()}


def cell_by_hand(cell, rows, layer, xs):
    """States of one series, step by step, straight from the cell equations."""
    m = matrices(rows, layer)
    n = m["w_hh"].shape[1]
    h, c, out = np.zeros(n), np.zeros(n), []
    for x in xs:
        a, b = m["w_ih"] @ x + m["b_ih"][0], m["w_hh"] @ h + m["b_hh"][0]
        if cell == "lstm":
            i, f, g, o = (a + b).reshape(4, n)
            c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
            h = sigmoid(o) * np.tanh(c)
        elif cell == "gru":
            (ar, az, an), (br, bz, bn) = a.reshape(3, n), b.reshape(3, n)
            r, z = sigmoid(ar + br), sigmoid(az + bz)
            h = (1 - z) * np.tanh(an + r * bn) + z * h
        else:
            h = np.tanh(a + b)
        out.append(h)
    return out


@pytest.mark.parametrize("cell, gates", [("lstm", 4), ("gru", 3), ("rnn", 1), ("unknown", 1)])
def test_recurrent_stack(spark, cell, gates):
    rows = recurrent_layer(0, gates, 1, 3) + recurrent_layer(1, gates, 3, 2)
    x = [[0.5, -1.0, 2.0, 0.1], [0.0, 0.3, -0.7, 1.5]]
    df = series_rows(spark, x, [0, 1])
    got = encoders.encode_recurrent(df, spark.createDataFrame(rows, WEIGHTS), cell.upper(), states=True).orderBy("series_id").collect()
    for r, xs in zip(got, x):
        first = cell_by_hand(cell, rows, 0, [np.array([v]) for v in xs])
        second = cell_by_hand(cell, rows, 1, first)
        assert r["repr"] == pytest.approx(list(second[-1]))
        assert np.array(r["states"]) == pytest.approx(np.array(second))


def test_series_of_different_lengths(spark):
    rows = recurrent_layer(0, 1, 1, 2)
    df = series_rows(spark, [[0.1, 0.2], [0.3, 0.4, 0.5], [0.6, 0.7]], [0, 0, 0])
    got = encoders.encode_recurrent(df, spark.createDataFrame(rows, WEIGHTS), "rnn").collect()
    assert sorted(r["series_id"] for r in got) == [0, 1, 2]
    for r in got:
        assert r["repr"] == pytest.approx(list(cell_by_hand("rnn", rows, 0, [np.array([v]) for v in r["series"]])[-1]))


def test_model_size_is_checked(spark, monkeypatch):
    monkeypatch.setattr(encoders, "MAX_MODEL_NUMBERS", 3)
    with pytest.raises(ValueError):
        encoders.load_weights(spark.createDataFrame(recurrent_layer(0, 1, 1, 2), WEIGHTS))


def test_centre_tap_equals_convolution(spark):
    """A padded, dilated convolution on one position, computed in full."""
    rng = np.random.default_rng(0)
    for kernel, padding, dilation in ((7, 6, 2), (5, 8, 4), (3, 8, 8)):
        w, x = rng.normal(size=(2, 4, kernel)), rng.normal(size=4)
        padded = np.zeros((4, 1 + 2 * padding))
        padded[:, padding] = x
        length = padded.shape[1] - dilation * (kernel - 1)
        full = [sum(w[:, :, t] @ padded[:, p + t * dilation] for t in range(kernel)) for p in range(length)]
        assert length == 1
        table = spark.createDataFrame([(0, "w", i, w[i].reshape(-1).tolist()) for i in range(2)], WEIGHTS)
        taps = encoders.load_weights(encoders.centre_taps(table, [kernel]))[0]["w"]
        assert taps @ x == pytest.approx(full[0])


def sample(spark, n=80, d=8, seed=0):
    rng = np.random.default_rng(seed)
    low = rng.normal(size=(n, 3)) @ rng.normal(size=(3, d))
    x = low + 0.05 * rng.normal(size=(n, d))
    part = F.when(F.col("series_id") % 5 < 3, "train").when(F.col("series_id") % 5 == 3, "valid").otherwise("test")
    return x, series_rows(spark, x, np.arange(n) % 2).withColumn("part", part)


@pytest.mark.parametrize("partitions", [1, 7])
def test_gram(spark, partitions):
    x, df = sample(spark)
    rows = series_gram(df.repartition(partitions)).orderBy("i").collect()
    assert np.array([r["product"] for r in rows]) == pytest.approx(x.T @ x)
    assert {r["n"] for r in rows} == {len(x)}


def test_gram_emits_early(spark, monkeypatch):
    from strandlab.operators import gram

    monkeypatch.setattr(gram, "HELD_BYTES", 10)
    x, df = sample(spark)
    rows = gram.series_gram(df.repartition(3)).orderBy("i").collect()
    assert np.array([r["product"] for r in rows]) == pytest.approx(x.T @ x)


def test_losses_from_gram_equal_losses_from_rows():
    rng = np.random.default_rng(1)
    x, r, w, d = rng.normal(size=(30, 6)), rng.normal(size=(30, 2)), rng.normal(size=(6, 2)), rng.normal(size=(2, 6))
    s, cross, r2 = distill._split_gram(np.hstack([x, r]).T @ np.hstack([x, r]), 30, 6)
    recon, hint = distill._losses(s, cross, r2, w, d)
    assert recon == pytest.approx(((x @ w @ d - x) ** 2).mean())
    assert hint == pytest.approx(((x @ w - r) ** 2).mean())


def test_student_learns_and_reports(spark):
    _, df = sample(spark)
    fits = extract.fit_student(df, extract.make_encoder("principal"), epochs=120, lr=0.01, stopping={"min_delta": 0.0, "patience": 120})
    log = fits.orderBy("epoch").collect()
    assert len(log) == 120 and log[-1]["val_loss"] < log[0]["val_loss"] / 2
    marks = {m: r["epoch"] for r in log for m in r["checkpoint"] or []}
    assert marks["final"] == 119
    assert marks["best"] == min(log, key=lambda r: (r["val_loss"], r["epoch"]))["epoch"]
    coded = extract.extract(df, fits, "student", "principal").collect()
    assert len(coded) == 160 and {len(r["repr"]) for r in coded} == {4}
    assert {(r["checkpoint"], r["part"]) for r in coded} == {(c, p) for c in ("best", "final") for p in ("train", "valid", "test")}


def plain_log(s, cross, r2, valid, w, d, epochs, c_of):
    """Losses of a fit with full matrices, epoch by epoch."""
    t, k = w.shape
    params, m, v, log = [w.copy(), d.copy()], [0 * w, 0 * d], [0 * w, 0 * d], []
    for epoch in range(epochs):
        w, d = params
        c = c_of(epoch)
        losses = []
        for s_, cross_, r2_ in ((s, cross, r2), valid):
            wd = w @ d
            losses.append(((np.trace(s_) - 2 * np.trace(s_ @ wd) + np.trace(wd.T @ s_ @ wd)) / t, (np.trace(w.T @ s_ @ w) - 2 * np.trace(w.T @ cross_) + r2_) / k))
        log.append(((1 - c) * losses[0][0] + c * losses[0][1], losses[1][0]))
        rest = s @ (w @ d) - s
        grads = [2 * (1 - c) / t * (rest @ d.T) + 2 * c / k * (s @ w - cross), 2 * (1 - c) / t * (w.T @ rest)]
        for j, g in enumerate(grads):
            m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g * g
            params[j] = params[j] - 1e-3 * (m[j] / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v[j] / (1 - 0.999 ** (epoch + 1))) + 1e-8)
    return log


@pytest.mark.parametrize("n", [12, 90])
def test_student_log_by_full_matrices(spark, n):
    """With few rows the moments are kept as eigenvectors; the log is that of the full matrices."""
    rng = np.random.default_rng(n)
    x, teacher = rng.normal(size=(n, 40)), rng.normal(size=(n, 5))
    df = series_rows(spark, x, [0] * n).withColumn("part", F.when(F.col("series_id") % 3 == 0, "valid").otherwise("train"))
    vectors = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(teacher)], "series_id bigint, teacher array<double>")
    grams = distill.gram_parts(df.join(vectors, "series_id"), "teacher")
    fits = distill.fit_students(grams, dataset_sizes(df), 60, stopping={"min_delta": 0.0, "patience": 100}).orderBy("epoch").collect()
    part = lambda rows: (x[rows].T @ x[rows] / len(rows), x[rows].T @ teacher[rows] / len(rows), (teacher[rows] ** 2).sum() / len(rows))
    train, valid = (np.array([i for i in range(n) if (i % 3 == 0) == v]) for v in (False, True))
    log = plain_log(*part(train), part(valid), *distill.random_start(40, 5), 60, lambda e: distill._coefficient(e, 60, distill.HINT))
    assert [(r["train_loss"], r["val_loss"]) for r in fits] == [pytest.approx(p, abs=1e-9, rel=1e-9) for p in log]


def test_student_of_long_series(spark):
    """Series of 2844 steps: an epoch costs rows and not steps."""
    x = np.random.default_rng(0).normal(size=(24, 2844)).cumsum(axis=1) / 50
    df = series_rows(spark, x, [0] * 24).withColumn("part", F.when(F.col("series_id") % 4 == 0, "valid").otherwise("train"))
    fits = distill.fit_students(distill.gram_parts(df), dataset_sizes(df), 5, compression=128).orderBy("epoch").collect()
    assert len(fits) == 5 and fits[-1]["train_loss"] < fits[0]["train_loss"]


def test_student_stops_as_the_log_rule_says(spark):
    _, df = sample(spark)
    rule = {"min_delta": 0.002, "patience": 5}
    whole = extract.fit_student(df, None, epochs=200, lr=0.02, stopping={"min_delta": 0.0, "patience": 200})
    cut = extract.fit_student(df, None, epochs=200, lr=0.02, stopping=rule)
    stop = logs.early_stop(whole, **rule, keys=["dataset_name"]).first()["stop_epoch"]
    assert 0 < stop < 199
    assert [r["val_loss"] for r in cut.orderBy("epoch").collect()] == [r["val_loss"] for r in whole.where(F.col("epoch") <= stop).orderBy("epoch").collect()]
    assert cut.where(F.array_contains("checkpoint", "final")).first()["epoch"] == stop


def test_autoencoder_reaches_principal_optimum(spark):
    _, df = sample(spark)
    fits = extract.fit_student(df, None, epochs=3000, lr=0.01, stopping={"min_delta": 0.0, "patience": 3000})
    last = fits.orderBy(F.desc("epoch")).first()["train_loss"]
    rows = df.transform(extract.scaling.make_normaliser()).where("part = 'train'").collect()
    x = np.array([r["series"] for r in rows])
    lost = np.linalg.eigvalsh(x.T @ x / len(x))[:-4].sum() / 8
    assert last == pytest.approx(lost, rel=0.05, abs=1e-5)


def test_principal_axes(spark):
    x, df = sample(spark)
    w = np.array(distill.principal_axes(df).first()["w"])
    _, axes = np.linalg.eigh(x.T @ x)
    top = axes[:, ::-1][:, :4]
    assert w @ w.T == pytest.approx(top @ top.T, abs=1e-8)


def test_unknown_encoder():
    with pytest.raises(ValueError):
        extract.make_encoder("other")


def test_encoders_keep_all_rows(spark):
    _, df = sample(spark)
    for name in ("intervals", "principal"):
        coded = extract.make_encoder(name).fit(df).encode(df)
        assert coded.count() == df.count()


# --- classification ----------------------------------------------------------------------------


def rings(spark, n=240, seed=0):
    """Two rings in the plane: no linear boundary."""
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 2
    angle, radius = rng.uniform(0, 2 * np.pi, n), 1.0 + 2.0 * y + 0.1 * rng.normal(size=n)
    x = np.stack([radius * np.cos(angle), radius * np.sin(angle), np.full(n, 3.0)], axis=1)
    part = F.when(F.col("series_id") % 10 < 5, "train").when(F.col("series_id") % 10 < 7, "valid").otherwise("test")
    return series_rows(spark, x, y, "rings").withColumn("part", part)


def test_grid_classifier_beats_nearest_centre(spark):
    df = rings(spark)
    ours = evaluate.classify_and_evaluate(df).first()
    train = df.where("part <> 'test'").withColumn("cluster", F.col("label"))
    nearest = neighbours.nearest_centre(df.where("part = 'test'"), metrics.centres(train))
    base = metrics.macro_scores(nearest, predicted="cluster").first()
    assert ours["accuracy"] > 0.95 > base["accuracy"] + 0.2
    assert ours["n_classes"] == 2 and ours["n_features"] == 3


def test_fourier_features_approach_the_kernel():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12, 5))
    z = margin.Fourier(1, 20000)(x, 0.2)[:, :-1]
    wanted = np.exp(-0.2 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert z @ z.T == pytest.approx(wanted, abs=0.05)


def test_prepared_fits_on_train_only(spark):
    df = rings(spark)
    ready = classify.prepared(df, df.where("part = 'train'"))
    train = np.array([r["series"] for r in ready.where("part = 'train'").collect()])
    assert train.mean(axis=0) == pytest.approx([0, 0, 0], abs=1e-9)
    assert train.std(axis=0) == pytest.approx([1, 1, 0], abs=1e-9)
    assert ready.first()["gamma"] == pytest.approx(1 / (3 * train.var()))
    test = np.array([r["series"] for r in ready.where("part = 'test'").collect()])
    assert abs(test[:, :2].mean(axis=0)).max() > 1e-6


def test_grid_has_all_values(spark):
    scores = classify.grid_scores(rings(spark)).collect()
    assert sorted(r["c"] for r in scores) == sorted(classify.C_GRID)
    assert all(0 <= r["score"] <= 1 for r in scores)


def test_hinge_machine(spark):
    df = rings(spark)
    ready = classify.prepared(df, df.where("part = 'train'"))
    model = classify.rbf_linear_svc(ready.where("part = 'train'"), c=10.0, max_iter=20)
    got = metrics.macro_scores(classify.svc_predictions(model, ready.where("part = 'test'"))).first()
    assert got["accuracy"] > 0.9


def test_sizes(spark):
    _, df = sample(spark)
    assert tuple(dataset_sizes(df).first()) == ("d", 80, 8)


def test_classification_by_model_and_seed(spark):
    one, two = sample(spark, seed=1)[1], sample(spark, n=60, seed=2)[1]
    both = one.withColumns({"model_name": F.lit("a"), "encoder_name": F.lit("e"), "seed": F.lit(1)}).unionByName(
        two.withColumns({"model_name": F.lit("b"), "encoder_name": F.lit("e"), "seed": F.lit(2)})
    )
    got = {(r["model_name"], r["seed"]): r["accuracy"] for r in evaluate.classify_representations(both).collect()}
    alone = {k: evaluate.classify_and_evaluate(df).first()["accuracy"] for k, df in ((("a", 1), one), (("b", 2), two))}
    assert got == pytest.approx(alone)
