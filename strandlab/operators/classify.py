"""Classification of many data sets over a grid of C.

Spark has no kernel machine, so the RBF kernel is replaced by random Fourier features:

* ``grid_classify`` fits one-versus-rest margin machines (squared hinge) for all data sets and values of C, see ``margin``;
  ``least_squares`` machines can be chosen instead, whose Gram matrix one pass gives for all values of C.
* ``rbf_linear_svc`` fits Spark's hinge-loss ``LinearSVC`` one-versus-rest on one data set.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.functions import arrays
from strandlab.operators import margin, scaling
from strandlab.operators.blocks import apply_with_parameters, dataset_sizes, matrix
from strandlab.operators.gram import gram_rows, whole
from strandlab.operators.joining import join_small
from strandlab.operators.logs import best_setting
from strandlab.operators.prep import DATASET, LABEL, PART, SERIES, SERIES_ID
from strandlab.session import materialise

# The grid of the regularisation parameter.
C_GRID = (0.0001, 0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0)
CLASSIFIER_SEED = 42
N_FEATURES = 256


def prepared(df: DataFrame, fit_rows: DataFrame, key: str = DATASET) -> DataFrame:
    """Impute, then standardise with the moments of ``fit_rows``; adds ``gamma`` of the scaled fit rows.

    After scaling the variance of all numbers is the share of steps that are
    not constant, so ``1 / (d * variance)`` is one over their number.
    """
    filled = fit_rows.withColumn(SERIES, arrays.impute(SERIES))
    moments = scaling.step_moments(filled, (key,))
    varying = F.size(F.filter("_fit", lambda m: m["std"] > 0))
    gamma = F.lit(1.0) / F.greatest(varying, F.lit(1))
    rows = df.withColumn(SERIES, arrays.impute(SERIES))
    return scaling.standardise_steps(rows, moments, (key,), gamma=gamma)


def least_squares(rows: DataFrame, labelled: DataFrame, grid: DataFrame, features, key: str = DATASET) -> DataFrame:
    """One least-squares weight matrix per data set and value of C. ``grid`` lists the values of C per data set.

    ``labelled`` are the same rows before scaling, which is all the list of classes needs.
    """
    labels = labelled.groupBy(key, LABEL).agg(F.lit(1).alias("_one")).groupBy(key).agg(
        F.sort_array(F.collect_list(LABEL)).alias("classes")
    )
    marked = join_small(rows, labels, key, numbers=F.size("classes"))

    def factors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        z = features(matrix(table), table["gamma"][0].as_py())
        classes = np.array(table["classes"][0].as_py())
        signs = np.where(table[LABEL].to_numpy()[:, None] == classes[None, :], 1.0, -1.0)
        return z, np.hstack([z, signs])

    grams = gram_rows(marked, (key,), factors, [key, SERIES, LABEL, "gamma", "classes"])
    settings = labels.join(grid.groupBy(key).agg(F.sort_array(F.collect_list("c")).alias("cs")), key)
    ready = grams.join(settings, key)
    schema = f"{key} string, c double, classes array<bigint>, weights array<array<double>>"

    def solve(keys: tuple, table: pa.Table) -> pa.Table:
        both = whole(table)
        size = len(both)
        gram, target = both[:, :size], both[:, size:]
        penalty = np.eye(size)
        penalty[-1, -1] = 0.0  # the bias is free
        cs, classes = table["cs"][0].as_py(), table["classes"][0].as_py()
        fits = [np.linalg.solve(gram + penalty / c, target).T.tolist() for c in cs]
        return pa.table({
            key: pa.array([keys[0].as_py()] * len(cs), pa.string()),
            "c": pa.array(cs, pa.float64()),
            "classes": pa.array([classes] * len(cs), pa.list_(pa.int64())),
            "weights": pa.array(fits, pa.list_(pa.list_(pa.float64()))),
        })

    # one group holds a row per feature, whatever the number of series
    return ready.groupBy(key).applyInArrow(solve, schema)


def predict(rows: DataFrame, sizes: DataFrame, machines: DataFrame, features, key: str = DATASET) -> DataFrame:
    """Predicted label of every row for every machine of its data set."""
    schema = f"{key} string, {SERIES_ID} bigint, {LABEL} bigint, c double, prediction bigint"

    def run(name: str, table: pa.Table, fitted: pa.Table) -> pa.Table:
        cols: dict[str, list] = {SERIES_ID: [], LABEL: [], "c": [], "prediction": []}
        if table.num_rows and fitted.num_rows:
            z = features(matrix(table), table["gamma"][0].as_py())
            for m in fitted.to_pylist():
                classes = np.array(m["classes"], dtype="int64")
                cols[SERIES_ID].append(table[SERIES_ID].to_numpy())
                cols[LABEL].append(table[LABEL].to_numpy())
                cols["c"].append(np.full(len(z), m["c"]))
                cols["prediction"].append(classes[(z @ np.array(m["weights"]).T).argmax(axis=1)])
        types = {SERIES_ID: "int64", LABEL: "int64", "c": "float64", "prediction": "int64"}
        done = {k: np.concatenate(v) if v else np.array([], types[k]) for k, v in cols.items()}
        names = pa.array([name] * len(done["c"]), pa.string())
        return pa.table({key: names, **{k: pa.array(v) for k, v in done.items()}})

    columns = [key, SERIES_ID, LABEL, SERIES, "gamma"]
    # a row becomes its features inside the block, so blocks are sized by the wider of the two
    wide = sizes.withColumn("d", F.greatest(F.col("d"), features.width(F.col("d")).cast("bigint")))
    return apply_with_parameters(rows.select(*columns), machines.select(key, "c", "classes", "weights"), run, schema, wide, key=key)


MACHINES = {"margin": margin.fit_margin, "least_squares": least_squares}


def grid_scores(parts: DataFrame, seed: int = CLASSIFIER_SEED, grid=C_GRID, features=None, machine: str = "margin", **settings) -> DataFrame:
    """Accuracy on the validation part of every data set and value of C, fitted on the train part only.

    ``features`` are Fourier features of ``seed`` unless given; ``settings`` go to the machine.
    """
    features = margin.Fourier(seed) if features is None else features
    train = parts.where(F.col(PART) == "train")
    ready = prepared(parts.where(F.col(PART).isin("train", "valid")), train)
    values = parts.select(DATASET).distinct().withColumn("c", F.explode(F.array(*[F.lit(float(c)) for c in grid])))
    machines = MACHINES[machine](ready.where(F.col(PART) == "train"), train, values, features, **settings)
    valid = parts.where(F.col(PART) == "valid")
    predicted = predict(ready.where(F.col(PART) == "valid"), dataset_sizes(valid), machines, features)
    hit = (F.col(LABEL) == F.col("prediction")).cast("double")
    return predicted.groupBy(DATASET, "c").agg(F.avg(hit).alias("score"))


def grid_classify(parts: DataFrame, seed: int = CLASSIFIER_SEED, grid=C_GRID, features=None, machine: str = "margin", **settings) -> DataFrame:
    """Predictions for the test part: C chosen on the validation part, then refitted on train and validation."""
    features = margin.Fourier(seed) if features is None else features
    scores = grid_scores(parts, seed, grid, features, machine, **settings)
    chosen = best_setting(scores, [DATASET], "c", "score").select(DATASET, "c")
    fit_rows = parts.where(F.col(PART).isin("train", "valid"))
    ready = prepared(parts, fit_rows)
    machines = MACHINES[machine](ready.where(F.col(PART) != "test"), fit_rows, materialise(chosen, "chosen-c"), features, **settings)
    test = parts.where(F.col(PART) == "test")
    return predict(ready.where(F.col(PART) == "test"), dataset_sizes(test), machines, features)


def fourier_column(seed: int = CLASSIFIER_SEED, n_features: int = N_FEATURES):
    """Column function: random Fourier features of a scaled series and its gamma."""

    @F.pandas_udf("array<double>")
    def features(series: pd.Series, gamma: pd.Series) -> pd.Series:
        if series.empty:
            return pd.Series([], dtype="object")
        out = np.empty(len(series), dtype="object")
        fourier = margin.Fourier(seed, n_features)
        for (length, g), at in pd.Series(range(len(series))).groupby([series.map(len).values, gamma.values]):
            x = np.stack(series.iloc[at].to_numpy())
            for place, row in zip(at, fourier(x, g)[:, :-1]):
                out[place] = row
        return pd.Series(out)

    return features


def rbf_linear_svc(
    train: DataFrame, c: float = 1.0, seed: int = CLASSIFIER_SEED, n_features: int = N_FEATURES, max_iter: int = 100
) -> PipelineModel:
    """Hinge-loss one-versus-rest machine on Fourier features of prepared rows of one data set."""
    features = array_to_vector(fourier_column(seed, n_features)(SERIES, F.col("gamma")))
    # every class fits on the same features, so they are written once
    rows = materialise(train.select(LABEL, features.alias("features")), "fourier")
    n = rows.count()
    svc = LinearSVC(maxIter=max_iter, regParam=1.0 / (n * c), standardization=False)
    index = StringIndexer(inputCol=LABEL, outputCol="label_index", stringOrderType="alphabetAsc")
    machine = OneVsRest(classifier=svc, labelCol="label_index", featuresCol="features", predictionCol="index", parallelism=8)
    return Pipeline(stages=[index, machine]).fit(rows)


def svc_predictions(model: PipelineModel, rows: DataFrame, seed: int = CLASSIFIER_SEED, n_features: int = N_FEATURES) -> DataFrame:
    """Predicted labels; the index of a label is turned back into the label."""
    ready = rows.withColumn("features", array_to_vector(fourier_column(seed, n_features)(SERIES, F.col("gamma"))))
    names = model.stages[0].labels
    back = F.array(*[F.lit(int(v)) for v in names])
    machine = model.stages[1]
    return machine.transform(ready).withColumn("prediction", F.get(back, F.col("index").cast("int")).cast("bigint"))
