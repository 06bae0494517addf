"""Exact scores of clusterings and classifications, one row per data set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlab.functions import arrays
from strandlab.operators.joining import join_small
from strandlab.operators.prep import DATASET, SERIES
from strandlab.session import materialise


def contingency(df: DataFrame, label: str = "label", cluster: str = "cluster", keys: Sequence[str] = (DATASET,)) -> DataFrame:
    """Counts of two labelings with their marginals. The rows shuffle as partial counts only."""
    cells = df.groupBy(*keys, label, cluster).agg(F.count(F.lit(1)).alias("n_cell"))
    per = lambda *cols: F.sum("n_cell").over(W.partitionBy(*keys, *cols))
    return cells.select(
        *keys, label, cluster, "n_cell",
        per(label).alias("n_label"), per(cluster).alias("n_cluster"), per().alias("n"),
    )


def external_scores(
    df: DataFrame, label: str = "label", cluster: str = "cluster", keys: Sequence[str] = (DATASET,)
) -> DataFrame:
    """Adjusted Rand index, normalised mutual information and Fowlkes-Mallows index."""
    cells = contingency(df, label, cluster, keys)
    big = lambda c: F.col(c).cast("decimal(19,0)")
    share = F.col("n_cell") / F.col("n")
    pieces = cells.groupBy(*keys).agg(
        F.first("n").cast("double").alias("n"),
        F.sum(big("n_cell") * big("n_cell")).cast("double").alias("cells2"),
        F.sum(big("n_cell") * big("n_label")).cast("double").alias("labels2"),
        F.sum(big("n_cell") * big("n_cluster")).cast("double").alias("clusters2"),
        F.sum(share * F.log(F.col("n_cell") * 1.0 * F.col("n") / (F.col("n_label") * 1.0 * F.col("n_cluster")))).alias("mi"),
        (-F.sum(share * F.log(F.col("n_label") / F.col("n")))).alias("h_label"),
        (-F.sum(share * F.log(F.col("n_cluster") / F.col("n")))).alias("h_cluster"),
        F.max(F.col("n_label") == F.col("n")).alias("one_label"),
        F.max(F.col("n_cluster") == F.col("n")).alias("one_cluster"),
    )
    c = F.col
    tp, fn, fp = c("cells2") - c("n"), c("labels2") - c("cells2"), c("clusters2") - c("cells2")
    tn = c("n") * c("n") - fp - fn - c("cells2")
    pairs = (tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)
    ari = F.when((fn == 0) & (fp == 0), 1.0).otherwise(2.0 * (tp * tn - fn * fp) / pairs)
    nmi = (
        F.when(c("one_label") & c("one_cluster"), 1.0)
        .when(c("one_label") | c("one_cluster"), 0.0)
        .otherwise(F.greatest(c("mi"), F.lit(0.0)) / ((c("h_label") + c("h_cluster")) / 2))
    )
    shared = c("cells2") - c("n")
    fmi = F.when(shared == 0, 0.0).otherwise(
        F.sqrt(shared / (c("labels2") - c("n"))) * F.sqrt(shared / (c("clusters2") - c("n")))
    )
    return pieces.select(*keys, ari.alias("ari"), nmi.alias("nmi"), fmi.alias("fmi"))


def macro_scores(
    df: DataFrame, truth: str = "label", predicted: str = "prediction", keys: Sequence[str] = (DATASET,)
) -> DataFrame:
    """Accuracy and macro precision, recall, F1 over all labels seen on either side; 0 for 0/0."""
    cells = df.groupBy(*keys, truth, predicted).agg(F.count(F.lit(1)).alias("_n"))
    hit = F.when(F.col(truth) == F.col(predicted), F.col("_n")).otherwise(0)
    sides = cells.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col(truth).alias("l"), hit.alias("tp"), F.col("_n").alias("t"), F.lit(0).cast("bigint").alias("p")),
                F.struct(F.col(predicted).alias("l"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("t"), F.col("_n").alias("p")),
            )
        ).alias("_s"),
    )
    per_label = sides.groupBy(*keys, F.col("_s.l").alias("_l")).agg(
        F.sum("_s.tp").alias("tp"), F.sum("_s.t").alias("t"), F.sum("_s.p").alias("p")
    )
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    tp, t, p = F.col("tp"), F.col("t"), F.col("p")
    return per_label.groupBy(*keys).agg(
        (F.sum(tp) / F.sum(t)).alias("accuracy"),
        F.avg(ratio(tp, p)).alias("precision"),
        F.avg(ratio(tp, t)).alias("recall"),
        F.avg(ratio(2 * tp, t + p)).alias("f1"),
    )


def centres(df: DataFrame, keys: Sequence[str] = (DATASET, "cluster"), series: str = SERIES) -> DataFrame:
    """Mean vector and size of every cluster, one JVM aggregate with partial sums before the shuffle."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col(series))))
    return df.groupBy(*keys).agg(mean.alias("centre"), F.count(F.lit(1)).alias("n"))


def cluster_spread(
    df: DataFrame, means: DataFrame, key: str = DATASET, series: str = SERIES, written: bool = False
) -> DataFrame:
    """Per cluster: size, centre, mean distance and summed squared distance to the centre."""
    joined = join_small(df, means.select(key, "cluster", "centre"), [key, "cluster"], numbers=F.size("centre"), written=written)
    d2 = joined.select(key, "cluster", arrays.squared_distance(series, "centre").alias("_d2"))
    spread = d2.groupBy(key, "cluster").agg(F.avg(F.sqrt("_d2")).alias("scatter"), F.sum("_d2").alias("within"))
    return means.join(spread, [key, "cluster"])


def centre_scores(df: DataFrame, key: str = DATASET, series: str = SERIES) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin scores from one pass for centres and one for spreads."""
    # read twice from here on
    means = materialise(centres(df, (key, "cluster"), series), "centres")
    spread = cluster_spread(df, means, key, series, written=True)
    return scores_of_spread(spread, key)


def scores_of_spread(spread: DataFrame, key: str = DATASET) -> DataFrame:
    # as many entries as clusters, which is the number of classes
    packed = spread.groupBy(key).agg(F.collect_list(F.struct("cluster", "n", "centre", "scatter", "within")).alias("cs"))
    n = F.aggregate("cs", F.lit(0).cast("bigint"), lambda s, c: s + c["n"])
    sized = packed.withColumn("n", n).withColumn("k", F.size("cs"))
    zero = F.transform(F.element_at("cs", 1)["centre"], lambda x: F.lit(0.0))
    overall = F.aggregate(
        "cs", zero, lambda s, c: F.zip_with(s, c["centre"], lambda a, b: a + b * c["n"] / F.col("n"))
    )
    from_overall = lambda o: arrays.total(F.transform("cs", lambda c: arrays.squared_distance(c["centre"], o) * c["n"]))
    between = arrays.let(overall, from_overall)
    within = arrays.total(F.transform("cs", lambda c: c["within"]))
    gap = lambda a, b: arrays.distance(a["centre"], b["centre"])
    worst = F.transform(
        "cs",
        lambda a: F.array_max(
            F.transform(
                F.filter("cs", lambda b: b["cluster"] != a["cluster"]),
                lambda b: F.when(gap(a, b) == 0, 0.0).otherwise((a["scatter"] + b["scatter"]) / gap(a, b)),
            )
        ),
    )
    flat = F.forall("cs", lambda c: F.abs(c["scatter"]) <= 1e-8)
    together = F.forall("cs", lambda c: arrays.distance(c["centre"], F.element_at(F.col("cs"), 1)["centre"]) <= 1e-8)
    measured = sized.withColumn("_between", between).withColumn("_within", within)
    ch = F.when(F.col("_within") == 0, 1.0).otherwise(
        F.col("_between") * (F.col("n") - F.col("k")) / (F.col("_within") * (F.col("k") - 1))
    )
    db = F.when(flat | together, 0.0).otherwise(arrays.total(worst) / F.col("k"))
    # both scores need at least two clusters
    return measured.select(
        key,
        F.when(F.col("k") > 1, ch).alias("chs"),
        F.when(F.col("k") > 1, db).alias("dbs"),
    )
