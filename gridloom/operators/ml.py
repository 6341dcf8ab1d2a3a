"""Classification on tables: Spark ML estimators, seeded splits, and small assignments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import _written
from .spectral import array, dot
from .stats import covariance


def featured(df: DataFrame, spectrum: str = "spectrum") -> DataFrame:
    return df.withColumn("features", array_to_vector(spectrum))


def hashed(key, seed: int):
    """Arithmetic order of integer keys that both engines can state."""
    return (key * 2654435761 + seed) % 1000003


def kmeans(df: DataFrame, k: int = 3, sample: int = 100_000, seed: int = 42) -> DataFrame:
    """Classes 1..k by k-means fitted on at most ``sample`` rows (a documented bound) in a seeded order."""
    px = featured(df)
    fit = px.orderBy(F.xxhash64("y", "x", F.lit(seed)), "y", "x").limit(sample)
    return KMeans(k=k, seed=seed).fit(fit).transform(px).withColumn("class", F.col("prediction") + 1).drop("features", "prediction")


def classifier(kind: str, bands: int = 0, classes: int = 0, seed: int = 42):
    """svm (linear, one against the rest), forest, bayes (independent normal attributes) or mlp."""
    if kind == "bayes":
        return NaiveBayes(modelType="gaussian", labelCol="label")
    if kind == "svm":
        return OneVsRest(classifier=LinearSVC(maxIter=30, regParam=0.01), labelCol="label")
    if kind == "forest":
        return RandomForestClassifier(numTrees=30, seed=seed, labelCol="label")
    return MultilayerPerceptronClassifier(layers=[bands, 16, classes], seed=seed, maxIter=60, labelCol="label")


def train_table(df: DataFrame, attributes: list[str], label: str, kind: str = "forest") -> PipelineModel:
    """A model from an attribute table: rows without a value in any attribute or the label are left out."""
    index = StringIndexer(inputCol="_label", outputCol="label", stringOrderType="alphabetAsc")
    rows = df.dropna(subset=[*attributes, label]).select(*attributes, F.col(label).cast("string").alias("_label"))
    indexed = index.fit(rows)
    features = VectorAssembler(inputCols=attributes, outputCol="features")
    model = classifier(kind, len(attributes), len(indexed.labels)).fit(features.transform(indexed.transform(rows)))
    return PipelineModel(stages=[features, model, IndexToString(inputCol="prediction", outputCol="_class", labels=indexed.labels)])


def save_model(model: PipelineModel, path: str) -> None:
    """``path`` is in a folder that driver and executors share."""
    model.write().overwrite().save(path)


def apply_model(df: DataFrame, path: str, attributes: list[str]) -> DataFrame:
    """``df`` with ``class`` (a string) by a saved model, without training; rows without a value in any attribute get none."""
    slim = df.select("*", *[F.coalesce(F.nanvl(F.col(a).cast("double"), F.lit(None).cast("double")), F.lit(0.0)).alias(f"_{a}") for a in attributes])
    known = F.lit(True)
    for a in attributes:
        known = known & F.col(a).isNotNull() & ~F.isnan(F.col(a).cast("double"))
    kept = slim.select(F.struct(*[F.col(c) for c in df.columns]).alias("_row"), known.alias("_known"), *[F.col(f"_{a}").alias(a) for a in attributes])
    return PipelineModel.load(path).transform(kept).select("_row.*", F.when(F.col("_known"), F.col("_class")).alias("class"))


def normal_bayes(train: DataFrame, size: int, label: str = "label", ridge: float = 1e-6) -> Callable[[DataFrame], DataFrame]:
    """Gaussian per class with full covariance: one aggregate, then column log-densities.  Returns the predictor."""
    rows = sorted(covariance(train, "spectrum", size, [label]).collect(), key=lambda r: r[label])  # a row a class
    n = sum(r["n"] for r in rows)
    terms = []
    for r in rows:
        cov = np.array(r["cov"]).reshape(size, size) + ridge * np.eye(size)
        c = F.zip_with("spectrum", array(r["mean"]), lambda x, m: x - m)
        inv = np.linalg.inv(cov)
        quad = sum([c[i] * dot(c, array(inv[i])) for i in range(1, size)], c[0] * dot(c, array(inv[0])))
        terms.append((r[label], F.lit(float(np.log(r["n"] / n) - np.linalg.slogdet(cov)[1] / 2)) - quad / 2))

    def predict(df: DataFrame) -> DataFrame:
        logs = df.withColumns({f"_l{k}": t for k, (_, t) in enumerate(terms)})
        top = F.greatest(*[F.struct(F.col(f"_l{k}").alias("l"), F.lit(-k).alias("o"), F.lit(c).alias("class")) for k, (c, _) in enumerate(terms)])
        total = sum([F.exp(F.col(f"_l{k}") - top["l"]) for k in range(1, len(terms))], F.exp(F.col("_l0") - top["l"]))
        return logs.withColumns({"class": top["class"], "probability": 1 / total}).drop(*[f"_l{k}" for k in range(len(terms))])

    return predict


def scaled(df: DataFrame, cols: list[str], how: str = "zscore") -> DataFrame:
    """z-scores (least deviation 1e-6) or min-max to [0, 1]."""
    if how == "zscore":
        s = df.agg(*[f(c).alias(f"_{n}{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))])
        out = {c: (F.col(c) - F.col(f"_m{c}")) / F.greatest(F.col(f"_s{c}"), F.lit(1e-6)) for c in cols}
    else:
        s = df.agg(*[f(c).alias(f"_{n}{c}") for c in cols for n, f in (("m", F.min), ("s", F.max))])
        out = {c: F.coalesce((F.col(c) - F.col(f"_m{c}")) / F.nullif(F.col(f"_s{c}") - F.col(f"_m{c}"), F.lit(0.0)), F.lit(0.0)) for c in cols}
    return df.crossJoin(F.broadcast(s)).withColumns(out).drop(*s.columns)


def ranked(df: DataFrame, by: str, order: list) -> DataFrame:
    """``df`` with ``_rank``, the row's place from 0 among those of its ``by``, and ``_many``, their number.

    One sort of all rows by ranges, and the counts of each group per range: no
    group, however large, is sorted in one task.
    """
    part = df.orderBy(F.asc_nulls_first(by), *order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    rows = _written(part)
    counts = rows.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_of")).agg(F.count(F.lit(1)).alias("_k"), F.min("_at").alias("_first"))
    upto = Window.partitionBy("_by").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)  # a row a group and range
    starts = _written(counts.withColumns({"_before": F.coalesce(F.sum("_k").over(upto), F.lit(0)), "_many": F.sum("_k").over(Window.partitionBy("_by"))}))
    found = rows.join(starts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_of")))
    return found.withColumn("_rank", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_by", "_of", "_k", "_first", "_before")


def stratified_split(df: DataFrame, key: str, label: str, ratio: float = 0.7, seed: int = 42, least: int = 7, group: str | None = None) -> DataFrame:
    """``train``: the first ``ratio`` of each class in a seeded order; classes under ``least`` rows stay whole.

    With ``group`` (a region of interest) groups are dealt instead of rows, by
    the class that most of their rows have, so that none is on both sides.
    """
    if group is not None:
        votes = df.groupBy(F.col(group).alias("_g"), F.col(label).alias("_l")).count()
        groups = votes.groupBy("_g").agg(F.min_by("_l", F.struct(-F.col("count"), F.col("_l"))).alias("_l"))
        dealt = stratified_split(groups, "_g", "_l", ratio, seed, min(least, 2))
        return df.join(dealt.select("_g", "train"), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    got = ranked(df, label, [hashed(F.col(key), seed), key])
    return got.withColumn("train", (F.col("_many") < least) | (F.col("_rank") < F.floor(F.col("_many") * ratio + 0.5))).drop("_rank", "_many")


def folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``fold`` 0..k-1, dealt in turn within each class in a seeded order."""
    return ranked(df, label, [hashed(F.col(key), seed), key]).withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank", "_many")


def scaler(train: DataFrame, size: int, spectrum: str = "spectrum") -> Callable[[DataFrame], DataFrame]:
    """z-scores of an array column by the statistics of ``train`` alone (least deviation 1e-6).  Returns the scaling."""
    s = covariance(train, spectrum, size).first()
    if s is None:
        return lambda df: df
    mean = array(s["mean"])
    deviation = array(np.maximum(np.sqrt(np.maximum(np.array(s["cov"]).reshape(size, size).diagonal(), 0)), 1e-6))
    return lambda df: df.withColumn(spectrum, F.zip_with(F.zip_with(spectrum, mean, lambda v, m: v - m), deviation, lambda v, t: v / t))


def cross_validate(df: DataFrame, key: str, size: int, k: int = 5, scale: bool = True, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """``(fold, accuracy, n)``, a row a fold that has rows on both sides; ``fit`` makes a predictor that adds ``class``.

    A fold's scaler and model see the other folds only.  The default model is
    the Gaussian one with full covariances.
    """
    if k < 2:
        raise ValueError("two folds or more")
    fit = fit or (lambda train: normal_bayes(train, size))
    dealt = _written(folds(df, key, "label", k))
    sizes = {r["fold"]: r["count"] for r in dealt.groupBy("fold").count().collect()}
    out = None
    for f in [f for f in sorted(sizes) if len(sizes) > 1]:
        train, test = dealt.filter(F.col("fold") != f), dealt.filter(F.col("fold") == f)
        if scale:
            to = scaler(train, size)
            train, test = to(train), to(test)
        row = fit(train)(test).agg(F.lit(f).alias("fold"), F.avg((F.col("class") == F.col("label")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return df.sparkSession.createDataFrame([], "fold int, accuracy double, n long") if out is None else out


def validation_summary(per_fold: DataFrame) -> DataFrame:
    """``(folds, mean, std)`` of the folds' accuracies: one row, the deviation over the folds as a population."""
    return per_fold.agg(F.count("accuracy").alias("folds"), F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std"))


def assign(counts: np.ndarray) -> list[int]:
    """Column for each row of a square table of whole counts that makes their sum largest, by auction.

    A row without a column bids for the one that is worth most to it after
    prices, as much as it gains over the second best and a margin.  Margins
    shrink from auction to auction, prices stay; in units of 1 / (n + 1) the last
    margin of 1 adds up to less than one count, so the sum is the largest.
    """
    n = len(counts)
    worth = np.rint(counts).astype(np.int64) * (n + 1)
    price, margin = np.zeros(n, dtype=np.int64), max(1, int(worth.max(initial=0)) // 2)
    while True:
        holder, held = [-1] * n, [-1] * n
        waiting = list(range(n))
        while waiting:
            r = waiting.pop()
            gain = worth[r] - price
            c = int(gain.argmax())
            rest = np.delete(gain, c).max() if n > 1 else gain[c]
            price[c] += gain[c] - rest + margin
            if holder[c] >= 0:
                held[holder[c]] = -1
                waiting.append(holder[c])
            holder[c], held[r] = r, c
        if margin == 1:
            return held
        margin = max(1, margin // 4)


def remap_clusters(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """``mapped``: clusters renamed to the classes that they share most pixels with, one to one.

    The contingency table (clusters x classes) is all that the driver sees.
    """
    rows = df.groupBy(cluster, label).count().collect()
    a, b = sorted({r[cluster] for r in rows}), sorted({r[label] for r in rows})
    n = max(len(a), len(b))
    t = np.zeros((n, n))
    for r in rows:
        t[a.index(r[cluster]), b.index(r[label])] = r["count"]
    pick = assign(t)
    out = F.lit(None).cast("int")
    for i, c in enumerate(a):
        if pick[i] < len(b):
            out = F.when(F.col(cluster) == c, F.lit(b[pick[i]])).otherwise(out)
    return df.withColumn("mapped", out)


def infer(df: DataFrame, key: list[str], model: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``(key.., value)``: a user's function over batches of spectra (rows x bands -> one value a row)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            x = np.stack(pdf["spectrum"].to_numpy()) if len(pdf) else np.zeros((0, 1))
            yield pdf[key].assign(value=np.asarray(model(x), dtype=float))

    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in key)
    return df.select(*key, "spectrum").mapInPandas(run, f"{fields}, value double")


def majority_label(df: DataFrame, segment: str, cls: str, least: int = 1) -> DataFrame:
    """``(segment, class, n)``: class with most pixels per segment, ties to the smaller, at least ``least`` pixels."""
    n = df.groupBy(segment, cls).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    best = n.groupBy(segment).agg(F.min_by(F.struct(F.col(cls).alias("class"), "n"), F.struct(-F.col("n"), F.col(cls))).alias("b"))
    return best.select(segment, "b.class", "b.n")


def consolidate(children: DataFrame) -> DataFrame:
    """``children(child, parent, class, area)`` -> each parent's class by area-weighted vote, handed down to its children."""
    votes = children.groupBy("parent", "class").agg(F.sum("area").alias("area"))
    up = votes.groupBy("parent").agg(F.min_by("class", F.struct(-F.col("area"), F.col("class"))).alias("parent_class"))
    return children.join(up, "parent")
