"""Support vectors with a Gaussian kernel, trained over all rows by landmarks.

Kernel values towards a bounded number of landmark spectra span a feature space
of that size, in which the machine is linear.  Each pair of classes is one
machine; all of them are trained together, a pass over the training rows a
Newton step.  With every distinct training row as a landmark this is the kernel
machine itself; with fewer, ``residual`` says how much of the rows' kernel norm
the landmarks miss.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .components import _drop, _written
from .stats import covariance

#: The hinge is rounded off over this distance from the margin, in stages.
WIDTHS = (0.3, 0.1, 0.03, 0.01)
#: Newton steps within a stage; the last weights count if they run out.
STEPS = 15


@dataclass(frozen=True)
class KernelMachine:
    classes: list
    landmarks: np.ndarray
    basis: np.ndarray  # kernel values to coordinates
    weights: np.ndarray  # a row a pair of classes, the offset last
    gamma: float
    mean: np.ndarray
    deviation: np.ndarray
    residual: float

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        return _coordinates((x - self.mean) / self.deviation, self.landmarks, self.basis, self.gamma)

    def decisions(self, x: np.ndarray) -> np.ndarray:
        """A column a pair of classes (in order of `pairs`): positive for the first of the two."""
        return self.coordinates(x) @ self.weights.T

    def save(self, spark: SparkSession, path: str) -> None:
        """A one-row Parquet table in a folder that driver and executors share."""
        flat = {k: np.asarray(getattr(self, k), dtype=float).ravel().tolist() for k in ("classes", "landmarks", "basis", "weights", "mean", "deviation")}
        spark.createDataFrame([{**flat, "gamma": float(self.gamma), "residual": float(self.residual)}]).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> KernelMachine:
        r = spark.read.parquet(path).first()
        bands, m = len(r["mean"]), len(r["landmarks"]) // len(r["mean"])
        basis = np.array(r["basis"]).reshape(m, -1)
        weights = np.array(r["weights"]).reshape(-1, basis.shape[1] + 1)
        return KernelMachine(r["classes"], np.array(r["landmarks"]).reshape(m, bands), basis, weights, r["gamma"], np.array(r["mean"]), np.array(r["deviation"]), r["residual"])


def pairs(n: int) -> list[tuple[int, int]]:
    return list(combinations(range(n), 2))


def _coordinates(x, landmarks, basis, gamma):
    far = (x * x).sum(1)[:, None] + (landmarks * landmarks).sum(1)[None] - 2 * x @ landmarks.T
    return np.concatenate([np.exp(-gamma * np.maximum(far, 0)) @ basis, np.ones((len(x), 1))], axis=1)


def _whole(df: DataFrame, spectrum: str, size: int):
    x = F.col(spectrum).cast("array<double>")
    return (F.size(x) == size) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v))


def _matrix(column, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def hinge(z: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, slopes and curvature at margins ``z`` of a smooth hinge, above the plain one by at most ``width`` x log 2."""
    u = (1 - z) / width
    part = 1 / (1 + np.exp(-np.clip(u, -500, 500)))
    return width * np.logaddexp(0, u), -part, part * (1 - part) / width


def _summed(key, pdf):
    return pd.DataFrame({"pair": [key[0]], "v": [np.sum(np.stack(pdf["v"].to_numpy()), axis=0)]})


def kernel_machine(df: DataFrame, size: int, label: str = "label", spectrum: str = "spectrum", c: float = 10.0, gamma: float = 0.5, landmarks: int = 256, scale: bool = True, seed: int = 42) -> KernelMachine:
    """Train on all rows of ``df`` whose spectrum is whole and whose label (a number) is not null.

    ``landmarks`` bounds the feature space (distinct spectra, in a seeded order
    of hashes).  ``scale`` takes z-scores first, least deviation 1e-6.  The
    driver holds a weight per landmark and pair of classes, tasks a matrix of
    landmarks x landmarks per pair.  Fewer than two classes: no machine, and
    every row gets the only class.
    """
    rows = _written(df.filter(F.col(label).isNotNull() & _whole(df, spectrum, size)).select(F.col(label).cast("double").alias("_l"), F.col(spectrum).cast("array<double>").alias("_x")))
    stats = covariance(rows, "_x", size).first() if scale else None
    mean = np.array(stats["mean"]) if stats else np.zeros(size)
    deviation = np.maximum(np.sqrt(np.maximum(np.array(stats["cov"]).reshape(size, size).diagonal(), 0)), 1e-6) if stats else np.ones(size)
    classes = sorted(r["_l"] for r in rows.select("_l").distinct().collect())
    picked = rows.select("_x").distinct().orderBy(F.xxhash64("_x", F.lit(seed)), "_x").limit(landmarks).collect()
    points = (np.array([r["_x"] for r in picked]).reshape(-1, size) - mean) / deviation
    among = _coordinates(points, points, np.eye(len(points)), gamma)[:, :-1]
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    kept = values > 1e-9 * max(values.max(initial=0), 1e-300)
    basis = vectors[:, kept] / np.sqrt(values[kept])
    two, wide = pairs(len(classes)), basis.shape[1] + 1
    weights, residual = np.zeros((len(two), wide)), 0.0
    if two:
        weights, residual = _newton(rows, classes, two, size, points, basis, gamma, c, mean, deviation)
    _drop(rows)
    return KernelMachine(classes, points, basis, weights, gamma, mean, deviation, residual)


def _newton(rows, classes, two, size, points, basis, gamma, c, mean, deviation):
    wide = basis.shape[1] + 1
    upper = np.triu_indices(wide)
    codes = np.array(classes)
    weights, moves = np.zeros((len(two), wide)), np.zeros((len(two), wide))
    loss, fall, share = np.full(len(two), np.inf), np.zeros(len(two)), np.ones(len(two))
    stage, steps = np.zeros(len(two), dtype=int), np.zeros(len(two), dtype=int)
    missed, many = None, rows.rdd.getNumPartitions()
    while (live := np.flatnonzero(stage < len(WIDTHS))).size:
        trial = weights + share[:, None] * moves
        width = np.array([WIDTHS[min(s, len(WIDTHS) - 1)] for s in stage])

        def run(batches):
            sums, missing, seen = {}, 0.0, 0
            for batch in batches:
                y = np.searchsorted(codes, batch.column(0).to_numpy(zero_copy_only=False))
                f = _coordinates((_matrix(batch.column(1), size) - mean) / deviation, points, basis, gamma)
                missing, seen = missing + float((2 - (f * f).sum(1)).sum()), seen + len(y)
                for p in live:
                    a, b = two[p]
                    of = (y == a) | (y == b)
                    g, s = f[of], np.where(y[of] == a, 1.0, -1.0)
                    value, slope, curve = hinge(s * (g @ trial[p]), width[p])
                    part = np.concatenate([[value.sum()], g.T @ (slope * s), ((g.T * curve) @ g)[upper]])
                    sums[int(p)] = sums.get(int(p), 0) + part
            if seen:
                sums[-1] = np.array([missing, seen])
                yield pa.RecordBatch.from_pydict({"pair": pa.array(list(sums), pa.int32()), "v": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))})

        def step(key, pdf):  # noqa: B023
            p, v = key[0], np.sum(np.stack(pdf["v"].to_numpy()), axis=0)
            if p < 0:
                return pd.DataFrame({"pair": [p], "loss": [v[0] / v[1]], "fall": [0.0], "move": [[]]})
            flat = np.append(trial[p][:-1], 0.0)  # the offset is free: a little bend keeps its steps finite
            bend = np.zeros((wide, wide))
            bend[upper] = c * v[1 + wide :]
            bend = bend + np.triu(bend, 1).T + np.diag(np.append(np.ones(wide - 1), 1e-8))
            slope = flat + c * v[1 : 1 + wide]
            move = -np.linalg.solve(bend, slope)
            return pd.DataFrame({"pair": [p], "loss": [float(flat @ flat / 2 + c * v[0])], "fall": [float(-(slope @ move))], "move": [move.tolist()]})

        parts = rows.mapInArrow(run, "pair int, v array<double>")
        if many > 64:  # sums of sums, so that no task meets a part of every partition
            slots = parts.withColumn("_slot", F.spark_partition_id() % 32)
            parts = slots.groupBy("pair", "_slot").applyInPandas(_summed, "pair int, v array<double>")
        for r in parts.groupBy("pair").applyInPandas(step, "pair int, loss double, fall double, move array<double>").collect():  # a row a pair
            p = r["pair"]
            if p < 0:
                missed = r["loss"] if missed is None else missed
                continue
            steps[p] += 1
            if r["loss"] <= loss[p] - 1e-4 * share[p] * fall[p]:
                weights[p], moves[p], loss[p], fall[p], share[p] = trial[p], r["move"], r["loss"], r["fall"], 1.0
            else:
                share[p] /= 2
            if fall[p] <= 1e-4 * (1 + loss[p]) or steps[p] >= STEPS:
                # the next stage starts from these weights, at its own loss
                stage[p], steps[p], loss[p], fall[p], share[p] = stage[p] + 1, 0, np.inf, 0.0, 0.0
    return weights, max(0.0, missed or 0.0)


def classify(df: DataFrame, machine: KernelMachine, spectrum: str = "spectrum") -> DataFrame:
    """``df`` with ``class`` (a double) by one-against-one votes and ``share``, its part of the votes it could get.

    Ties go to the smaller class; rows without a whole spectrum get nulls.
    """
    size, two, many, names = len(machine.mean), pairs(len(machine.classes)), len(machine.classes), df.columns

    def run(batches):
        for batch in batches:
            ok = batch.column("_ok").to_numpy(zero_copy_only=False).astype(bool)
            cls, share = np.full(len(ok), np.nan), np.full(len(ok), np.nan)
            if ok.any() and many:
                x = _matrix(batch.column("_x").filter(batch.column("_ok")), size)
                votes, d = np.zeros((len(x), many)), machine.decisions(x)
                for p, (a, b) in enumerate(two):
                    votes[:, a] += d[:, p] >= 0
                    votes[:, b] += d[:, p] < 0
                best = votes.argmax(1)
                cls[ok], share[ok] = np.array(machine.classes)[best], votes[np.arange(len(x)), best] / (many - 1) if many > 1 else 1.0
            none = np.isnan(cls)
            cols = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(cls, pa.float64(), mask=none), pa.array(share, pa.float64(), mask=none)], names=[*names, "class", "share"])

    ok = F.coalesce(_whole(df, spectrum, size), F.lit(False))
    rows = df.select("*", ok.alias("_ok"), F.when(ok, F.col(spectrum).cast("array<double>")).alias("_x"))
    return rows.mapInArrow(run, StructType([*df.schema.fields, StructField("class", DoubleType()), StructField("share", DoubleType())]))
