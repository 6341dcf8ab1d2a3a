"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, other documents are unlabelled.
A linear numpy classifier over words and word prefixes minimises
``pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))`` with the sigmoid loss, where
``pi`` is the class prior, from zero weights over features that few texts but
toxic ones have.  Training happens on a bounded sample; every document is then
scored in one narrow pass.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .labelled import dealt, first_rows, fold, one_label
from .tables import drop, texts_of, tidy, with_text, written

EDGE = re.compile(r"^[\W_]+|[\W_]+$")
PREFIXES = range(3, 9)


def features(token: str) -> list[str]:
    """A token's features: the bare word, and its first 3 to 8 characters where it is longer."""
    w = EDGE.sub("", token)
    return ["=" + w, *[w[:k] for k in PREFIXES if k < len(w)]] if w else []


def tokens(text: str | None) -> set[str]:
    return set((text or "").lower().split())


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def scorer(self, most: int = 400_000):
        memo: dict[str, float] = {}
        get = self.weights.get

        def of(text):
            if len(memo) > most:
                memo.clear()
            total = self.bias
            for t in tokens(text):
                v = memo.get(t)
                if v is None:
                    v = memo[t] = sum([get(f, 0.0) for f in features(t)])
                total += v
            return total

        return of


@dataclass
class Rows:
    """Documents as the indices of their features, one after the other; ``ends`` are their ends."""

    columns: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, lists: list) -> Rows:
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        flat = np.concatenate(lists) if len(lists) else np.zeros(0)
        return cls(flat.astype(np.int32), np.cumsum(sizes))

    def __len__(self) -> int:
        return len(self.ends)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ends), dtype=np.int32), np.diff(self.ends, prepend=0))

    def parts(self, most: int = 1_000_000) -> list[tuple[slice, slice]]:
        """Runs of documents of about ``most`` features each, as slices of documents and of columns."""
        cut = [0, *np.unique(np.searchsorted(self.ends, np.arange(most, self.ends[-1] if len(self) else 0, most)) + 1).tolist(), len(self)]
        at = np.append(0, self.ends)
        return [(slice(a, b), slice(int(at[a]), int(at[b]))) for a, b in zip(cut, cut[1:]) if a < b]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logits(rows: Rows, weights: np.ndarray, bias: float, live: np.ndarray | float = 1.0) -> np.ndarray:
    return np.bincount(rows.owners(), weights=weights[rows.columns] * live, minlength=len(rows)) + bias


def risk_parts(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[float, float]:
    """``pi * R_p(+)`` and ``R_u(-) - pi * R_p(-)`` under the sigmoid loss."""
    return prior * float((1 - fp).mean()), float(fu.mean()) - prior * float(fp.mean())


def slopes(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """How the step's objective changes with the logits of positives and unlabelled:
    the whole risk's slopes, or minus the negative part's where that is below zero."""
    sp, su = fp * (1 - fp), fu * (1 - fu)
    if risk_parts(fp, fu, prior)[1] < 0:
        return prior * sp / len(fp), -su / len(fu)
    return -2 * prior * sp / len(fp), su / len(fu)


def train_nnpu(positive: Rows, unlabelled: Rows, features: int, prior: float, steps: int = 600, rate: float = 0.02, decay: float = 2e-5, present: float = 0.6, bias: float = -2.0, seed: int = 23) -> tuple[np.ndarray, float, list[float]]:
    """``(weights, bias, risks)``: Adam from zero weights on the non-negative risk.

    Every step sees a seeded share ``present`` of the features' occurrences, so
    that every feature learns to carry a document alone; where the negative part
    of its risk is below zero the step goes against it, as the estimator
    prescribes.  ``risks`` has each step's non-negative risk.
    """
    w, b, risks = np.zeros(features), float(bias), []
    rng, m1, m2 = np.random.default_rng(seed), np.zeros(features + 1), np.zeros(features + 1)
    sides = [(rows.columns, rows.owners(), len(rows), rows.parts()) for rows in (positive, unlabelled)]  # worked through in parts: few and small temporaries
    for step in range(1, steps + 1):
        live, scores = [], []
        for columns, owners, n, parts in sides:
            z = np.zeros(n)
            for docs, at in parts:
                live.append(rng.random(at.stop - at.start, dtype=np.float32) < present)
                z[docs] = np.bincount(owners[at] - docs.start, weights=w[columns[at]] * live[-1], minlength=docs.stop - docs.start)
            scores.append(sigmoid(z + b))
        one, two = risk_parts(*scores, prior)
        risks.append(one + max(0.0, two))
        both = slopes(*scores, prior)
        grad, kept = np.append(decay * np.sign(w), both[0].sum() + both[1].sum()), iter(live)
        for (columns, owners, _, parts), g in zip(sides, both):
            for _, at in parts:
                grad[:-1] += np.bincount(columns[at], weights=g[owners[at]] * next(kept), minlength=features)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        move = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b, risks


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held: int = 0, positives: int = 2000, unlabelled: int = 6000, characters: int = 64_000_000, least: int = 4, pure: float = 0.7, prior: float | None = None, steps: int = 600) -> Model:
    """Train on at most ``positives`` toxic and ``unlabelled`` other rows, and on no
    more of them than ``characters`` in all: the documented bounds of the sample.

    Features are those of ``least`` sampled positives or more whose share among
    positives times the prior is at least ``pure`` of their share among the
    unlabelled (1: only toxic documents have it); all of them.  Only rows outside fold
    ``held`` lend their labels; ``prior`` defaults to the share of toxic rows
    among all of those labelled rows, the one use of labels 0.
    """
    known = one_label(labels, id_col, label_col).filter(fold("id", folds) != held)
    if prior is None:
        share = known.agg(F.avg("label").alias("p")).first()["p"]
        prior = float(share or 0.0)
    pos = first_rows(known.filter("label = 1").select("id"), 3, positives).withColumn("positive", F.lit(1))
    ids = docs.select(F.col(id_col).alias("id")).filter(F.col("id").isNotNull() & (fold("id", folds) != held))
    other = first_rows(ids, 11, unlabelled).distinct().withColumn("positive", F.lit(0))
    wanted = F.broadcast(pos.unionByName(other))  # at most positives + unlabelled ids
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(wanted, "id")
    upto = F.sum(F.length("text")).over(Window.orderBy(dealt("id", 7), "positive", "text"))  # over the sample
    sample = written(rows.withColumn("upto", F.coalesce(upto, F.lit(0))).filter(F.col("upto") <= characters).select("positive", "text"), "sample")

    def words(batches):
        for batch in batches:
            for flag, x in zip(batch.column(0), batch.column(1)):
                found = sorted({f for t in tokens(x.as_py()) for f in features(t)})
                yield pa.RecordBatch.from_arrays([pa.array([flag.as_py()] * len(found), pa.int32()), pa.array(found, pa.string())], names=["positive", "feature"])

    counts = sample.repartition(8).mapInArrow(words, "positive int, feature string").groupBy("feature").agg(F.sum("positive").alias("p"), F.sum(1 - F.col("positive")).alias("u"))
    sizes = sample.groupBy("positive").count().collect()
    n_p, n_u = (next((r["count"] for r in sizes if r["positive"] == flag), 0) for flag in (1, 0))
    often = (F.col("p") >= least) & (F.col("p") * (prior * n_u) >= (F.col("u") + 1) * (pure * n_p))
    chosen = sorted(r[0] for r in counts.filter(often).select("feature").collect())
    index = {f: k for k, f in enumerate(chosen)}

    def indices(batches):
        for batch in batches:
            lists = [sorted({index[f] for t in tokens(x.as_py()) for f in features(t) if f in index}) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(v, dtype="<i4").tobytes() for v in lists], pa.binary())], names=["positive", "indices"])

    got = sample.repartition(8).mapInArrow(indices, "positive int, indices binary").toArrow()
    rows = sorted(zip(got.column("positive").to_pylist(), got.column("indices").to_pylist()))
    del got
    tidy(docs.sparkSession)
    drop(sample)
    lists = {flag: Rows.of([np.frombuffer(x, dtype="<i4") for g, x in rows if g == flag]) for flag in (1, 0)}
    del rows
    if not chosen or not 0 < prior < 1 or not len(lists[1]) or not len(lists[0]):
        return Model({}, -20.0)
    w, b, _ = train_nnpu(lists[1], lists[0], len(chosen), prior, steps)
    return Model({f: float(x) for f, x in zip(chosen, w) if abs(x) > 0.02}, float(b))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per input row: kept columns (``id_col`` by default), score in [0, 1], predicted.

    A null text scores as an empty one; null ids and repeated rows are kept.
    """
    rows, path = with_text(docs, text_col, [id_col] if keep is None else keep)

    def run(batches):
        of = model.scorer()
        for batch in batches:
            f = np.array([of(t.as_py()) for t in texts_of(batch, path)], dtype=float)
            s = 1 / (1 + np.exp(-np.clip(f, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column("_kept"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["_kept", "score", "predicted"])

    return rows.mapInArrow(run, f"_kept {rows.schema['_kept'].dataType.simpleString()}, score double, predicted int").select("_kept.*", "score", "predicted")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **sizes) -> DataFrame:
    """``(id_col, held_out, score, predicted)`` per row, by a model that never saw fold ``held``'s labels.

    Without a positive label every score is 0 and nothing is predicted toxic.
    A null id is never held out.
    """
    model = fit(docs, labels, id_col, text_col, label_col, folds, held, **sizes)
    out = score(docs, model, id_col, text_col)
    return out.select(id_col, F.coalesce(fold(id_col, folds) == held, F.lit(False)).alias("held_out"), "score", "predicted")
