"""Quality scores: random-indexing word vectors, pooled per document, and a two-layer network.

Word vectors come from all documents: every word adds up the sparse ternary
index vectors of its neighbours.  A word that makes up ``SHARE`` of all words or
more has a row of its own, so the vocabulary has 1 / SHARE words at most,
however large the corpus; rarer words are hashed into ``REST`` rows.  Tasks send
integer sums per row, Spark adds them up, and the bounded matrix, freed of what
all words share and evened out along its axes, is shared with all tasks.  The network is trained on a bounded sample of labelled
documents; its probabilities are calibrated by one temperature on held-back
rows of that sample.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import first_rows, fold, one_label
from .tables import drop, written

#: Fixed value: marks that stand as words of their own.
MARKS = [bytes([c]) for c in b"#*$%&|<>!?"]
DIM, REACH = 32, 2
#: Least share and count of a word with a row of its own; rows for the others.
SHARE, LEAST, REST = 1e-5, 5, 8192
SEED = 17


def words_of(text: str | None) -> list[bytes]:
    """The text's words; case matters, marks are words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    for m in MARKS:
        raw = raw.replace(m, b" " + m + b" ")
    return raw.split()


class Vocabulary(dict):
    """Row numbers of words; what has no row of its own falls into one of the last ``REST``."""

    def __init__(self, words: list[bytes]):
        super().__init__({w: k for k, w in enumerate(words)})
        self.own = len(words)
        self.rows = self.own + REST

    def __missing__(self, word: bytes) -> int:
        return self.own + crc32(word) % REST

    def __reduce__(self):
        return Vocabulary, (sorted(self, key=self.get),)

    def ids(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


def vocabulary(docs: DataFrame, text_col: str = "text") -> Vocabulary:
    """Words of all documents with a row of their own, in byte order."""

    def run(batches):
        held: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in batch.column(0):
                held.update(words_of(t.as_py()))
                if len(held) > 200_000:
                    yield rows()
                    held.clear()
        yield rows()

    counts = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts, "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.filter((F.col("n") >= LEAST) & (F.col("n") >= SHARE * total)).select("word").collect()  # 1 / SHARE at most
    drop(counts)
    return Vocabulary(sorted(bytes(r["word"]) for r in often))


def index_vectors(rows: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Each row's index vector: +1 at one place, -1 at another; the row after the last is the gap between texts (0)."""
    rng = np.random.default_rng(seed)
    plus = rng.integers(0, DIM, rows + 1)
    minus = (plus + rng.integers(1, DIM, rows + 1)) % DIM
    plus[rows] = minus[rows] = 0
    return plus, minus


def neighbour_sums(ids: np.ndarray, rows: int, seed: int = SEED) -> np.ndarray:
    """Sums of neighbours' index vectors, (rows + 1) x DIM, for ids with gaps (``rows``) between texts."""
    plus, minus = index_vectors(rows, seed)
    size = (rows + 1) * DIM
    total = np.zeros(size, dtype=np.int64)
    for far in range(1, REACH + 1):
        for word, other in ((ids[:-far], ids[far:]), (ids[far:], ids[:-far])):
            base = word * DIM
            total += np.bincount(base + plus[other], minlength=size)
            total -= np.bincount(base + minus[other], minlength=size)
    return total.reshape(rows + 1, DIM)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def evened(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Unit vectors of the rows' sums, centred and scaled along the principal axes of words by occurrence (``n``).

    Common words are everyone's neighbours, so sums lean the same few ways; this
    takes out the mean direction and the unequal spread.  Rows that never occur
    stay 0, as do rows at the mean itself.
    """
    if not n.sum():
        return np.zeros(sums.shape)
    x = _unit(sums.astype(float))
    weight = n[:, None] / n.sum()
    x = (x - (x * weight).sum(0)) * (n[:, None] > 0)
    spread, axes = np.linalg.eigh((x * weight).T @ x)
    ridge = 0.05 * spread.mean()
    return _unit(x @ axes / np.sqrt(np.maximum(spread, 0) + ridge)) if ridge > 1e-12 else np.zeros(sums.shape)


def random_indexing(docs: DataFrame, shared, text_col: str = "text", seed: int = SEED) -> np.ndarray:
    """Unit word vectors over all documents, a row per row of the broadcast vocabulary ``shared``; rows of words never seen are 0."""
    size_ = shared.value.rows

    def run(batches):
        words, rows = shared.value, size_
        gap = np.full(REACH, rows, dtype=np.int64)
        total, n, held, size = np.zeros((rows + 1, DIM), dtype=np.int64), np.zeros(rows, dtype=np.int64), [], 0

        def add():
            ids = np.concatenate(held)
            return neighbour_sums(ids, rows, seed), np.bincount(ids, minlength=rows + 1)[:rows]

        for batch in batches:
            for t in batch.column(0):
                ids = words.ids(t.as_py())
                held += [ids, gap]
                size += len(ids)
                if size > 1_000_000:
                    more, seen = add()
                    total, n, held, size = total + more, n + seen, [], 0
        if held:
            more, seen = add()
            total, n = total + more, n + seen
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), *[pa.array(total[some, k]) for k in range(DIM)]], names=["row", "n", *[f"d{k}" for k in range(DIM)]])

    sums = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "row bigint, n bigint, " + ", ".join(f"d{k} bigint" for k in range(DIM)))
    got = sums.groupBy("row").agg(F.sum("n").alias("n"), *[F.sum(f"d{k}").alias(f"d{k}") for k in range(DIM)]).toArrow()  # the vocabulary's rows at most
    out, n = np.zeros((size_, DIM)), np.zeros(size_)
    if len(got):
        at = got.column("row").to_numpy()
        n[at] = got.column("n").to_numpy()
        out[at] = np.stack([got.column(f"d{k}").to_numpy() for k in range(DIM)], axis=1)
    return evened(out, n).astype(np.float32)


def pooled(text: str | None, words: Vocabulary, vectors: np.ndarray) -> np.ndarray:
    """Mean of the words' vectors, spread around it, and log length; an empty text is all 0."""
    ids = words.ids(text)
    if not len(ids):
        return np.zeros(2 * DIM + 1)
    s, q = np.zeros(DIM), np.zeros(DIM)
    for k in range(0, len(ids), 1 << 16):
        x = vectors[ids[k : k + (1 << 16)]]
        s += x.sum(0)
        q += np.einsum("ij,ij->j", x, x)
    mean = s / len(ids)
    return np.concatenate([mean, np.sqrt(np.maximum(q / len(ids) - mean * mean, 0)), [np.log1p(len(ids)) / 10]])


@dataclass
class Network:
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def train_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Network | None:
    """Adam on the log loss over four fifths of the rows; the last fifth fits the temperature.  None without both classes."""
    if len(x) < 10 or len(np.unique(y)) < 2:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    cut = max(1, len(x) // 5)
    val, fit = order[:cut], order[cut:]
    net = Network(x[fit].mean(0), x[fit].std(0) + 1e-3, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), 0.0)
    z = (x - net.centre) / net.scale
    params = ["w1", "b1", "w2", "b2"]
    m, v, t = {p: 0.0 for p in params}, {p: 0.0 for p in params}, 0
    for _ in range(epochs):
        shuffled = fit[rng.permutation(len(fit))]
        for k in range(0, len(shuffled), batch):
            at = shuffled[k : k + batch]
            h = np.tanh(z[at] @ net.w1 + net.b1)
            e = (1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -40, 40))) - y[at]) / len(at)
            back = np.outer(e, net.w2) * (1 - h * h)
            grads = {"w1": z[at].T @ back + decay * net.w1, "b1": back.sum(0), "w2": h.T @ e + decay * net.w2, "b2": e.sum()}
            t += 1
            for p in params:
                m[p] = 0.9 * m[p] + 0.1 * grads[p]
                v[p] = 0.999 * v[p] + 0.001 * grads[p] ** 2
                setattr(net, p, getattr(net, p) - rate * (m[p] / (1 - 0.9**t)) / (np.sqrt(v[p] / (1 - 0.999**t)) + 1e-8))
    raw = net.logit(x[val])
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 120))
    loss = [np.mean(np.logaddexp(0, np.where(y[val] == 1, -raw, raw) / g)) for g in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


def quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.7, sample: int = 12_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = SEED) -> DataFrame:
    """``(id_col, held_out, score, predicted)`` per row.

    Labels are read only outside fold ``held``, from at most ``sample`` rows
    (the documented bound); word vectors come from all texts.  A null text is
    an empty one; null ids (never held out) and repeated rows are kept; without
    labels of both classes every score is the share of label 1 (0 without any).
    ``seed`` is that of the index vectors.
    """
    spark = docs.sparkSession
    words = spark.sparkContext.broadcast(vocabulary(docs, text_col))
    shared = spark.sparkContext.broadcast(random_indexing(docs, words, text_col, seed))  # rows x DIM floats: under 14 MB at any size
    known = first_rows(one_label(labels, id_col, label_col).filter(fold("id", folds) != held), 5, sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "id").select("text", "label")

    def pool(batches):
        for batch in batches:
            x = np.array([pooled(t.as_py(), words.value, shared.value) for t in batch.column(0)]).reshape(-1, 2 * DIM + 1)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([r.tobytes() for r in x])], names=["label", "x"])

    got = rows.mapInArrow(pool, "label int, x binary").toArrow()
    both = sorted(zip(got.column("x").to_pylist(), got.column("label").to_pylist()))
    x, y = np.array([np.frombuffer(a) for a, _ in both]).reshape(-1, 2 * DIM + 1), np.array([b for _, b in both], dtype=float)
    net, flat = train_network(x, y), float(y.mean()) if len(y) else 0.0

    def run(batches):
        for batch in batches:
            x = np.array([pooled(t.as_py(), words.value, shared.value) for t in batch.column(1)]).reshape(-1, 2 * DIM + 1)
            s = net.probability(x) if net is not None else np.full(len(x), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, score double, predicted int")
    return out.select(F.col("id").alias(id_col), F.coalesce(fold("id", folds) == held, F.lit(False)).alias("held_out"), "score", "predicted")
