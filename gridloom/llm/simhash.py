"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most 4 bits exactly when some value lies
within 2 bits of both.  Every distinct fingerprint therefore emits all 2,081
values within 2 bits, values meet in a shuffle, and those that share a value
are linked (each is within 2 of it, so within 4 of the others: a star to the
least one carries the group, never all pairs).

The shuffle is on the variants, packed: a variant's bucket is a linear
function over GF(2) of its bits, so the flips that take a fingerprint into a
bucket depend on the fingerprint's own bucket only.  A task sends its
fingerprints to each bucket that they reach, once, and the bucket lays out
exactly the variants that fall into it.  A fingerprint travels to
``min(buckets, 2081)`` places at most, 8 bytes each, instead of 2,081 rows;
buckets grow with the number of distinct fingerprints so that each holds about
``per_bucket`` variants, and they are worked through ``per_pass`` at a time so
that shuffle files on disk stay in proportion to the fingerprints.  As only
distinct fingerprints take part, one value is shared by 2,081 of them at most:
no bucket can be hot, however many copies there are.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components
from .tables import drop, new_folder, placed_at, written

LANES = np.uint64(0x0101010101010101)


def majority(h: np.ndarray) -> int:
    """Bits that are set in over half of ``h``; counts go in byte lanes, 255 hashes at a time."""
    n = len(h)
    if not n:
        return 0
    starts = np.arange(0, n, 255)
    out = 0
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & LANES, starts)
        counts = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(2 * counts > n):
            out |= 1 << (8 * int(byte) + k)
    return out


def fingerprint(text: str | None, size: int = 4) -> int:
    """Majority of the shingles' XXH64 (seed 42); A-Z lower-cased, words apart by ASCII white space, 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, 42)
    starts = np.append(0, ends[:-1] + 1)[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    digest, n, parts = xxhash.xxh64_intdigest, len(starts), []
    if n < 200_000:
        return majority(np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends)], dtype=np.uint64))
    # very long texts: as arrays a part at a time
    for k in range(0, n, 100_000):
        parts.append(np.array([digest(joined[a:b], 42) for a, b in zip(starts[k : k + 100_000], ends[k : k + 100_000])], dtype=np.uint64))
    return majority(np.concatenate(parts))


@functools.lru_cache(maxsize=4)
def columns(bits: int) -> np.ndarray:
    """A column of the bucket function for each of the 64 bits."""
    return np.random.default_rng(64 + bits).integers(1, 1 << bits, 64, dtype=np.int64)


def bucket_of(x: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of each uint64: the XOR of the columns of its set bits, by byte tables."""
    col = columns(bits)
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)
    out = np.zeros(len(x), dtype=np.int64)
    value = np.arange(256)
    for byte in range(8):
        table = np.zeros(256, dtype=np.int64)
        for k in range(8):
            table ^= np.where((value >> k) & 1, col[8 * byte + k], 0)
        out ^= table[raw[:, byte]]
    return out


@functools.lru_cache(maxsize=4)
def flips(bits: int, width: int = 64) -> dict[int, np.ndarray]:
    """All masks of at most two of the low ``width`` bits, by the bucket step they make."""
    one = [np.uint64(1) << np.uint64(k) for k in range(width)]
    masks = np.array([np.uint64(0), *one, *[one[a] | one[b] for a in range(width) for b in range(a)]], dtype=np.uint64)
    step = bucket_of(masks, bits)
    order = np.argsort(step, kind="stable")
    cut = np.flatnonzero(np.diff(step[order])) + 1
    return {int(step[g[0]]): masks[g] for g in np.split(order, cut)}


def shared(fps: np.ndarray, bucket: int, bits: int, width: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(place, at, values)``: the values of ``bucket`` that lie in the balls of two or
    more of the distinct ``fps`` (uint64), and for each value (its ``place``) the places ``at`` in ``fps`` of its owners."""
    step = bucket_of(fps, bits) ^ bucket
    order = np.argsort(step, kind="stable")
    cut = np.flatnonzero(np.diff(step[order])) + 1
    keys, owner = [], []
    for g in np.split(order, cut):
        masks = flips(bits, width).get(int(step[g[0]])) if len(g) else None
        if masks is not None:
            keys.append((fps[g][:, None] ^ masks[None, :]).ravel())
            owner.append(np.repeat(g.astype(np.int32), len(masks)))
    none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.uint64)
    if not keys:
        return none
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    if not len(twice):
        return none
    # which variants are among the shared ones: a bit table first, then exactly
    mix = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    seen = np.zeros(1 << 24, dtype=bool)
    seen[mix(twice)] = True
    at = np.flatnonzero(seen[mix(keys)])
    place = np.minimum(np.searchsorted(twice, keys[at]), len(twice) - 1)
    ok = twice[place] == keys[at]
    return place[ok], owner[at[ok]], twice


def met(fps: np.ndarray, bucket: int, bits: int, width: int = 64, picks: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges ``(u, v, turn, rank)`` among distinct ``fps`` (uint64) whose balls meet in ``bucket``.

    Without ``picks``, a shared value links its owners to the least of them: a
    star, which connects all that meet (turn 0).  With ``picks``, every
    fingerprint gets three partners at most, however many it meets: the first
    of them in a seeded order that holds for all values (turn 0), the one that
    shares most values with others, the middle of a group (1), and the nearest
    of these and of its neighbours in order (2).  The least ``rank`` is the pick.
    """
    place, at, _ = shared(fps, bucket, bits, width)
    if not len(at):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    members = fps[at]

    def stars(rank):
        order = np.lexsort((members, rank, place))
        p, m = place[order], members[order]
        first = np.append(True, p[1:] != p[:-1])
        centre = order[np.flatnonzero(first)][np.cumsum(first) - 1]
        return members[centre[~first]], m[~first], rank[centre[~first]]

    if not picks:
        u, v, _ = stars(members)
        pairs = np.unique(np.stack([u, v], axis=1), axis=0)
        pairs = pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= 4]
        return pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), dtype=np.int32), np.zeros(len(pairs), dtype=np.int64)
    hashed = (spread(members) >> np.uint64(8)).astype(np.int64)
    _, of, many = np.unique(members, return_inverse=True, return_counts=True)
    sides = [stars(hashed), stars(-many[of])]
    order = np.lexsort((members, place))
    p, m = place[order], members[order]
    beside = p[1:] == p[:-1]
    u, v = (np.concatenate([*x, *[side[k] for side in sides]]) for k, x in enumerate(((m[:-1][beside], m[1:][beside]), (m[1:][beside], m[:-1][beside]))))
    sides.append((u, v, (np.bitwise_count(u ^ v).astype(np.int64) << 56) | (spread(u) >> np.uint64(8)).astype(np.int64)))
    found = [(*_one_each(*side), turn) for turn, side in enumerate(sides)]
    u, v, rank = (np.concatenate([x[k] for x in found]) for k in range(3))
    turn = np.concatenate([np.full(len(x[0]), x[3], dtype=np.int32) for x in found])
    near = np.bitwise_count(u ^ v) <= 4
    return u[near], v[near], turn[near], rank[near]


def across(fps: np.ndarray, labels: np.ndarray, bucket: int, bits: int, width: int = 64, most: int = 1 << 20, weights: np.ndarray | None = None, crowd: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs ``(u, v)`` among distinct ``fps`` within 4 bits whose ``labels`` differ, about
    ``most`` candidates at a time; a label 0 differs from every other, also from 0.

    A pair meets in many values and comes from one of them only: the one that
    takes the lowest two of its differing bits from the greater fingerprint.

    With ``crowd``, a fingerprint that meets more than that in one value (by
    ``weights``, other labels only) is crowded: it comes as ``(u, u)``, and
    pairs of two crowded ones are not laid out, so that work and pairs stay in
    proportion to the fingerprints.
    """
    place, at, values = shared(fps, bucket, bits, width)
    label = np.where(labels == 0, -1 - np.arange(len(labels)), labels)[at]
    order = np.lexsort((label, place))
    place, at, label = place[order], at[order], label[order]
    other = np.append(True, place[1:] != place[:-1])[: len(at)]
    inner = other | np.append(True, label[1:] != label[:-1])[: len(at)]

    def runs(new):
        """First place of each entry's run, and the place after its last."""
        first, of = np.flatnonzero(new), np.cumsum(new) - 1
        return first[of], np.append(first[1:], len(at))[of]

    (begin, end), (own, own_end) = runs(other), runs(inner)
    crowded = np.zeros(len(fps), dtype=bool)
    if crowd is not None and len(at):
        upto = np.append(0, np.cumsum(weights[at]))
        crowded[at[upto[end] - upto[begin] - (upto[own_end] - upto[own]) > crowd]] = True
        if crowded.any():
            yield fps[crowded], fps[crowded]
    # partners are all of the value but those of the own label; of two that are not crowded, the later one
    left = np.flatnonzero(~crowded[at])
    many = (end - begin - (own_end - own))[left]
    upto, k = np.append(0, np.cumsum(many)), 0
    while k < len(left):
        last = max(k + 1, int(np.searchsorted(upto, upto[k] + most, side="right")) - 1)
        i = np.repeat(left[k:last], many[k:last])
        j = begin[i] + np.arange(len(i)) - np.repeat(upto[k:last] - upto[k], many[k:last])
        j = np.where(j < own[i], j, j + own_end[i] - own[i])
        once = (j > i) | crowded[at[j]]
        i, j = i[once], j[once]
        u, v = fps[at[i]], fps[at[j]]
        u, v = np.minimum(u, v), np.maximum(u, v)
        x = u ^ v
        rest = x & (x - np.uint64(1))
        rest &= rest - (rest > 0).astype(np.uint64)
        here = values[place[i]] == u ^ x ^ rest
        if here.any():
            yield u[here], v[here]
        k = last


def _one_each(u: np.ndarray, v: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each ``v`` its ``u`` of least rank."""
    order = np.lexsort((u, rank, v))
    u, v, rank = u[order], v[order], rank[order]
    first = np.append(True, v[1:] != v[:-1])[: len(v)]
    return u[first], v[first], rank[first]


def spread(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one scattering of 64-bit numbers (SplitMix64's finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def links(fps: DataFrame, per_bucket: int = 8_000_000, per_pass: int = 64, width: int = 64, least_bits: int = 6, picks: bool = False, labelled: bool = False, crowd: int | None = None) -> DataFrame:
    """``fps(family int, fp bigint)``, distinct -> edges ``(family, u, v, turn, rank)`` within
    each family; written in the shared folder.  Without ``picks`` they connect
    exactly what pairs within 4 bits connect; with it they are a few partners of
    every fingerprint (`met`).  With ``labelled``, ``fps`` has a third column
    ``label bigint`` (0 or more) and the result is ``(family, u, v)``: every pair within 4 bits
    whose labels differ, once (`across`).  With ``crowd`` too, a fourth column
    ``n bigint`` is a fingerprint's weight, crowded ones come as ``(u, u)``, more than once perhaps, and
    pairs of two crowded ones may be missing.  Fingerprints have ``width`` bits.  No
    fingerprints give no edges; nulls are not expected.
    """
    spark = fps.sparkSession
    n = fps.groupBy("family").count().agg(F.max("count")).first()[0] or 0
    variants = 1 + width + width * (width - 1) // 2
    bits = max(least_bits, int(np.ceil(np.log2(max(1.0, n * variants / per_bucket)))))
    path, total = new_folder(spark, "links"), 1 << bits
    schema = "family int, u bigint, v bigint" + ("" if labelled else ", turn int, rank bigint")
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(cleanup, None)
    try:
        for start in range(0, total, per_pass):
            these = range(start, min(start + per_pass, total))

            def send(batches, these=these):
                reach = np.zeros(1 << bits, dtype=bool)
                reach[list(flips(bits, width))] = True
                for batch in batches:
                    family, out = batch.column(0).to_numpy(), []
                    # a fingerprint and its label, if it has one, are a row of numbers
                    sent = np.stack([c.to_numpy().view(np.uint64) for c in batch.columns[1:]], axis=1)
                    for f in np.unique(family):
                        x = sent[family == f]
                        home = bucket_of(x[:, 0], bits)
                        out += [(f, b, y.tobytes()) for b in these if len(y := x[reach[home ^ b]])]
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.int32()), pa.array([k[1] for k in out], pa.int32()), pa.array([k[2] for k in out], pa.binary())], names=["family", "bucket", "fps"])

            def collide(pdf: pd.DataFrame) -> pd.DataFrame:
                x = np.unique(np.frombuffer(b"".join(pdf["fps"]), dtype=np.uint64))
                u, v, turn, rank = met(x, int(pdf["bucket"].iloc[0]), bits, width, picks)
                return pd.DataFrame({"family": np.full(len(u), pdf["family"].iloc[0], dtype=np.int32), "u": u.view(np.int64), "v": v.view(np.int64), "turn": turn, "rank": rank})

            def collide_across(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                x = np.frombuffer(b"".join(b for pdf in parts for b in pdf["fps"]), dtype=np.uint64).reshape(-1, 2 + (crowd is not None))
                weights = x[:, 2].astype(np.int64) if crowd is not None else None
                for u, v in across(x[:, 0].copy(), x[:, 1].astype(np.int64), int(key[1]), bits, width, weights=weights, crowd=crowd):
                    yield pd.DataFrame({"family": np.full(len(u), key[0], dtype=np.int32), "u": u.view(np.int64), "v": v.view(np.int64)})

            if total > per_pass:  # a pass's shuffle files go when the pass is written
                spark.conf.set(cleanup, "true")
            sent = fps.select("family", "fp", *["label"] * labelled, *["n"] * (crowd is not None)).mapInArrow(send, "family int, bucket int, fps binary")
            sent.groupBy("family", "bucket").applyInPandas(collide_across if labelled else collide, schema).write.mode("append").parquet(path)
    finally:
        if total > per_pass:
            spark.conf.set(cleanup, was) if was is not None else spark.conf.unset(cleanup)
    return placed_at(spark.read.schema(schema).parquet(path), path)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """``(id, fp)`` per row, ``fp`` the fingerprint as a signed bigint."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """One row per input row: ``(id_col, fingerprint, component_id, root)``.

    ``component_id`` is the smallest id that the row reaches over links of at
    most 4 differing bits, ``root`` the component's least fingerprint (signed).
    Texts without words (null, empty, white space) share fingerprint zero and
    are linked like any other.  Null ids never name a component: it is null
    only where all ids of the component are; repeated rows are kept; an empty
    table gives an empty result.
    """
    docs = written(fingerprints(df, id_col, text_col, size), "fingerprints")
    distinct = written(docs.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    edges = links(distinct.select(F.lit(0).alias("family"), "fp"))
    roots = components.labels(edges.select("u", "v"))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.select("fp", "root").join(ids, "root"), "components")
    drop(distinct, edges, roots)
    return docs.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root")
