"""Near-duplicate texts: SimHash ball hashing over several fingerprints, verified by Jaccard similarity.

One fingerprint at radius 4 finds few of the pairs at shingle similarity 0.8.
Here every text gets several short fingerprints from independent hashes of its
shingle set; each family goes through the meet-in-the-middle ball hashing of
`simhash.links`, and what collides in any family is verified: first by all bits
of the fingerprints, then by the exact similarity of the shingle sets.

A fingerprint bit of two sets at similarity J differs with probability
arccos(2J / (1 + J)) / pi, so width and number of families follow from the
recall asked for and the number of texts (see `plan`): longer fingerprints for
more texts, so that chance collisions stay in proportion to the texts, and more
of them, so that recall stays.

A large group of near copies collides on thousands of values.  Its pairs are
never laid out: of the partners that it meets in a family, a text takes the
first in an order that holds for all texts and the one that meets most others
(which tie a group together), the nearest, and one text of the same fingerprint, so that a group of n costs a
fixed number of comparisons a text.  The pairs of each text with its least
partner come first; the others are verified where they join components.
Components then shrink to their most typical text, and texts that have met
others without a link meet again with these, until a round finds no link.
"""

from __future__ import annotations

from functools import reduce
from math import acos, ceil, comb, log, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import components
from .bytebpe import groups
from .simhash import LANES, links, spread
from .tables import drop, small, tidy, written

RADIUS = 4
ODD = np.uint64(0x9E3779B97F4A7C15)
SEEDS = spread(np.arange(1, 257, dtype=np.uint64))


def plan(texts: int, similarity: float = 0.8, recall: float = 0.98) -> tuple[int, int]:
    """``(width, families)``: the least width of 32 bits or more at which a text
    meets one other by chance at most, and the families that find a pair at
    ``similarity`` with probability ``recall`` or more."""
    ball = lambda b: sum(comb(b, k) for k in range(RADIUS + 1))
    width = next((b for b in range(32, 64) if texts * ball(b) <= 1 << b), 64)
    p = acos(2 * similarity / (1 + similarity)) / pi
    hit = sum(comb(width, k) * p**k * (1 - p) ** (width - k) for k in range(RADIUS + 1))
    return width, ceil(log(1 - recall) / log(1 - hit))


def farthest(bits: int, similarity: float) -> int:
    """Bits of all fingerprints in which a pair at ``similarity`` differs at most, by five deviations."""
    p = acos(2 * similarity / (1 + similarity)) / pi
    return ceil(bits * p + 5 * (bits * p * (1 - p)) ** 0.5)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh64_intdigest(word, 42)
        return out


def shingle_set(words: list[bytes], size: int, hashes: dict) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of ``size`` words, ascending; fewer words are one run, none give none."""
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=n)
    span = min(size, n)
    out = np.full(n - span + 1, span, dtype=np.uint64)
    for k in range(span):
        out = spread(out * ODD + h[k : n - span + 1 + k])
    return np.unique(out)


def shingle_sets(texts: list[str], size: int, hashes: dict, most: int = 300_000) -> list[np.ndarray]:
    if len(hashes) > most:  # a memo only
        hashes.clear()
    return [shingle_set(t.encode("utf-8", "surrogatepass").lower().split(), size, hashes) for t in texts]


def majorities(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of ``sizes`` (none 0) of ``h``, the bits that over half of it has."""
    parts = -(-sizes // 255)  # counts go in byte lanes
    first = np.cumsum(parts) - parts
    place = np.arange(parts.sum()) - np.repeat(first, parts)
    starts = np.repeat(np.cumsum(sizes) - sizes, parts) + 255 * place
    out = np.zeros(len(sizes), dtype=np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & LANES, starts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            out |= (2 * counts[:, byte] > sizes).astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def sketches(sets: list[np.ndarray], families: int) -> np.ndarray:
    """A 64-bit fingerprint per set and family; an empty set has 0."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    out = np.zeros((len(sets), families), dtype=np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        h = np.concatenate(sets)
        for k in range(families):
            out[some, k] = majorities(spread(h ^ SEEDS[k]), sizes[some])
    return out


def parities(sets: list[np.ndarray], lanes: int = 16) -> np.ndarray:
    """``64 * lanes`` bits per set: whether an odd number of its hashes fall there.  Two sets
    differ in as many elements as bits, or more."""
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    h = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    at = of * 64 * lanes + ((h * ODD) >> np.uint64(32)).astype(np.int64) % (64 * lanes)
    odd = np.bincount(at, minlength=len(sets) * 64 * lanes) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(-1, lanes)


def sketched(df: DataFrame, id_col: str, text_col: str, size: int, families: int) -> DataFrame:
    """``(id, key, sketch)`` per row; ``key`` names the shingle set."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        hashes = _Hashes()
        for batch in batches:
            at = 0
            for held in groups(batch.column(1).to_pylist(), 1 << 19):
                sets = shingle_sets(held, size, hashes)
                sketch = sketches(sets, families).view(np.int64)
                keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                offsets = np.arange(0, sketch.size + 1, families, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(held)), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(sketch.ravel()))], names=["id", "key", "sketch"])
                at += len(held)

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, key binary, sketch array<bigint>")


def sets_of(df: DataFrame, id_col: str, text_col: str, wanted: DataFrame, size: int) -> DataFrame:
    """``(key, n, shingles, parity)`` of the rows that ``wanted(id, key)`` names; their texts are read again."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(small(wanted, 200_000), "id").select("key", "text")

    def run(batches):
        hashes = _Hashes()
        for batch in batches:
            at = 0
            for held in groups(batch.column(1).to_pylist(), 1 << 19):
                sets = shingle_sets(held, size, hashes)
                n = np.array([len(s) for s in sets], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64)))
                parity = parities(sets)
                offsets = np.arange(0, parity.size + 1, parity.shape[1], dtype=np.int32)
                parity = pa.ListArray.from_arrays(pa.array(offsets), pa.array(parity.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(held)), pa.array(n), lists, parity], names=["key", "n", "shingles", "parity"])
                at += len(held)

    return rows.mapInArrow(run, "key binary, n int, shingles array<bigint>, parity array<bigint>")


def differing(a: str, b: str):
    """Bits in which two arrays of longs differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def crowd_pairs(sets: DataFrame, roots: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """``(u, v)``, u below v: of ``sets(key, n, shingles, parity)``, what may be at ``similarity``
    and lies in two components of ``roots(node, root)``; no pair at the similarity is missing.

    A prefix join: with shingles rarest first, two sets of n and m that share
    enough share one before place ``at`` in either only if m is at most
    ``(den * n - (num + den) * at) / num``.  Shingles of one text only take up
    the first places and meet nothing, so texts of a crowd that each differ from
    the rest by shingles of their own meet nowhere.  Sizes go in bands, so that what is too large for
    a place never meets it; in a cell (shingle and bands) the texts of its
    largest component meet the others only; and what meets must differ in few
    enough bits of `parities`.
    """
    num, den = similarity
    of = sets.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "n", F.coalesce("root", "key").alias("root"), "shingles")
    held = of.select("key", "n", "root", F.explode("shingles").alias("shingle"))
    often = written(held.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"), "often")
    text = Window.partitionBy("key")
    at = F.col("n") - F.count(F.lit(1)).over(text) + F.row_number().over(text.orderBy("often", "shingle")) - 1
    band = lambda n: F.floor(F.log(n) / F.lit(log(1.1)))
    placed = held.join(often, "shingle").withColumn("upto", F.floor((den * F.col("n") - (num + den) * at) / num))
    placed = placed.withColumn("from", F.ceil(num * F.col("n") / den)).filter("upto >= from")
    placed = placed.withColumn("own", band(F.col("n"))).withColumn("other", F.explode(F.sequence(band(F.col("from")), band(F.col("upto")))))
    cell = ["shingle", "low", "high"]
    placed = written(placed.select("shingle", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "key", "n", "root", "upto"), "placed")
    cells = placed.groupBy(*cell, "root").agg(F.count(F.lit(1)).alias("many")).groupBy(*cell).agg(F.max_by("root", F.struct("many", "root")).alias("top"), F.count(F.lit(1)).alias("roots"))
    met = placed.join(cells.filter("roots > 1").drop("roots"), cell).join(sets.select("key", "parity"), "key")
    met = written(met, "met-in-cells")
    u, v = (met.select(*cell, *[F.col(c).alias(c + k) for c in ("key", "n", "root", "upto", "parity", "top")]) for k in "uv")
    pairs = u.filter("rootu <> topu").join(v, cell).filter("rootu <> rootv AND nv <= uptou AND nu <= uptov")
    pairs = pairs.filter((num + den) * differing("parityu", "parityv") <= (den - num) * (F.col("nu") + F.col("nv")))
    pairs = written(pairs.select(F.least("keyu", "keyv").alias("u"), F.greatest("keyu", "keyv").alias("v")).distinct(), "crowd-pairs")
    drop(often, placed, met)
    return pairs


def near_texts(df: DataFrame, id_col: str, text_col: str = "text", size: int = 5, similarity: tuple[int, int] = (4, 5), recall: float = 0.98, per_wave: int | None = None, crowd: int = 4) -> DataFrame:
    """``(id_col, component_id)`` per row: the smallest id that it reaches over links.

    Links join texts whose sets of ``size``-word shingles are at Jaccard
    ``similarity`` (a fraction) or above and whose fingerprints collide (in at most ``RADIUS`` bits of a family, and `farthest` bits of all); a pair
    at the similarity collides with probability ``recall`` or more, closer pairs
    with more.  No link is left out.  Equal sets are always linked.  Words are apart by ASCII white
    space, A-Z lower-cased.  Texts without words (null, empty) are copies of
    each other.  Ids are distinct, not null and of an orderable type
    (`tables.numbered`), and ``df`` gives the same rows whenever it is read;
    other columns are ignored; an empty table gives an empty result.  Pairs left
    after the rounds are verified about ``per_wave`` at a time (as many as there
    are texts, 100,000 at least); it changes no result.  Texts that meet more
    than ``crowd`` texts of other components in one value are joined with each
    other by their shingles instead (`crowd_pairs`), which finds every pair at the
    similarity, also such whose fingerprints do not collide.
    """
    num, den = similarity
    width, families = plan(df.count(), num / den, recall)
    rows = written(sketched(df, id_col, text_col, size, families), "sketches")
    texts = written(rows.groupBy("key").agg(F.min("id").alias("least"), F.first("sketch").alias("sketch")), "distinct-texts")

    mask = (1 << width) - 1 if width < 64 else -1
    apart = differing("su", "sv")

    def owned(texts: DataFrame, *more: str) -> DataFrame:
        return texts.select("key", *more, F.posexplode("sketch").alias("family", "fp")).withColumn("fp", F.col("fp").bitwiseAND(F.lit(mask).cast("bigint")))

    # how many texts share a text's fingerprints: most in the middle of a group of near copies
    shared = owned(texts).groupBy("family", "fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    common = owned(texts).join(shared, ["family", "fp"]).groupBy("key").agg(F.sum("n").alias("score"))
    scored = written(texts.join(common, "key", "left").select("key", "least", "sketch", F.coalesce("score", F.lit(0)).alias("score")), "scored-texts")
    drop(texts)
    texts = scored

    def met_pairs(texts: DataFrame) -> DataFrame:
        """``(u, v)``, u below v: what texts are to be compared with, all bits of both permitting."""
        owners = owned(texts, "score")
        # one text stands for all of a fingerprint
        heads = owners.groupBy("family", "fp").agg(F.max_by("key", F.struct("score", "key")).alias("head"), F.count(F.lit(1)).alias("n"))
        heads = written(heads, "fingerprints")
        found = links(heads.select("family", "fp"), width=width, least_bits=4, picks=True)
        # buckets know their own values only: of their picks one a turn stays
        picked = found.groupBy("family", "v", "turn").agg(F.min_by("u", F.struct("rank", "u")).alias("u")).select("family", "u", "v").distinct()
        beside = picked.join(heads.select("family", F.col("fp").alias("u"), "head"), ["family", "u"]).select("family", F.col("v").alias("fp"), "head")
        beside = beside.union(heads.filter("n > 1").select("family", "fp", "head"))
        pairs = owners.join(beside, ["family", "fp"]).filter("key <> head").select(F.col("key").alias("u"), F.col("head").alias("v"))
        pairs = near_enough(pairs, texts)
        drop(heads, found)
        return pairs

    def near_enough(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        sides = [texts.select(F.col("key").alias(k), F.col("sketch").alias(f"s{k}")) for k in "uv"]
        pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        return written(pairs.join(sides[0], "u").join(sides[1], "v").filter(apart <= farthest(64 * families, num / den)).select("u", "v"), "pairs")

    def pairs_across(roots: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``(u, v)``, u below v: all that collide in any family and lie in two components, all
        bits of both permitting, but for pairs of two crowded texts; and ``(key)`` of these."""
        labels = written(roots.select("root").distinct().select("root", (F.monotonically_increasing_id() + 1).alias("label")), "labels")
        of = texts.join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key")).join(labels, "root", "left")
        # texts on their own have label 0, which differs from all
        owners = written(owned(of.select("key", "sketch", F.coalesce("label", F.lit(0)).alias("label")), "label"), "owners")
        held = written(owners.groupBy("family", "fp", "label").agg(F.count(F.lit(1)).alias("n")), "fingerprints")
        heads = held.groupBy("family", "fp").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum("n").alias("n"))
        found = links(heads.select("family", "fp", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(0).alias("label"), "n"), width=width, least_bits=4, labelled=True, crowd=crowd)
        one = heads.filter("n > 1 AND (lo <> hi OR lo = 0)").select("family", F.col("fp").alias("u"), F.col("fp").alias("v"), "n")
        packed = found.filter("u = v").union(one.filter(F.col("n") > crowd + 1).drop("n")).select("family", F.col("u").alias("fp")).distinct()
        packed = written(owners.join(packed, ["family", "fp"]).select("key").distinct(), "crowded")
        one = one.filter(F.col("n") <= crowd + 1).drop("n")
        a, b = (held.select("family", F.col("fp").alias(k), F.col("label").alias(f"l{k}")) for k in "uv")
        meet = found.filter("u <> v").union(one).join(a, ["family", "u"]).join(b, ["family", "v"]).filter("(lu <> lv OR lu = 0) AND (u <> v OR lu <= lv)")
        a, b = (owners.select("family", F.col("fp").alias(k), F.col("label").alias(f"l{k}"), F.col("key").alias(f"k{k}")) for k in "uv")
        pairs = meet.join(a, ["family", "u", "lu"]).join(b, ["family", "v", "lv"]).filter("ku <> kv").select(F.col("ku").alias("u"), F.col("kv").alias("v"))
        pairs = near_enough(pairs, texts)
        drop(labels, owners, held, found)
        return pairs, packed

    pairs = met_pairs(texts)
    tidy(df.sparkSession)
    both = pairs.select(F.col("u").alias("key")).union(pairs.select(F.col("v").alias("key"))).distinct()
    meeting = written(texts.join(both, "key"), "meeting")
    sets = written(sets_of(df, id_col, text_col, meeting.select(F.col("least").alias("id"), "key"), size), "shingle-sets")

    def alike(pairs: DataFrame) -> DataFrame:
        u, v = (sets.select(F.col("key").alias(k), F.col("n").alias(f"n{k}"), F.col("shingles").alias(f"s{k}")) for k in "uv")
        shared = F.size(F.array_intersect("su", "sv"))
        near = pairs.join(u.hint("merge"), "u").join(v.hint("merge"), "v")
        return written(near.filter((num + den) * shared >= num * (F.col("nu") + F.col("nv"))).select("u", "v"), "alike")

    def across_yet(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        u, v = (roots.select(F.col("node").alias(k), F.col("root").alias(f"r{k}")) for k in "uv")
        return pairs.join(u, "u", "left").join(v, "v", "left").filter(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v")

    # each text with the least of its partners first; then the partners that this leaves in other components
    edges = [alike(pairs.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"))]
    roots = components.labels(edges[0])
    edges.append(alike(across_yet(pairs, roots)))
    while True:
        # components shrink to the text of the highest score; with these, what has met others without a link meets again
        drop(roots)
        all_ = reduce(DataFrame.union, edges)
        roots = components.labels(all_)
        named = meeting.join(roots, F.col("key") == F.col("node"), "left")
        left = named.groupBy(F.coalesce("root", "key").alias("root")).agg(F.max(F.struct("score", "key", "sketch")).alias("top"))
        left = written(left.select("top.*"), "left")
        again = met_pairs(left)
        edges.append(alike(again.join(pairs, ["u", "v"], "left_anti")))
        drop(again, left)
        tidy(df.sparkSession)
        if edges[-1].isEmpty():
            break

    # what has met in any family and is still apart: crowds by their shingles, every other pair
    # laid out; in waves, so that disk stays in proportion to the texts
    rest, packed = pairs_across(roots)
    both = rest.select(F.col("u").alias("key")).union(rest.select(F.col("v").alias("key"))).union(packed).distinct()
    unread = written(texts.join(both.join(meeting, "key", "left_anti"), "key").select(F.col("least").alias("id"), "key"), "unread")
    if not both.isEmpty():
        held, more = sets, written(sets_of(df, id_col, text_col, unread, size), "shingle-sets")
        sets = held.union(more)
        parts = [rest] if packed.isEmpty() else [crowd_pairs(sets.join(packed, "key"), roots, similarity), rest]
        for part in parts:
            waves = ceil(part.count() / (per_wave or max(100_000, texts.count())))
            for k in range(waves):
                wave = across_yet(part, roots).filter(F.pmod(F.xxhash64("u", "v"), F.lit(waves)) == k)
                edges.append(alike(wave))
                if not edges[-1].isEmpty():
                    drop(roots)
                    roots = components.labels(reduce(DataFrame.union, edges))
                tidy(df.sparkSession)
        drop(held, more, *parts)

    of = texts.select("key", "least").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    out = written(rows.select("id", "key").join(of.join(least, "root").select("key", "component_id"), "key").select(F.col("id").alias(id_col), "component_id"), "near-texts")
    drop(rows, texts, pairs, meeting, sets, rest, packed, unread, roots, *edges)
    tidy(df.sparkSession)
    return out
