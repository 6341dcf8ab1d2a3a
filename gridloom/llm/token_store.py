"""Token ids in a content-addressed store.

Texts become id streams; a rolling hash over the last ids cuts each stream
into chunks where its content says so, so equal passages give equal chunks.
A chunk is kept once under the digest of its ids; a document is a recipe of
chunk digests, folded pairwise (Merkle) into the document's root.  A document's
leaf binds its root to its id, size and start; leaves in document order are
folded in runs of ``RUN``, those again, up to one root for the whole store.
Its shape depends on the documents alone, not on partitions or batches.

Files (Parquet, one folder each under the store's path):

``objects/kind=chunk``   ``key`` digest, ``n`` ids, ``data`` the ids (16 or 32 bits, zstd)
``recipes/kind=recipe``  in ascending id order: ``part, place, doc_id, start`` (ids before it in its part), ``n, root, refs`` (digests, 16 bytes each), ``sizes``
``recipes/kind=part``    per part: ``place`` documents and ``n`` ids
``manifest/level=k``     ``run, root, docs, ids`` of each run of level k; the last level has one row, the store's root
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytebpe import PRETOKENS, blocks, byte_symbols, groups, plain_spaced, ranks
from .tables import written

#: Chunk sizes in ids: none below ``LEAST`` (but a document's last) or above ``MOST``; about ``LEAST + MEAN`` in between.
LEAST, MEAN, MOST, REACH = 256, 1024, 8192, 24
DIGEST = 16
#: Digests folded into one of the next level.
RUN = 4096


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a list of digests; an odd one is carried up as it is, no leaf is the digest of nothing."""
    if not leaves:
        return digest(b"")
    while len(leaves) > 1:
        up = [digest(b"\1" + leaves[k] + leaves[k + 1]) for k in range(0, len(leaves) - 1, 2)]
        leaves = up + leaves[len(leaves) - len(leaves) % 2 :]
    return leaves[0]


@functools.lru_cache(maxsize=1)
def _hash_tables(size: int = 1 << 17):
    rng = np.random.default_rng(31)
    odd = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    return rng.integers(0, 2**63, size).astype(np.uint64), odd, inverse


@functools.lru_cache(maxsize=1)
def _powers(n: int = 1 << 16):
    _, odd, inverse = _hash_tables()
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, odd, dtype=np.uint64)), np.cumprod(np.full(n, inverse, dtype=np.uint64))


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks.  A cut may follow id i where the polynomial hash of
    the last ``REACH`` ids, sum of g[id_j] * B^(i - j), has its top bits zero."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    g, _, _ = _hash_tables()
    up, down = _powers()
    size, may = len(up), []
    for k in range(0, n, size - REACH):  # long streams a window at a time
        part = ids[max(0, k - REACH) : k + size - REACH]
        lead = k - max(0, k - REACH)
        total = np.cumsum(g[part & (len(g) - 1)] * down[: len(part)])
        rolled = total * up[: len(part)]
        rolled[REACH:] -= total[:-REACH] * up[REACH : len(part)]
        hit = np.flatnonzero(rolled < np.uint64(1 << (64 - MEAN.bit_length() + 1)))
        may.append(hit[hit >= lead] - lead + k + 1)
    out, last = [], 0
    for c in np.concatenate(may).tolist():
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= LEAST and c < n:
            out.append(c)
            last = c
    while n - last > MOST:
        last += MOST
        out.append(last)
    return [*out, n]


@functools.lru_cache(maxsize=1)
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """One of each a process: setting them up costs more than most chunks."""
    return zstandard.ZstdCompressor(level=3, write_checksum=False), zstandard.ZstdDecompressor()


def pack(ids: np.ndarray) -> bytes:
    """Ids as zstd-compressed little-endian integers, 16 bits where they fit; the first byte tells the width."""
    narrow = not len(ids) or int(ids.max()) < 1 << 16
    raw = ids.astype("<u2" if narrow else "<u4").tobytes()
    return (b"\2" if narrow else b"\4") + _zstd()[0].compress(raw)


def unpack(data: bytes) -> np.ndarray:
    raw = _zstd()[1].decompress(memoryview(data)[1:])
    return np.frombuffer(raw, dtype="<u2" if data[:1] == b"\2" else "<u4").astype("<u4")


class Words(dict):
    """Ids (little-endian 32-bit) of units that no pre-token crosses, asked of ``solve`` once.

    Full, the memo becomes the old one, which is looked up before asking again:
    what is in use stays, and ids never depend on it.
    """

    def __init__(self, solve, lead: str, most: int = 480_000):
        self.solve, self.lead, self.most, self.old = solve, lead, most, {}
        self.marks = {c: solve(c) for c in ".,"}

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        ids = self.old.pop(unit, None)
        if ids is None:
            # a word and its full stop or comma are two pre-tokens
            ids = self[unit[:-1]] + self.marks[unit[-1]] if unit[-1:] in self.marks and unit[:-1].isalpha() else self.solve(self.lead + unit)
        self[unit] = ids
        return ids


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> tuple[Words, Words, dict, re.Pattern | None]:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    ranks(path)  # checks that the file is a plain byte-level one
    lib = Tokenizer.from_file(path)
    special = {t.content: np.uint32(k).astype("<u4").tobytes() for k, t in lib.get_added_tokens_decoder().items()}
    symbols = {k: c for k, c in enumerate(byte_symbols())}
    tokenize, space = lib.model.tokenize, byte_symbols()[32]

    def solve(unit: str) -> bytes:
        """The library's model on each pre-token (its `encode` costs several times as much on short strings)."""
        word = unit[1:].isalpha() and (unit[0] == " " or unit[0].isalpha())
        if word and unit.isascii():
            return array("I", [x.id for x in tokenize(space + unit[1:] if unit[0] == " " else unit)]).tobytes()
        out = []
        for t in [unit] if word else PRETOKENS.findall(unit):
            text = (space + t[1:] if t[0] == " " else t) if t.isascii() and t.isprintable() and " " not in t[1:] else t.encode().decode("latin-1").translate(symbols)
            out += [x.id for x in tokenize(text)]
        return array("I", out).tobytes()

    split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
    return Words(solve, " "), Words(solve, "", most=60_000), special, split


def ids_of(texts: list[str], tokenizer: str) -> list[bytes]:
    """Ids of texts by the tokenizers library, as little-endian 32-bit integers.

    A text is cut into words with the one space before them; a word with a
    newline before it, the first word and texts with other white space stand as they are.
    """
    spaced, bare, special, split = _encoder(tokenizer)
    out = []
    for text in texts:
        ids = []
        for k, part in enumerate(split.split(text) if split and any(s in text for s in special) else [text]):
            if k % 2:
                ids.append(special[part])
                continue
            for block in blocks(part):
                lead = block[:1] == " "
                body = block[1:] if lead else block
                if plain_spaced(body):
                    lines = body.split("\n")
                    for j, line in enumerate(lines):
                        units = line.split(" ")
                        if j or not lead:
                            ids.append(bare["\n" + units[0] if j else units[0]])
                            del units[0]
                        ids += map(spaced.__getitem__, units)
                else:
                    ids += [bare[t] for t in PRETOKENS.findall(block)]
        out.append(b"".join(ids))
    return out


def write_store(df: DataFrame, path: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id``, and write the store at ``path`` (a shared folder).

    A null text is an empty one.  Documents are in ascending id order, null ids
    first, repeated ids in the order of their rows; every row is a document.
    Chunks shuffle by digest with one copy a task, recipes (digests only) by
    range of the id.
    """
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tail = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        sent: set[bytes] = set()
        for batch in batches:
            row, doc, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            for held in groups(batch.column(2).to_pylist()):
                out = []
                for raw in ids_of(held, tokenizer):
                    ids, last, refs, sizes = np.frombuffer(raw + tail, dtype="<u4"), 0, [], []
                    for c in cuts(ids):
                        piece = ids[last:c]
                        name = digest(piece.tobytes())
                        refs.append(name)
                        sizes.append(c - last)
                        last = c
                        if name not in sent:
                            if len(sent) > 200_000:  # a memo only: copies sent twice meet in the shuffle
                                sent.clear()
                            sent.add(name)
                            out.append(("chunk", name, None, len(piece), pack(piece), None))
                    out.append(("recipe", row[at].to_bytes(8, "big"), doc[at], len(ids), b"".join(refs), sizes))
                    at += 1
                cols = list(zip(*out))
                kinds = [pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["kind", "key", "doc_id", "n", "data", "sizes"])

    objects = rows.mapInArrow(run, "kind string, key binary, doc_id bigint, n bigint, data binary, sizes array<int>")
    objects.dropDuplicates(["kind", "key"]).write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/objects")

    spark = df.sparkSession
    recipes = _read(spark, f"{path}/objects", "kind string, key binary, doc_id bigint, n bigint, data binary, sizes array<int>").filter("kind = 'recipe'")
    ordered = recipes.select("doc_id", "key", "n", F.col("data").alias("refs"), "sizes").repartitionByRange(F.asc_nulls_first("doc_id"), F.col("key")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "key")

    def place(batches):
        part, at, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            refs = batch.column(3).to_pylist()
            n = batch.column(2).to_numpy()
            starts = start + np.cumsum(n) - n
            m = len(refs)
            yield pa.RecordBatch.from_arrays([pa.array(["recipe"] * m), pa.array([part] * m, pa.int32()), pa.array(np.arange(at, at + m)), batch.column(0), pa.array(starts), batch.column(2), pa.array([root_of(r) for r in refs], pa.binary()), batch.column(3), batch.column(4)], names=names)
            at, start = at + m, start + int(n.sum())
        if at:
            yield pa.RecordBatch.from_arrays([pa.array(["part"]), pa.array([part], pa.int32()), pa.array([at]), pa.array([None], pa.int64()), pa.array([0]), pa.array([start]), pa.array([b""]), pa.array([b""]), pa.array([[]], pa.list_(pa.int32()))], names=names)

    names = ["kind", "part", "place", "doc_id", "start", "n", "root", "refs", "sizes"]
    ordered.mapInArrow(place, RECIPES).write.partitionBy("kind").parquet(f"{path}/recipes")
    level, runs = 0, _leaves(_placed(spark, path))
    while True:
        level += 1
        runs = _runs(runs)
        runs.write.parquet(f"{path}/manifest/level={level}")
        runs = spark.read.schema(MANIFEST).parquet(f"{path}/manifest/level={level}")
        if runs.limit(2).count() < 2:
            break


RECIPES = "kind string, part int, place bigint, doc_id bigint, start bigint, n bigint, root binary, refs binary, sizes array<int>"
MANIFEST = "run bigint, root binary, docs bigint, ids bigint"


def root_of(refs: bytes) -> bytes:
    """A document's root from its references."""
    return merkle([refs[k : k + DIGEST] for k in range(0, len(refs), DIGEST)])


def _leaves(documents: DataFrame) -> DataFrame:
    """A run of level 0 per document: the digest of its root, id, size and start."""

    def run(batches):
        for b in batches:
            cols = zip(*(b.column(k).to_pylist() for k in range(5)))
            leaf = [digest(b"\0" + root + b"".join((-1 << 63 if v is None else v).to_bytes(8, "big", signed=True) for v in (i, start, n))) for _, i, start, n, root in cols]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(leaf, pa.binary()), pa.array([1] * len(leaf), pa.int64()), b.column(3)], names=["run", "root", "docs", "ids"])

    return documents.select("position", "doc_id", "start", "n", "root").mapInArrow(run, MANIFEST)


def _runs(below: DataFrame) -> DataFrame:
    """Runs of the next level: ``RUN`` digests in order folded into one."""
    held = F.array_sort(F.collect_list(F.struct("run", "root")))
    many = below.groupBy(F.floor(F.col("run") / RUN).cast("bigint").alias("run")).agg(held.alias("held"), F.sum("docs").alias("docs"), F.sum("ids").alias("ids"))

    def fold(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([merkle([x["root"] for x in h]) for h in b.column(1).to_pylist()], pa.binary()), b.column(2), b.column(3)], names=["run", "root", "docs", "ids"])

    return many.mapInArrow(fold, MANIFEST)


def store_root(spark: SparkSession, path: str) -> tuple[bytes, int, int]:
    """``(root, documents, ids)`` of the store as its manifest has it."""
    levels = spark.read.schema(MANIFEST + ", level int").parquet(f"{path}/manifest")
    top = levels.orderBy(F.desc("level"), "run").first()
    return (bytes(top["root"]), top["docs"], top["ids"]) if top else (merkle([]), 0, 0)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """``(part, place, doc_id, start, n, root, ids array<int>)``: every document
    rebuilt from its chunks; ``start`` counts the ids of all documents before it.
    A missing chunk, or one of another size than the recipe says, raises."""
    return _documents(spark, path).drop("pieces").withColumn("ids", _joined(F.col("ids")))


def _joined(pieces):
    return F.flatten(pieces)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with their ``position`` and ``start`` in the whole store."""
    table = _read(spark, f"{path}/recipes", RECIPES)
    parts = table.filter("kind = 'part'").select("part", "place", "n")  # one row a part
    upto = Window.orderBy("part")
    before = parts.select("part", (F.sum("n").over(upto) - F.col("n")).alias("ids"), (F.sum("place").over(upto) - F.col("place")).alias("docs"))
    recipes = table.filter("kind = 'recipe'").drop("kind")
    placed = recipes.join(F.broadcast(before), "part", "left").withColumn("start", F.col("start") + F.coalesce("ids", F.lit(0)))
    return placed.withColumn("position", F.col("place") + F.coalesce("docs", F.lit(0))).drop("ids", "docs")


def _documents(spark: SparkSession, path: str) -> DataFrame:
    recipes = _placed(spark, path)
    chunks = _read(spark, f"{path}/objects", "kind string, key binary, n bigint, data binary").filter("kind = 'chunk'").select("key", "data")

    def open_(batches):
        for batch in batches:
            ids = [unpack(d) for d in batch.column(1).to_pylist()]
            for name, x in zip(batch.column(0).to_pylist(), ids):
                if digest(x.tobytes()) != name:
                    raise ValueError(f"chunk {name.hex()} does not hold what its name says")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype("<i4").tolist() for x in ids], pa.list_(pa.int32()))], names=["key", "piece"])

    opened = chunks.mapInArrow(open_, "key binary, piece array<int>")
    refs = recipes.select("part", "place", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("sizes") - 1), lambda k: F.substring("refs", k * DIGEST + 1, F.lit(DIGEST)))).alias("k", "key")).filter(F.length("key") > 0)
    rebuilt = refs.join(opened, "key", "left").groupBy("part", "place").agg(F.array_sort(F.collect_list(F.struct("k", "piece"))).alias("pieces"))
    out = recipes.join(rebuilt, ["part", "place"], "left")
    whole = F.transform(F.coalesce("pieces", F.array().cast("array<struct<k:int,piece:array<int>>>")), lambda p: F.coalesce(F.size(p["piece"]), F.lit(-1))) == F.coalesce("sizes", F.array().cast("array<int>"))
    pieces = F.coalesce(F.transform("pieces", lambda p: p["piece"]), F.array().cast("array<array<int>>"))
    return out.withColumn("ids", F.when(whole, pieces).otherwise(F.raise_error(F.lit("a chunk is missing or has another size than its recipe says")).cast("array<array<int>>")))


# --- documents' digests from the files without moving their ids


@functools.lru_cache(maxsize=1)
def _shift_tables() -> np.ndarray:
    """For each power of two, four 256-entry tables that advance a crc32 over that many zero bytes."""

    def times(m, v):
        out = np.zeros_like(v)
        for k in range(32):
            out ^= np.where((v >> np.uint32(k)) & 1, m[k], 0).astype(np.uint32)
        return out

    one = np.array([0xEDB88320] + [1 << k for k in range(31)], dtype=np.uint32)  # one zero bit
    for _ in range(3):
        one = times(one, one)
    tables = []
    for _ in range(44):
        byte = np.arange(256, dtype=np.uint32)
        tables.append([times(one, byte << np.uint32(8 * k)) for k in range(4)])
        one = times(one, one)
    return np.array(tables)


def crc_join(a: np.ndarray, b: np.ndarray, b_bytes: np.ndarray) -> np.ndarray:
    """crc32 of texts A + B from crc32(A), crc32(B) and B's length."""
    a, tables = a.astype(np.uint32), _shift_tables()
    for k in range(44):
        on = (b_bytes >> k) & 1 == 1
        if on.any():
            x = a[on]
            a[on] = tables[k][0][x & 255] ^ tables[k][1][x >> 8 & 255] ^ tables[k][2][x >> 16 & 255] ^ tables[k][3][x >> 24]
    return a ^ b.astype(np.uint32)


def verify_store(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, root)`` of every document, read back and verified.

    Every chunk is read, checked against its name, and its crc32 and size
    taken; a document's crc32 follows from its chunks' in recipe order, its
    root from its references.  Ids never leave the task that reads them: only
    names, sizes and checksums shuffle.  A wrong chunk, a missing chunk, a
    recipe that does not add up to its root or size, or documents that do not
    fold to the manifest's root (one lost, doubled, moved or changed) raise.
    """
    recipes = _placed(spark, path)
    chunks = _read(spark, f"{path}/objects", "kind string, key binary, n bigint, data binary").filter("kind = 'chunk'").select("key", "data")

    def sums(batches):
        for batch in batches:
            crc, n = [], []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = unpack(data).tobytes()
                if digest(raw) != name:
                    raise ValueError(f"chunk {name.hex()} does not hold what its name says")
                crc.append(zlib.crc32(raw))
                n.append(len(raw) // 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc, pa.int64()), pa.array(n, pa.int64())], names=["key", "crc", "size"])

    known = chunks.mapInArrow(sums, "key binary, crc bigint, size bigint")
    refs = recipes.filter(F.size("sizes") > 0).select("part", "place", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("sizes") - 1), lambda k: F.substring("refs", k * DIGEST + 1, F.lit(DIGEST)))).alias("k", "key"))
    found = refs.join(known, "key", "left").groupBy("part", "place").agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("crc", F.lit(-1)).alias("crc"), F.coalesce("size", F.lit(-1)).alias("size")))).alias("got"))
    both = recipes.join(found, ["part", "place"], "left").select("doc_id", "start", "n", "root", "refs", "position", F.coalesce(F.transform("got", lambda g: g["crc"]), F.array().cast("array<bigint>")).alias("crcs"), F.coalesce(F.transform("got", lambda g: g["size"]), F.array().cast("array<bigint>")).alias("sizes"))

    def fold(batches):
        for batch in batches:
            refs, crcs, sizes, n, roots = (batch.column(k).to_pylist() for k in (4, 6, 7, 2, 3))
            for r, c, s, m, root in zip(refs, crcs, sizes, n, roots):
                if len(c) * DIGEST != len(r) or -1 in c or sum(s) != m or root_of(r) != root:
                    raise ValueError("a recipe does not add up to its document")
            crc = np.zeros(len(refs), dtype=np.uint32)
            for k in range(max(map(len, crcs), default=0)):  # the k-th chunk of all documents at once
                at = np.array([i for i, c in enumerate(crcs) if len(c) > k])
                crc[at] = crc_join(crc[at], np.array([crcs[i][k] for i in at]), np.array([4 * sizes[i][k] for i in at]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc.astype(np.int64)), batch.column(3), batch.column(5)], names=["doc_id", "start", "n", "ids_crc32", "root", "position"])

    checked = written(both.mapInArrow(fold, "doc_id bigint, start bigint, n bigint, ids_crc32 bigint, root binary, position bigint"), "verified")
    want, runs = store_root(spark, path), _runs(_leaves(checked))
    while True:
        runs = written(runs, "runs")
        if runs.limit(2).count() < 2:
            break
        runs = _runs(runs)
    got = runs.first()
    parts = _read(spark, f"{path}/recipes", RECIPES).filter("kind = 'part'").agg(F.sum("place").alias("docs"), F.sum("n").alias("ids")).first()
    if (parts["docs"] or 0, parts["ids"] or 0) != want[1:] or (bytes(got["root"]), got["docs"], got["ids"]) != want if got else want[1]:
        raise ValueError("the documents do not fold to the store's root")
    return checked.select("doc_id", "start", F.col("n").alias("n_tokens"), "ids_crc32", "root")
