"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces of a SentencePiece file go into a double-array trie over UTF-8
bytes; the best path by summed log scores is found for all new units of a
batch at once, one numpy step per (start, trie depth).  Characters without a
piece fall back to byte pieces.  Decoding turns whitespace marks into spaces
and byte pieces into characters.  No shuffle: one narrow pass each way.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import groups

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNKNOWN_PENALTY = 10.0


def _fields(raw: bytes):
    """(number, value) of a protocol-buffer message; nested messages stay bytes."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, raw[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[kind]
            yield tag >> 3, raw[at : at + n]
            at += n


class DoubleArray:
    """Trie in two arrays: from node s by byte c to t = base[s] + c + 1 where check[t] = s."""

    def __init__(self, keys: list[bytes]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        size = 4 * sum(map(len, keys)) + 70_000
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        stack, free, hint = [(0, 0, len(order), 0)], 512, 512
        while stack:
            node, lo, hi, depth = stack.pop()
            while lo < hi and len(keys[order[lo]]) == depth:
                self.value[node] = order[lo]
                lo += 1
            if lo == hi:
                continue
            kids, k = [], lo
            while k < hi:
                c, first = keys[order[k]][depth], k
                while k < hi and keys[order[k]][depth] == c:
                    k += 1
                kids.append((c + 1, first, k))
            while used[free]:
                free += 1
            slot = max(free, hint) if len(kids) > 1 else free
            while True:
                b = slot - kids[0][0]
                if b >= 0 and not any(used[b + c] for c, _, _ in kids):
                    break
                slot += 1
            if len(kids) > 1:  # crowded space behind is not searched again; lone children fill it
                hint = max(hint, slot - 64)
            self.base[node] = b
            for c, first, last in kids:
                used[b + c] = 1
                self.check[b + c] = node
                stack.append((b + c, first, last, depth + 1))
        top = int(np.flatnonzero(self.check >= 0).max(initial=0)) + 300
        self.base, self.check, self.value = self.base[:top].copy(), self.check[:top].copy(), self.value[:top].copy()


@dataclass
class Model:
    pieces: list[str]
    scores: np.ndarray  # float32
    kinds: list[int]
    trie: DoubleArray
    unknown: int
    byte_ids: np.ndarray
    dummy_prefix: bool
    cut_newline: bool

    @property
    def floor(self) -> np.float32:
        normal = [s for s, k in zip(self.scores.tolist(), self.kinds) if k == NORMAL]
        return np.float32(min(normal) - UNKNOWN_PENALTY)


def load(path: str) -> Model:
    """Read a SentencePiece file.  Scores of a unigram file are its log scores;
    a BPE file has merge ranks instead, which get the log scores of Zipf's law,
    ``-log(1 + rank) - log(sum of 1 / (1 + rank))``."""
    with open(path, "rb") as f:
        raw = f.read()
    pieces, scores, kinds, kind, prefix = [], [], [], 1, True
    for n, v in _fields(raw):
        if n == 1:
            piece = dict(_fields(v))
            pieces.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            kinds.append(piece.get(3, NORMAL))
        elif n == 2:
            kind = dict(_fields(v)).get(3, 1)
        elif n == 3:
            spec = dict(_fields(v))
            prefix = bool(spec.get(3, 1))
            if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                raise ValueError(f"{path}: only the identity normaliser is supported")
    return build(pieces, scores, kinds, kind, prefix)


def build(pieces: list[str], scores: list[float], kinds: list[int], kind: int = 1, dummy_prefix: bool = True) -> Model:
    score = np.array(scores, dtype=np.float64)
    normal = np.array([k == NORMAL for k in kinds])
    if kind == 2:
        rank = np.maximum(-score, 0)
        score = np.where(normal, -np.log1p(rank) - np.log((1 / (1 + rank[normal])).sum()), score)
    elif kind != 1:
        raise ValueError("neither a unigram nor a BPE file")
    score = score.astype(np.float32)
    top = score[normal].max() if normal.any() else np.float32(0)
    for k, p in enumerate(pieces):  # a user-defined piece always wins over its parts
        if kinds[k] == USER:
            score[k] = np.float32(len(p.encode()) * float(top) - 0.1)
    members = [k for k, t in enumerate(kinds) if t in (NORMAL, USER)]
    trie = DoubleArray([pieces[k].encode() for k in members])
    trie.value = np.where(trie.value >= 0, np.array([*members, -1], dtype=np.int32)[trie.value], -1).astype(np.int32)
    bytes_ = {int(p[3:5], 16): k for k, p in enumerate(pieces) if kinds[k] == BYTE}
    unknown = next((k for k, t in enumerate(kinds) if t == UNKNOWN), 0)
    if any(MARK in p.lstrip(MARK) for p in (pieces[k] for k in members)):
        raise ValueError("pieces with a whitespace mark after other characters are not supported")
    return Model(pieces, score, kinds, trie, unknown, np.array([bytes_.get(b, unknown) for b in range(256)], dtype=np.int32), dummy_prefix, not any("\n" in pieces[k] for k in members))


def viterbi(model: Model, units: list[bytes]) -> list[bytes]:
    """Piece ids (little-endian int32) of each unit's best path; equal sums keep the path found first (its last piece starts further left)."""
    out: list[bytes] = [b""] * len(units)
    order = sorted(range(len(units)), key=lambda k: len(units[k]))
    k = 0
    while k < len(order):
        j = k + 1
        longest = max(len(units[order[k]]) * 5 // 4, 12)
        while j < len(order) and j - k < 10_000 and len(units[order[j]]) <= longest:
            j += 1
        part = order[k:j]
        for i, ids in zip(part, _viterbi([units[i] for i in part], model)):
            out[i] = ids
        k = j
    return out


def _viterbi(units: list[bytes], model: Model) -> list[bytes]:
    n, width = len(units), max(map(len, units))
    size = np.array([len(u) for u in units])
    text = np.frombuffer(b"".join(u.ljust(width, b"\0") for u in units), dtype=np.uint8).reshape(n, width).astype(np.int32)
    best = np.full((width + 1, n), -np.inf, dtype=np.float32)
    start, piece = np.zeros((width + 1, n), dtype=np.int32), np.full((width + 1, n), -1, dtype=np.int32)
    best[0] = 0
    base, check, value, score, floor = model.trie.base, model.trie.check, model.trie.value, model.scores, model.floor
    lead = np.where(text < 0x80, 1, np.where(text >= 0xF0, 4, np.where(text >= 0xE0, 3, np.where(text >= 0xC0, 2, 0))))
    for s in range(width):
        rows = np.flatnonzero((size > s) & (best[s] > -np.inf))
        if not len(rows):
            continue
        here, char = best[s][rows], lead[rows, s]
        node, single = np.zeros(len(rows), dtype=np.int32), np.zeros(len(rows), dtype=bool)
        live = np.arange(len(rows))
        for at in range(s, width):
            ok = size[rows[live]] > at
            live, node = live[ok], node[ok]
            to = base[node] + text[rows[live], at] + 1
            ok = (to < len(check)) & (check[np.minimum(to, len(check) - 1)] == node)
            live, node = live[ok], to[ok]
            if not len(live):
                break
            ends = value[node]
            hit = ends >= 0
            if hit.any():
                who, ids = live[hit], ends[hit]
                total = here[who] + score[ids]
                single[who] |= char[who] == at + 1 - s
                better = total > best[at + 1, rows[who]]
                to_rows = rows[who[better]]
                best[at + 1, to_rows], start[at + 1, to_rows], piece[at + 1, to_rows] = total[better], s, ids[better]
        bare = np.flatnonzero(~single & (char > 0))
        if len(bare):
            end = np.minimum(s + char[bare], size[rows[bare]])
            total = here[bare] + floor
            better = total > best[end, rows[bare]]
            e, r = end[better], rows[bare[better]]
            best[e, r], start[e, r], piece[e, r] = total[better], s, -1
    # walk all best paths back together, then lay the ids out by unit and start
    rows, at, steps = np.arange(n), size.copy(), []
    while len(rows):
        s = start[at, rows]
        steps.append((rows, s.astype(np.int64), at, piece[at, rows]))
        left = s > 0
        rows, at = rows[left], s[left].astype(np.int64)
    row, s, e, p = (np.concatenate([x[k] for x in steps]) for k in range(4))
    order = np.lexsort((s, row))
    row, s, e, p = row[order], s[order], e[order], p[order]
    many = np.where(p < 0, e - s, 1)
    first = np.cumsum(many) - many
    flat = np.repeat(p, many)
    fall = np.flatnonzero(flat < 0)
    of = np.repeat(np.arange(len(p)), many)[fall]
    flat[fall] = model.byte_ids[text[row[of], s[of] + fall - first[of]]]
    raw = flat.astype("<i4").tobytes()
    ends = (4 * np.cumsum(np.bincount(row, weights=many, minlength=n))).astype(np.int64).tolist()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]


class Encoder:
    """Ids of texts by a bounded memo of units; a full memo starts again."""

    def __init__(self, model: Model, most: int = 300_000):
        self.model, self.most, self.memo = model, most, {}

    def units(self, text: str) -> list[str]:
        """Runs that no piece crosses: a word with the spaces before it, cut again before newlines where no piece has one."""
        text = text.replace(MARK, " ")
        if not text:
            return []
        if self.model.dummy_prefix and self.model.cut_newline:
            units = text.replace("\n", " \n").split(" ")
            if "" not in units:
                return units
        return ["\0" + u for u in re.findall(r" *[^ ]+| +", (" " if self.model.dummy_prefix else "") + text)]

    def batch(self, texts: list[str]) -> list[bytes]:
        if len(self.memo) > self.most:
            self.memo.clear()
        memo, plans, new = self.memo, [self.units(t) for t in texts], set()
        for units in plans:
            new.update([u for u in units if u not in memo])
        if new:
            new = list(new)
            # "\0x" stands for x itself, "\nx" for itself, any other for " x"
            whole = [u[1:] if u[0] == "\0" else u if u[0] == "\n" else " " + u for u in new]
            memo.update(zip(new, viterbi(self.model, [w.replace(" ", MARK).encode("utf-8", "replace") for w in whole])))
        get = memo.__getitem__
        return [b"".join(map(get, units)) for units in plans]


def _table(model: Model) -> list[bytes]:
    of = {CONTROL: lambda p: b"", UNKNOWN: lambda p: " ⁇ ".encode(), BYTE: lambda p: bytes([int(p[3:5], 16)])}
    return [of.get(k, lambda p: p.replace(MARK, " ").encode())(p) for p, k in zip(model.pieces, model.kinds)]


def decode_ids(model: Model, table: list[bytes], ids: list[int]) -> str:
    """Text of ids: marks are spaces, byte pieces are bytes (invalid runs read as U+FFFD), the dummy prefix goes."""
    out = b"".join([table[k] for k in ids]).decode("utf-8", "replace")
    return out[1:] if model.dummy_prefix and out[:1] == " " else out


def _chunks(array: pa.Array, size: int = 1 << 22):
    at = 0
    for held in groups(array.to_pylist(), size):
        yield at, held
        at += len(held)


def encode(df: DataFrame, model_file: str, text_col: str = "text", keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """Kept columns and ``ids array<int>, n_pieces bigint, ids_crc32 bigint`` of every whole text.

    With ``decoded`` the ids are decoded again in the same task:
    ``n_chars bigint`` of the decoded text, and ``round_trip``, whether it is
    the text (marks as spaces).

    ``ids_crc32`` is the unsigned crc32 of the ids as little-endian 32-bit
    integers.  A null text is an empty one (no ids); repeated rows are kept; a
    mark in a text reads as a space; an empty table gives an empty result.
    """
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    shared = df.sparkSession.sparkContext.broadcast(load(model_file))  # the vocabulary: as large as its file
    rows = df.select(F.col(text_col).cast("string").alias("text"), F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]).alias("kept"))

    def run(batches):
        encoder, table = Encoder(shared.value), _table(shared.value)
        for batch in batches:
            for at, held in _chunks(batch.column(0)):
                raw = encoder.batch(held)
                n = np.array([len(r) // 4 for r in raw], dtype=np.int64)
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), dtype="<i4")))
                cols = [batch.column(1).slice(at, len(held)), ids, pa.array(n), pa.array([zlib.crc32(r) for r in raw], pa.int64())]
                if decoded:
                    back = [decode_ids(shared.value, table, np.frombuffer(r, dtype="<i4").tolist()) for r in raw]
                    cols += [pa.array([len(b) for b in back], pa.int64()), pa.array([b == t.replace(MARK, " ") for b, t in zip(back, held)], pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, names=["kept", "ids", "n_pieces", "ids_crc32", "n_chars", "round_trip"][: len(cols)])

    extra = ["n_chars", "round_trip"] if decoded else []
    out = rows.mapInArrow(run, f"kept {rows.schema['kept'].dataType.simpleString()}, ids array<int>, n_pieces bigint, ids_crc32 bigint" + (", n_chars bigint, round_trip boolean" if decoded else ""))
    return out.select(*[F.col(f"kept.k{i}").alias(c) for i, c in enumerate(keep)], "ids", "n_pieces", "ids_crc32", *extra)


def decode(df: DataFrame, model_file: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Kept columns and ``decoded string``, the text of every row's ids; null ids give an empty text."""
    keep = df.columns if keep is None else keep
    shared = df.sparkSession.sparkContext.broadcast(load(model_file))
    rows = df.select(F.col(ids_col).cast("array<int>").alias("ids"), F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]).alias("kept"))

    def run(batches):
        model = shared.value
        table = _table(model)
        for batch in batches:
            ids, kept = batch.column(0), batch.column(1)
            for at in range(0, len(ids), 256):
                texts = [decode_ids(model, table, x.tolist() if x is not None else []) for x in (v.values.to_numpy() if v.is_valid else None for v in ids.slice(at, 256))]
                yield pa.RecordBatch.from_arrays([kept.slice(at, 256), pa.array(texts)], names=["kept", "decoded"])

    out = rows.mapInArrow(run, f"kept {rows.schema['kept'].dataType.simpleString()}, decoded string")
    return out.select(*[F.col(f"kept.k{i}").alias(c) for i, c in enumerate(keep)], "decoded")
