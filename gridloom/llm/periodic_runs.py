"""Periodic runs of words by recursive frequency splitting.

A run of period q is a maximal stretch of max(6, 4 q) words or more in which
words q apart are equal.  Each of its words stands in it four times at least
(six times where q is 1), so a word that occurs fewer than four times in a
segment lies in no run of the segment and splits it; pieces under six words
hold no run.  Splitting goes on, counts taken anew in the pieces, until
nothing changes.  What survives is scanned by lags: lags under ``NARROW`` in
whole passes, longer ones by blocks.  A run of period q in [b, 2 b) holds a
block of b words that begins at a multiple of b and is repeated q and 2 q
words later, so one comparison of block hashes a level finds every run; each
find is then extended word by word, which settles it exactly.

All of that is array work over a batch of documents at once, in n log n;
documents are dealt over tasks by the scan, and nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .tables import texts_of, with_text

#: A run has ``LEAST`` words at least, and ``TIMES`` times its period.
LEAST, TIMES = 6, 4
#: Lags below are compared one by one.
NARROW = 16


def split_rare(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(at, segment)``: places of the words that may lie in a run, ascending, and the number of the segment of each; equal numbers stand in a row."""
    at, segment = np.arange(len(ids)), doc
    while len(at):
        # words of a segment, counted
        keys = segment.astype(np.int64) * (int(ids.max()) + 1) + ids[at]
        _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
        stay = count[back] >= TIMES
        at_new, seg_new = at[stay], segment[stay]
        # a segment ends where words are missing or the old segment ends
        cut = np.ones(len(at_new), bool)
        cut[1:] = (np.diff(at_new) > 1) | (np.diff(seg_new) != 0)
        seg_new = np.cumsum(cut)
        long = np.bincount(seg_new)[seg_new] >= LEAST
        if stay.all() and long.all():
            return at_new, seg_new
        at, segment = at_new[long], seg_new[long]
    return at, segment


def _stretches(equal: np.ndarray, least: int) -> np.ndarray:
    """Starts and ends of the stretches of ``least`` or more trues, as rows."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]])))
    ends = edges.reshape(-1, 2)
    return ends[ends[:, 1] - ends[:, 0] >= least]


def _extended(w: np.ndarray, t: int, q: int, way: int) -> int:
    """How many pairs (i, i + q) are equal from ``t`` on, forwards (``way`` 1, ``t`` included) or backwards (-1, without it)."""
    n, size = 0, 64
    while True:
        low, high = (t + n, min(t + n + size, len(w) - q)) if way > 0 else (max(t - n - size, 0), t - n)
        if low >= high:
            return n
        same = w[low:high] == w[low + q : high + q]
        if way < 0:
            same = same[::-1]
        if not same.all():
            return n + int(np.argmin(same))
        n, size = n + (high - low), size * 2


def scan(w: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of ``w``, ordered by start and period."""
    found: dict[tuple[int, int], int] = {}  # start and end -> smallest period

    def add(start: int, pairs: int, q: int) -> None:
        if pairs + q >= max(LEAST, TIMES * q):
            key = (start, start + pairs + q)
            found[key] = min(q, found.get(key, q))

    n = len(w)
    for q in range(1, min(NARROW, n // TIMES + 1)):
        for s, e in _stretches(w[:-q] == w[q:], max(LEAST, TIMES * q) - q):
            add(int(s), int(e - s), q)
    block, size = w.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019), 1
    while TIMES * max(size, NARROW) <= n:
        if size >= NARROW:
            rows = len(block) // size
            heads = block[: rows * size : size][:-1]
            at, lag = np.nonzero(block[size : rows * size].reshape(-1, size) == heads[:, None])
            t, q = at * size, size + lag
            # the same block stands q further on; and 2 q further on
            third = t + 2 * q < len(block)
            t, q = t[third], q[third]
            third = block[t + 2 * q] == block[t]
            t, q = t[third], q[third]
            while len(t):
                # not what lies in a known run whose period divides the lag: it has a smaller period
                for (s, e), p in found.items():
                    known = (t >= s) & (t + q + size <= e) & (q % p == 0)
                    if known.any():
                        t, q = t[~known], q[~known]
                if not len(t):
                    break
                k = int(np.lexsort((t, q))[0])
                left, right = _extended(w, int(t[k]), int(q[k]), -1), _extended(w, int(t[k]), int(q[k]), 1)
                before = len(found)
                add(int(t[k]) - left, left + right, int(q[k]))
                if len(found) == before:  # too short: every find inside goes
                    gone = (q == q[k]) & (t >= t[k] - left) & (t <= t[k] + right)
                    t, q = t[~gone], q[~gone]
        if len(block) <= size:
            break
        a, b = block[:-size], block[size:]
        block = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b * np.uint64(0x94D049BB133111EB) + np.uint64(size)
        size *= 2
    return sorted((s, e - s, p) for (s, e), p in found.items())


def runs_of(ids: np.ndarray, starts: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Runs of every document: ``ids`` are the words of all, ``starts`` where each begins and, last, the end."""
    n_docs = len(starts) - 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n_docs)]
    at, segment = split_rare(ids, np.repeat(np.arange(n_docs), np.diff(starts)))
    if not len(at):
        return out
    # segments side by side, with a word of its own between two of them
    order = np.arange(len(at)) + segment - segment[0]
    w = -np.arange(1, order[-1] + 2, dtype=np.int64)
    w[order] = ids[at]
    place = np.full(len(w), -1)
    place[order] = at
    for s, length, q in scan(w):
        first = int(place[s])
        d = int(np.searchsorted(starts, first, side="right")) - 1
        out[d].append((first - int(starts[d]), length, q))
    return out


def echoed(n: int, name: str) -> tuple[int, int] | None:
    """``(a, p)``: of a document of ``n`` words whose decimal id's crc32 ends in 0, words from ``a`` on repeat with period ``p``; else none."""
    h = zlib.crc32(name.encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in a row (runs of characters that are no ASCII blank), and where each text's begin and end."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    bounds = lists.offsets.to_numpy()
    real = pc.greater(pc.binary_length(flat), 0)
    ends = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return flat.filter(real), ends[bounds - bounds[0]]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", echo: bool = False) -> DataFrame:
    """``(id_col, n_words, runs, collapsed)`` for every row of ``docs``.

    Words are runs of characters other than space, tab, line feed, vertical tab,
    form feed and carriage return; ``runs`` has start, length and period in
    words, ordered by start and period; ``collapsed`` is the text without the
    words that a run holds after its first period, joined by one space.  A null
    or blank text has no words, no runs and an empty ``collapsed``; repeated
    rows and null ids are rows like any other; other columns are ignored.
    With ``echo`` the words of some documents, chosen by id, are first replaced
    by a repeating tail (`echoed`): a stated test pattern.
    """
    rows, path = with_text(docs, text_col, [id_col])
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = pc.struct_field(batch.column(0), 0)
            words, starts = _words(texts_of(batch, path))
            ids = words.dictionary_encode().indices.to_numpy()
            counts = np.diff(starts)
            if echo:
                source = np.arange(len(ids))
                for k, name in enumerate(names.to_pylist()):
                    if name is not None and (found := echoed(int(counts[k]), str(name))):
                        a, p = found
                        source[starts[k] + a : starts[k + 1]] = starts[k] + a + np.arange(counts[k] - a) % p
                ids = ids[source]
            runs = runs_of(ids, starts)
            stay = np.ones(len(ids), bool)
            for k, found in enumerate(runs):
                for s, length, q in found:
                    stay[starts[k] + s + q : starts[k] + s + length] = False
            kept = words.take(pa.array(source[stay])) if echo else words.filter(pa.array(stay))
            ends = np.concatenate([[0], np.cumsum(stay)])[starts].astype(np.int32)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), kept), " ")
            flat = [r for found in runs for r in found]
            fields = [pa.array([r[j] for r in flat], pa.int64()) for j in range(3)]
            bounds = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32))
            nested = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(fields, fields=list(RUN)))
            yield pa.RecordBatch.from_arrays([names, pa.array(counts.astype(np.int64)), nested, joined], names=[id_col, "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")

