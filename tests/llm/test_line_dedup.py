import random
import sys
from collections import defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from oracle import same_rows  # noqa: E402

from gridloom.llm import line_dedup  # noqa: E402
from gridloom.llm.line_dedup import dedup_lines, line_bitmaps  # noqa: E402
from gridloom.llm.queries import ORACLES, QUERIES  # noqa: E402


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_same_as_sql(spark, sf):
    rows = same_rows(spark, QUERIES, ORACLES, "op11_line_dedup", sf)
    assert sf == "0.001" or any(r[2] for r in rows)


def brute(docs, least):
    """By sets of ids; a null id is -1, before all others."""
    key = lambda s: s.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for i, t in docs:
        for s in (t or "").split("\n"):
            held[key(s)].add(-1 if i is None else i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [s for s in lines if len(key(s)) < least or len(held[key(s)]) < 3 or max(held[key(s)]) == (-1 if i is None else i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def made():
    rng = random.Random(5)
    pool = [f"  Line number {k} of the pool\t" for k in range(40)] + ["short", "", " ", "ÄÖ line with umlauts ÄÖ", "x" * 30]
    docs = []
    for k in range(60):
        lines = [rng.choice(pool) if rng.random() < 0.7 else f"own line {k} {rng.random()}" for _ in range(rng.choice([1, 3, 70, 200]))]
        docs.append((rng.choice([k, k, None, 7]), "\n".join(s.upper() if rng.random() < 0.3 else s for s in lines)))
    docs += [(100, None), (101, ""), (102, "\n\n"), (None, None)] + [docs[3]] * 4
    docs += [(200 + k, "a line that nearly every text has\n" * 300 + f"and one of its own, number {k}") for k in range(5)]
    return docs


@pytest.mark.parametrize("share", [2000, 10, 1])
def test_brute_force_whatever_is_heavy(spark, monkeypatch, share):
    """Nothing, some and nearly everything goes the way of the heavy hashes."""
    monkeypatch.setattr(line_dedup, "SHARE", 10**9 if share == 2000 else share)
    docs = made()
    df = spark.createDataFrame([(i, t, "kept", 1) for i, t in docs], "doc_id long, text string, keep string, line int")
    out = dedup_lines(df)
    assert out.columns == ["doc_id", "line", "text", "n_lines", "n_dropped", "keep"]
    got = sorted([(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()], key=repr)
    assert got == brute(docs, 20)


def test_bitmaps_without_texts(spark):
    text = "\n".join(["one line that three texts hold"] + [f"own {k}" for k in range(100)] + ["another line that three texts hold"])
    df = spark.createDataFrame([(k, text) for k in range(3)], "doc_id long, text string")
    maps = {r.doc: [(w.word, w.keep) for w in r.keep] for r in line_bitmaps(df).collect()}
    assert maps == {k: [(0, ~1), (1, ~(1 << (101 - 64)))] for k in (0, 1)}


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
