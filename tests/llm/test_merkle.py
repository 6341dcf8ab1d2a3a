import hashlib
import random
import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from oracle import same_rows  # noqa: E402

from gridloom.llm import merkle  # noqa: E402
from gridloom.llm.merkle import manifest, ranked, tampered  # noqa: E402
from gridloom.llm.queries import ORACLES, QUERIES  # noqa: E402

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, leaf string, g int"


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_same_as_sql(spark, sf):
    rows = same_rows(spark, QUERIES, ORACLES, "op12_merkle_manifest", sf)
    assert {r[-1] for r in rows} == {True, False}


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, lower=False):
    text = row[4].translate({c: c + 32 for c in range(65, 91)}) if lower and row[4] is not None else row[4]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)])


def climb(nodes, at):
    """Root of ``nodes``, and the siblings (left, right) of place ``at`` level by level."""
    path = []
    while len(nodes) > 1:
        run = at // 8 * 8
        path.append((nodes[run:at], nodes[at + 1 : run + 8]))
        nodes, at = [H(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)], at // 8
    return nodes[0], path


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    order = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for g in names}
    subs = [climb([leaf_of(r) for r in order[g]], 0)[0] for g in names]
    out = []
    for k, g in enumerate(names):
        for j, r in enumerate(order[g]):
            sub, low = climb([leaf_of(x) for x in order[g]], j)
            root, high = climb(subs, k)
            fold = leaf_of(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for left, right in low + high:
                fold = H(*left, fold, *right)
            out.append((r[0], leaf_of(r), sub, root, H(*[x for p in low + high for side in p for x in side]), fold, fold == root))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA)


def check(spark, rows):
    got = manifest(table(spark, rows), altered={"text": tampered("doc_id", F.col("text"))})
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute(rows)


@pytest.mark.parametrize("share", [512, 3])
def test_brute_force(spark, monkeypatch, share):
    """Groups of 1, 8, 9, 64, 65 and 300 rows, null names, ids and texts, repeated rows."""
    monkeypatch.setattr(merkle, "SHARE", share)
    rng, rows = random.Random(2), []
    for lang, n in {None: 9, "a": 1, "b": 8, "c": 64, "d": 65, "é": 300, "B": 2, "zz": 1, "": 3}.items():
        rows += [(rng.choice([rng.randint(0, 10**6), None]) if k % 5 == 0 else rng.randint(0, 10**6), rng.choice(["s", None]), lang, rng.choice([1, None]), rng.choice([None, "", "Text", "low", "Ünï " * 50])) for k in range(n)]
    rows += rows[10:14]
    check(spark, rows)


def test_small_tables(spark):
    assert manifest(table(spark, [])).count() == 0
    check(spark, [(5, "s", "en", 3, "One")])
    check(spark, [(k, "s", "en", 3, "One") for k in range(20)])
    check(spark, [(k, "s", f"l{k}", 3, "One") for k in range(20)])


def test_ranks(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", None, "b", f"g{k % 40}"]), rng.randint(0, 500), k) for k in range(3000)]
    got = ranked(spark.createDataFrame(rows, "grp string, v int, w int").repartition(7), "grp", ["v", "w"])
    names = sorted({r[0] for r in rows}, key=lambda g: (g is not None, g or ""))
    want, seen = [], {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        seen[r[0]] = seen.get(r[0], -1) + 1
        want.append((*r, names.index(r[0]), seen[r[0]]))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
