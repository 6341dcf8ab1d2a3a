import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from gridloom.llm import queries
from gridloom.llm.periodic_runs import periodic_runs, runs_of, scan, split_rare

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    """All runs by trying every period at every place."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if i > s and length >= max(6, 4 * q) and not any(all(w[k] == w[k + p] for k in range(s, s + length - p)) for p in range(1, q)):
                out.append((s, length, q))
            i += i == s
    return sorted(out)


def made(rng, kinds=(1, 2, 30)):
    w = []
    for _ in range(rng.randint(0, 5)):
        base = [rng.randint(0, rng.choice(kinds)) for _ in range(rng.choice([1, 2, 3, 5, 16, 17, 33, 40]))]
        w += base * rng.randint(1, 6) + base[: rng.randint(0, len(base))] if rng.random() < 0.7 else [rng.randint(0, 40) for _ in range(rng.randint(0, 30))]
    return w


def test_runs_by_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        docs = [made(rng) for _ in range(rng.randint(1, 4))]
        starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        ids = np.array([x for d in docs for x in d], dtype=np.int32)
        assert runs_of(ids, starts) == [brute(d) for d in docs]


def test_splitting_is_stable_and_loses_no_run():
    rng = random.Random(2)
    for _ in range(100):
        w = np.array(made(rng, (3, 60)), dtype=np.int64)
        at, segment = split_rare(w, np.zeros(len(w), int))
        assert {x for s, n, _ in brute(list(w)) for x in range(s, s + n)} <= set(at.tolist())
        for s in np.unique(segment):
            part = w[at[segment == s]]
            assert len(part) >= 6 and np.unique(part, return_counts=True)[1].min() >= 4


@pytest.mark.parametrize("n", [200_000])
def test_long_texts(n):
    assert scan(np.zeros(n, int)) == [(0, n, 1)]
    base = np.random.default_rng(0).permutation(n // 4)
    assert scan(np.tile(base, 4)) == [(0, n // 4 * 4, n // 4)]
    assert scan(np.tile(base, 4)[:-1]) == []


def expected(doc_id, text):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        a, g = (h // 10) % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4), sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_by_brute_force(spark, tmp_path):
    rng = random.Random(4)
    blanks = [" ", "\n", "\t", "  ", "\x0b", "\f\r"]
    docs = [(k, "".join(f"wörd{x} " + rng.choice(blanks) for x in made(rng))) for k in range(150)]
    docs += [(200, None), (201, ""), (202, " \n"), (None, "a b " * 10), (None, None)] + docs[5:8]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, runs int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([expected(*d) for d in docs], key=repr)


def test_operator(spark):
    df = spark.createDataFrame([(1, "x a b a b a b a b y"), (2, "a a a a a a"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(df).collect()}
    assert got == {1: (10, [(1, 8, 2)], "x a b y"), 2: (6, [(0, 6, 1)], "a"), 3: (0, [], "")}
    assert periodic_runs(df.limit(0)).count() == 0
