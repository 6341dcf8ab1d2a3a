import re

import numpy as np
import xxhash

from gridloom.llm import components
from gridloom.llm.simhash import bucket_of, fingerprint, flips, links, met, near_duplicates


def brute_fingerprint(text, size=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    sh = [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items):
    """items: (id, fp) -> id -> smallest id reachable."""
    parent = list(range(len(items)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(items)):
        for b in range(a):
            if bin(items[a][1] ^ items[b][1]).count("1") <= 4:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(items):
        least[find(k)] = min(i, least.get(find(k), i))
    return {i: least[find(k)] for k, (i, _) in enumerate(items)}


def test_fingerprint():
    for t in ["", None, " \t", "One", "one two Three", "a b c d", "a b c d e É é ÀA", "x y " * 700, "q\x1cz w e r t y u"]:
        assert fingerprint(t) == brute_fingerprint(t)
    rng = np.random.default_rng(1)
    long = " ".join(f"w{k}" for k in rng.integers(0, 5000, 3000))
    assert fingerprint(long) == brute_fingerprint(long)


def test_flips_cover_the_ball():
    for bits in (6, 9, 13):
        assert sum(map(len, flips(bits).values())) == 2081
        x = np.random.default_rng(bits).integers(0, 2**63, 50).astype(np.uint64)
        for step, masks in list(flips(bits).items())[:40]:
            assert (bucket_of(x[:1] ^ masks, bits) == (bucket_of(x[:1], bits) ^ step)).all()


def test_links_find_every_pair():
    rng = np.random.default_rng(5)
    x = [int(v) for v in rng.integers(0, 2**63, 60)]
    for v in list(x):
        for d in (1, 2, 3, 4, 5, 6):
            w = v
            for b in rng.permutation(64)[:d]:
                w ^= 1 << int(b)
            x.append(w)
    fps = np.unique(np.array(x, dtype=np.uint64))
    pairs = set()
    for b in range(64):
        u, v, _, _ = met(fps, b, 6)
        pairs |= {tuple(sorted(p)) for p in zip(u.tolist(), v.tolist())}
    assert all(bin(a ^ b).count("1") <= 4 for a, b in pairs)
    items = [(int(f), int(f)) for f in fps]
    parent = {i: i for i, _ in items}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    assert {i: find(i) for i, _ in items} == brute_components(items)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    want = brute_components(items)
    got = near_duplicates(docs).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{f:016x}", want[i]) for i, f in items} and len(got) == len(items)


def test_many_passes_give_the_same(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 2**63, 300).astype(np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    fps = spark.createDataFrame([(int(v),) for v in np.unique(np.concatenate([x, y])).view(np.int64)], "fp bigint").selectExpr("0 AS family", "fp")
    one = {tuple(r) for r in components.labels(links(fps).select("u", "v")).collect()}
    many = {tuple(r) for r in components.labels(links(fps, per_bucket=5000, per_pass=100).select("u", "v")).collect()}
    assert one == many and len(one) >= 290


def test_chain_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 200)] + [(500, 501), (7, 7)], "u bigint, v bigint")
    got = dict(map(tuple, components.labels(edges).collect()))
    assert got == {k: 1 for k in range(2, 201)} | {501: 500}


def test_odd_rows(spark):
    rows = spark.createDataFrame([(5, None, "x"), (5, None, "x"), (None, "", "y"), (3, " ", None), (9, "a b c", "z"), (None, "q", "z")], "doc_id long, text string, fp string")
    got = sorted([(r.doc_id, r.component_id) for r in near_duplicates(rows).collect()], key=str)
    assert got == sorted([(5, 3), (5, 3), (None, 3), (3, 3), (9, 9), (None, None)], key=str)
    assert near_duplicates(rows.limit(0)).count() == 0
