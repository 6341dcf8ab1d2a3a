import random

import numpy as np
import pytest

import corpus_pipeline
from gridloom.llm import near_texts as module
from gridloom.llm.near_texts import crowd_pairs, farthest, majorities, near_texts, parities, plan, shingle_set, sketches, _Hashes
from gridloom.llm.simhash import across, fingerprint, links, majority
from gridloom.llm.tables import ROW, numbered, without, written

D = "/root/testdata/sf0.001"


def sets_of(text, size=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def linked(items):
    """Pairs of ids at exact Jaccard 0.8 or more of five-word shingles, by brute force."""
    sets, out = [(i, sets_of(t)) for i, t in items], set()
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if (not a and not b) or 9 * len(a & b) >= 4 * (len(a) + len(b)) > 0:
                out.add((j, i))
    return out


def components_of(ids, pairs):
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        u, v = sorted((find(a), find(b)))
        root[v] = u
    return {i: find(i) for i in ids}


def edited(seed, bases, most):
    """Texts in bands of similarity around 0.8, short and long."""
    rng = random.Random(seed)
    texts = []
    for _ in range(bases):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([12, 60, 90, 200]))]
        for n in range(most):
            w = list(base)
            for p in rng.sample(range(len(w)), min(n, len(w))):
                w[p] = f"z{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_plan():
    last = 0
    for n in (0, 1, 10**4, 10**6, 10**9, 10**12):
        width, families = plan(n)
        assert 32 <= width <= 64 and width >= last and families >= 7
        last = width
    assert plan(10**4, recall=0.999)[1] > plan(10**4)[1] and farthest(448, 0.8) < 448 * 0.25


def test_parts():
    rng = np.random.default_rng(2)
    runs = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 2, 254, 255, 256, 900, 3)]
    got = majorities(np.concatenate(runs), np.array([len(r) for r in runs]))
    assert [int(x) for x in got] == [majority(r) for r in runs]
    memo = _Hashes()
    assert len(shingle_set(b"a b c d e f".split(), 5, memo)) == 2 and len(shingle_set([b"a"], 5, memo)) == 1 and not len(shingle_set([], 5, memo))
    assert sketches([np.zeros(0, dtype=np.uint64)], 3).tolist() == [[0, 0, 0]] and sketches([], 3).shape == (0, 3)


def test_recall_and_precision(spark):
    """Every link is at 0.8 or more, and more than nine in ten pairs of each band are found (by chance 98 % at 0.8 itself)."""
    items = edited(8, 150, 6)
    pairs = linked(items)
    want = components_of([i for i, _ in items], pairs)
    got = {r.id: r.component_id for r in near_texts(spark.createDataFrame(items, "id long, text string"), "id").collect()}
    assert len(got) == len(items) and all(want[i] == want[c] for i, c in got.items())
    sets = {i: sets_of(t) for i, t in items}
    bands = {}
    for a, b in pairs:
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        bands.setdefault(int(j * 20), []).append(got[a] == got[b])
    assert set(bands) >= {16, 17, 18} and all(np.mean(v) > 0.9 for v in bands.values()) and np.mean(sum(bands.values(), [])) > 0.97


def test_large_groups_of_near_copies(spark):
    """Hundreds of near copies of one text, all pairs above the similarity or chained, and copies without words."""
    rng = random.Random(8)
    base, texts = [f"hot{k}" for k in range(160)], []
    for k in range(400):
        w = list(base)
        for p in rng.sample(range(160), k % 4):
            w[p] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += ["", None, " ", "one two", "One  TWO"]
    items = list(enumerate(texts))
    want = components_of(range(len(texts)), linked(items))
    got = {r.id: r.component_id for r in near_texts(spark.createDataFrame(items, "id long, text string"), "id").collect()}
    assert sum(got[i] == want[i] for i in want) >= len(want) - 4 and all(want[i] == want[c] for i, c in got.items())
    assert {got[k] for k in (400, 401, 402)} == {400} and {got[403], got[404]} == {403}


def test_crowd_of_texts_below_the_similarity(spark):
    """Hundreds of texts meet each other without a link, and some of them have one: all links count, not only those of picked partners."""
    rng = random.Random(5)
    base, texts = [f"hot{k}" for k in range(200)], []
    for k in range(260):
        w = list(base)
        for p in rng.sample(range(200), 4):
            w[p] = f"y{rng.randrange(10**6)}"
        texts.append(w)
        if k % 3 == 0:
            near = list(w)
            for p in rng.sample(range(200), 3):
                near[p] = f"z{rng.randrange(10**6)}"
            texts.append(near)
    rng.shuffle(texts)
    items = [(k, " ".join(w)) for k, w in enumerate(texts)]
    width, families = plan(len(items))
    memo = _Hashes()
    bits = sketches([shingle_set(t.encode().split(), 5, memo) for _, t in items], families)
    low = bits & np.uint64((1 << width) - 1)
    collide = lambda a, b: (np.bitwise_count(low[a] ^ low[b]) <= 4).any() and np.bitwise_count(bits[a] ^ bits[b]).sum() <= farthest(64 * families, 0.8)
    pairs = linked(items)
    met = [(a, b) for a, b in pairs if collide(a, b)]
    crowd = sum(collide(a, b) for a in range(len(items)) for b in range(a))
    want = components_of(range(len(items)), met)
    got = {r.id: r.component_id for r in near_texts(spark.createDataFrame(items, "id long, text string"), "id", per_wave=12_000).collect()}
    assert crowd > 20 * len(met) and len(met) > 60 and got == want


@pytest.mark.parametrize("width, per_pass", [(32, 64), (44, 5)])
def test_all_pairs_across_labels(spark, width, per_pass):
    """Against brute force: every pair within 4 bits whose labels differ, once; label 0 differs from all."""
    rng, rows, want = random.Random(width), {}, set()
    for family in (0, 1):
        x = [rng.getrandbits(width) for _ in range(15)]
        x = list({y ^ sum(1 << b for b in rng.sample(range(width), rng.randrange(4))) for y in x for _ in range(40)})
        rows[family] = [(f, rng.choice([0, 0, 1, 2, 2, 2])) for f in x]
        for i, (a, la) in enumerate(rows[family]):
            for b, lb in rows[family][:i]:
                if bin(a ^ b).count("1") <= 4 and (la != lb or not la):
                    want.add((family, min(a, b), max(a, b)))
    df = spark.createDataFrame([(f, *r) for f, rs in rows.items() for r in rs], "family int, fp long, label long")
    got = [(r.family, min(r.u, r.v), max(r.u, r.v)) for r in links(df, width=width, least_bits=4, per_pass=per_pass, labelled=True).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    fps, labels = (np.array(c) for c in zip(*rows[0]))
    few = [p for b in range(16) for u, v in across(fps.astype(np.uint64), labels, b, 4, width, most=7) for p in zip(u.tolist(), v.tolist())]
    assert sorted((0, *p) for p in few) == sorted(p for p in want if not p[0])


def test_crowds_are_not_laid_out(spark):
    """Pairs of a crowd grow with its size, not with the square; what is not laid out has two crowded ends."""
    rng, counts = random.Random(4), []
    for n in (200, 800):
        fps = {0x5A5A5A5A ^ sum(1 << b for b in rng.sample(range(32), 2)) for _ in range(9 * n)}
        fps = sorted(fps)[: n // 2] + [rng.getrandbits(32) for _ in range(n // 2)]
        df = spark.createDataFrame([(0, f, 0, 1) for f in set(fps)], "family int, fp long, label long, n long")
        rows = [(r.u, r.v) for r in links(df, width=32, least_bits=4, labelled=True, crowd=4).collect()]
        crowded, laid = {u for u, v in rows if u == v}, [tuple(sorted(p)) for p in rows if p[0] != p[1]]
        want = {(a, b) for a in set(fps) for b in set(fps) if a < b and bin(a ^ b).count("1") <= 4}
        assert len(laid) == len(set(laid)) and set(laid) <= want and all(a in crowded and b in crowded for a, b in want - set(laid))
        counts.append((len(want), len(laid), len(set(fps))))
    assert all(few <= 8 * n for _, few, n in counts) and counts[1][0] > 30 * counts[1][2]


def test_crowd_pairs_against_brute_force(spark):
    """Every pair at the similarity in two components, and few others, of a crowd in which most pairs collide; sizes differ too."""
    rng, texts = random.Random(6), []
    base = [f"hot{k}" for k in range(150)]
    for k in range(240):
        w = base[: rng.choice([150, 150, 130])]
        for p in rng.sample(range(len(w)), rng.choice([0, 1, 4, 5, 6])):
            w[p] = f"y{rng.randrange(10**6)}"
        texts.append(w)
        if k % 4 == 0:
            texts.append([*w[:70], f"z{k}", *w[71:]])
    texts += [["one"], ["one", "two"]]
    memo = _Hashes()
    sets = list({s.tobytes(): s for s in (shingle_set(" ".join(w).encode().split(), 5, memo) for w in texts)}.values())
    bits = parities(sets)
    rows = [(bytes([k // 256, k % 256]), len(s), s.view(np.int64).tolist(), b.tolist()) for k, (s, b) in enumerate(zip(sets, bits))]
    root = {k: k % 7 for k in range(0, len(sets), 3)}  # some in components, across the similarity
    roots = spark.createDataFrame([(rows[k][0], rows[r][0]) for k, r in root.items()], "node binary, root binary")
    df = written(spark.createDataFrame(rows, "key binary, n int, shingles array<bigint>, parity array<bigint>"), "sets")
    got = [(int.from_bytes(r.u), int.from_bytes(r.v)) for r in crowd_pairs(df, roots, (4, 5)).collect()]
    held, of = [set(s.tolist()) for s in sets], lambda k: root.get(k, k)
    want = {(a, b) for b in range(len(sets)) for a in range(b) if of(a) != of(b) and 9 * len(held[a] & held[b]) >= 4 * (len(held[a]) + len(held[b]))}
    assert want and want <= set(got) and len(got) == len(set(got)) and all(a < b and of(a) != of(b) for a, b in got)
    assert len(got) < 1.5 * len(want)


def test_crowd_without_links_makes_few_pairs(spark, monkeypatch):
    """Near copies that all collide and are linked to nothing: their pairs are never laid out."""
    rng, base, texts, made = random.Random(9), [f"hot{k}" for k in range(150)], [], []
    for _ in range(300):
        w = list(base)
        for p in rng.sample(range(150), 5):
            w[p] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts[7] = texts[200] + " end"
    items, was = list(enumerate(texts)), module.written

    def seen(df, what):
        out = was(df, what)
        made.append((what, out.count()))
        return out

    monkeypatch.setattr(module, "written", seen)
    got = {r.id: r.component_id for r in near_texts(spark.createDataFrame(items, "id long, text string"), "id").collect()}
    assert got == components_of(range(len(items)), linked(items)) and got[200] == 7
    assert "crowd-pairs" in dict(made) and max(n for what, n in made if what in ("pairs", "crowd-pairs")) < 25 * len(items)


def test_given_documents(spark):
    items = [(r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    got = near_texts(spark.createDataFrame(items, "id long, text string"), "id").collect()
    assert {r.id: r.component_id for r in got} == components_of([i for i, _ in items], linked(items))
    assert near_texts(spark.createDataFrame([], "id long, text string"), "id").count() == 0


def test_stage_links_what_one_fingerprint_misses(spark):
    rng = random.Random(3)
    rows = []
    for k in range(20):
        w = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        copy = [*w[:50], "new", *w[51:150], "other", *w[151:]]  # 186 of 206 shingles
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(copy))]
    far = sum(bin(fingerprint(a[1], 5) ^ fingerprint(b[1], 5)).count("1") > 4 for a, b in zip(rows[::2], rows[1::2]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    kept = sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, D).collect())
    assert far and [k // 2 for k in kept] == list(range(20))


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_rows_keep_their_names_under_other_splits(spark, most):
    """What is decided in one reading is applied in another with other splits: nothing else goes."""
    docs = written(spark.range(20_000).selectExpr("id AS doc_id", "repeat(cast(id AS string), 30) AS text").repartition(3), "docs")
    keys = {"spark.sql.files.maxPartitionBytes": "100k", "spark.sql.files.openCostInBytes": "1k", "spark.sql.files.minPartitionNum": "40"}
    was = {k: spark.conf.get(k, None) for k in keys}
    before = numbered(docs)
    gone = written(before.filter("doc_id % 7 = 0").select(ROW), "gone")
    parts = before.rdd.getNumPartitions()
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        after = numbered(spark.read.parquet(*{f.rsplit("/", 1)[0] for f in docs.inputFiles()}))
        assert after.rdd.getNumPartitions() > 2 * parts
        left = {r.doc_id for r in without(after, gone, most).collect()}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert left == {k for k in range(20_000) if k % 7}


def test_frames_without_files_are_written(spark):
    rows = numbered(spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, _metadata string"))
    assert rows.select(ROW).distinct().count() == 3
    assert without(rows, rows.filter("doc_id is null")).count() == 2
