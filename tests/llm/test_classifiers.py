import pickle

import numpy as np

from gridloom.llm.quality_classifier import DIM, REST, SHARE, Vocabulary, evened, index_vectors, neighbour_sums, pooled, quality, train_network, vocabulary, words_of
from gridloom.llm.toxicity import Rows, features, fit, logits, risk_parts, sigmoid, slopes, toxicity, train_nnpu

D = "/root/testdata/sf0.01"


def held_out_accuracy(spark, out, label):
    labels = spark.read.parquet(f"{D}/labels.parquet").collect()
    rows = {r.doc_id: r for r in out.collect()}
    pairs = [(rows[x.doc_id].predicted, x[label]) for x in labels if rows[x.doc_id].held_out]
    assert len(pairs) > 40 and all(0 <= r.score <= 1 for r in rows.values())
    return np.mean([a == b for a, b in pairs]), len(rows)


def test_toxicity_held_out(spark):
    out = toxicity(spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet"))
    accuracy, n = held_out_accuracy(spark, out, "toxic")
    assert n == 1000 and accuracy > 0.93


def test_quality_held_out(spark):
    out = quality(spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet"))
    accuracy, n = held_out_accuracy(spark, out, "quality")
    assert n == 1000 and accuracy > 0.93


def test_risk_slopes_against_finite_differences():
    """Of the whole risk where the negative part is above zero, of minus that part where it is below."""
    rng = np.random.default_rng(1)
    seen = set()
    for prior, shift in ((0.1, 0.0), (0.3, 0.5), (0.6, -3.0), (0.8, -4.0)):
        zp, zu = rng.normal(0, 1, 7), rng.normal(shift, 1, 11)

        def target(zp, zu):
            one, two = risk_parts(sigmoid(zp), sigmoid(zu), prior)
            return (one + two) if below is False else -two

        below = risk_parts(sigmoid(zp), sigmoid(zu), prior)[1] < 0
        seen.add(below)
        gp, gu = slopes(sigmoid(zp), sigmoid(zu), prior)
        for g, z, other in ((gp, zp, False), (gu, zu, True)):
            for k in range(len(z)):
                up, down = z.copy(), z.copy()
                up[k] += 1e-5
                down[k] -= 1e-5
                slope = (target(zp, up) - target(zp, down)) if other else (target(up, zu) - target(down, zu))
                assert abs(slope / 2e-5 - g[k]) < 1e-8
    assert seen == {True, False}


def test_nnpu_beats_plain_positive_negative():
    """Where a third of the unlabelled are toxic, taking them all as negatives loses toxic documents that the risk estimator finds."""
    rng = np.random.default_rng(0)
    draw = lambda toxic: np.array(sorted({*rng.choice(200, 20).tolist(), *((200 + rng.choice(5, 2)).tolist() if toxic else [])}))
    positive, unlabelled = Rows.of([draw(True) for _ in range(150)]), Rows.of([draw(k % 3 == 0) for k in range(1000)])
    test = {flag: Rows.of([draw(flag) for _ in range(400)]) for flag in (True, False)}
    w, b, risks = train_nnpu(positive, unlabelled, 205, 1 / 3, steps=1500)
    caught, wrong = (float(np.mean(logits(test[flag], w, b) > 0)) for flag in (True, False))
    assert caught > 0.85 and wrong < 0.1 and risks[-1] < 0.3 * risks[0]
    # logistic regression of confirmed against all others, to convergence
    w2, b2 = np.zeros(205), 0.0
    for _ in range(3000):
        fp, fu = sigmoid(logits(positive, w2, b2)), sigmoid(logits(unlabelled, w2, b2))
        g = [(fp - 1) / 1150, fu / 1150]
        w2 -= 3 * sum(np.bincount(r.columns, weights=x[r.owners()], minlength=205) for r, x in zip((positive, unlabelled), g))
        b2 -= 3 * (g[0].sum() + g[1].sum())
    assert np.mean(logits(test[True], w2, b2) > 0) < caught - 0.4
    assert features("!!clown,") == ["=clown", "clo", "clow"] and features("!!") == []
    assert not train_nnpu(positive, unlabelled, 205, 1 / 3, steps=0)[0].any()


def test_sample_is_bounded_by_characters(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    assert not fit(docs, labels, characters=0).weights and len(fit(docs, labels, characters=400_000, steps=20).weights) < len(fit(docs, labels, steps=20).weights)


def test_very_long_text_scores(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, "word other, " * 400_000)], "doc_id long, text string"))
    for op in (toxicity, quality):
        assert 0 <= op(docs, spark.read.parquet(f"{D}/labels.parquet")).filter("doc_id = -1").first().score <= 1


def test_random_indexing_against_loops():
    rng, rows = np.random.default_rng(2), 60
    ids = np.append(rng.integers(0, 50, 40), [rows, rows])
    ids = np.append(ids, rng.integers(0, 50, 30))
    plus, minus = index_vectors(rows)
    want = np.zeros((rows + 1, DIM), dtype=int)
    for i in range(len(ids)):
        for j in range(max(0, i - 2), min(len(ids), i + 3)):
            if i != j and ids[j] != rows:
                want[ids[i], plus[ids[j]]] += 1
                want[ids[i], minus[ids[j]]] -= 1
    assert (neighbour_sums(ids, rows)[:rows] == want[:rows]).all()
    words = Vocabulary([b"a", b"b"])
    assert len(words_of("a!! b#c")) == 6 and not pooled("", words, np.zeros((words.rows, DIM))).any()
    ids = words.ids("b a other").tolist()
    assert ids[:2] == [1, 0] and 2 <= ids[2] < 2 + REST and pickle.loads(pickle.dumps(words)).ids("b a other").tolist() == ids


def test_vocabulary_counts_all_texts(spark):
    docs = spark.createDataFrame([(f"often often! w{k % 40}",) for k in range(400)] + [("rare",), (None,)], "text string").repartition(5)
    assert list(vocabulary(docs)) == sorted([b"often", b"!", *[f"w{k}".encode() for k in range(40)]])
    assert vocabulary(docs.limit(0)).own == 0


def test_temperature_fits_the_held_back_rows():
    """A network with logits that are three times too large is cooled by about three; calibration lowers the log loss."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (6000, 3))
    y = (rng.random(6000) < 1 / (1 + np.exp(-(x[:, 0] - x[:, 1])))).astype(float)
    net = train_network(x, y)
    assert 0.7 < net.temperature < 1.5
    p = net.probability(x)
    assert abs(p.mean() - y.mean()) < 0.03 and max(abs(p[b].mean() - y[b].mean()) for b in [(p > a) & (p <= a + 0.2) for a in (0.1, 0.3, 0.5, 0.7)]) < 0.07


def test_network_needs_both_classes():
    assert train_network(np.zeros((30, 3)), np.ones(30)) is None


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "x y", 2), (3, "", 3), (3, "", 3)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, None), (None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    for op in (toxicity, quality):
        got = op(docs, labels).collect()
        assert sorted([str(r.doc_id) for r in got]) == ["1", "3", "3", "None"] and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
        assert op(docs.limit(0), labels.limit(0)).count() == 0


def test_evened_vectors_have_no_common_direction_and_equal_spread():
    rng = np.random.default_rng(4)
    n = np.append(rng.integers(1, 100, 300), 0)
    sums = np.rint(rng.normal(0, 30, (301, DIM)) * np.linspace(0.2, 3, DIM) + 60).astype(int)
    got = evened(sums, n)
    assert np.allclose(np.linalg.norm(got[:-1], axis=1), 1) and not got[-1].any()
    raw = sums[:-1] / np.linalg.norm(sums[:-1], axis=1, keepdims=True)
    lean = lambda x: np.linalg.norm(np.average(x, axis=0, weights=n[:-1]))
    uneven = lambda x: np.ptp(np.linalg.eigvalsh(np.cov(x.T, aweights=n[:-1])))
    assert lean(got[:-1]) < 0.1 * lean(raw) and uneven(got[:-1] * raw.std()) < uneven(raw)
    assert not evened(sums, np.zeros(301)).any() and not evened(np.ones((3, DIM), dtype=int), np.array([1, 2, 3])).any()


def test_quality_against_one_process(spark):
    from collections import Counter
    from zlib import crc32

    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    counts = Counter(w for t in texts.values() for w in words_of(t))
    words = Vocabulary(sorted(w for w, k in counts.items() if k >= 5 and k >= SHARE * sum(counts.values())))
    plus, minus = index_vectors(words.rows)
    sums, n = np.zeros((words.rows, DIM), dtype=int), np.zeros(words.rows, dtype=int)
    for t in texts.values():
        ids = words.ids(t)
        for i, w in enumerate(ids):
            n[w] += 1
            for other in (*ids[max(0, i - 2) : i], *ids[i + 1 : i + 3]):
                sums[w, plus[other]] += 1
                sums[w, minus[other]] -= 1
    vectors = evened(sums, n).astype(np.float32)
    known = sorted((pooled(texts[r.doc_id], words, vectors).tobytes(), r.quality) for r in labels.collect() if r.quality is not None and crc32(str(r.doc_id).encode()) % 4 != 2)
    net = train_network(np.array([np.frombuffer(b) for b, _ in known]), np.array([y for _, y in known], dtype=float))
    got = {r.doc_id: r.score for r in quality(docs, labels).collect()}
    assert sorted(got) == sorted(texts)
    for k, t in texts.items():
        assert abs(got[k] - net.probability(pooled(t, words, vectors)[None])[0]) < 1e-6
