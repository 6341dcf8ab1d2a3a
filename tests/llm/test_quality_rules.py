import itertools
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm.quality_rules import COUNTS, DIM, RIDGE, chi2_quantile, counts_of, robust_estimates, robust_outliers, units, vector
from gridloom.llm.quality_rules import MEANS, PAIRS, _consistency


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    inside = set()
    for k, w in enumerate(windows):
        if windows.count(w) > 1:
            inside.update(range(k, k + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab #|\n\t\x0b\x1c\xa0é🙂", max_size=120))
def test_counts(text):
    assert counts_of(text)[:5] == brute(text)


def test_null_and_long():
    assert counts_of(None) == (0,) * 6
    text = "a b c d e f g h i " * 30_000
    assert counts_of(text)[4] == counts_of(text)[0] == 270_000


def estimates(spark, x, share):
    cols = [f"x{i} double" for i in range(DIM)]
    rows = spark.createDataFrame([("g", "", 1, *map(float, r)) for r in x], ", ".join(["g1 string", "g2 string", "level int", *cols]))
    r = robust_estimates(rows, share).first()
    inverse = np.zeros((DIM, DIM))
    for i, j in PAIRS:
        inverse[i, j] = inverse[j, i] = r[f"v{i}_{j}"]
    return np.array([r[c] for c in MEANS]), inverse


def test_mcd_ignores_a_third_of_outliers(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (700, DIM)), rng.normal(9, 0.3, (300, DIM))])
    mean, inverse = estimates(spark, x, 0.65)
    assert np.abs(mean).max() < 0.3 and 0.6 < np.diag(np.linalg.inv(inverse)).max() < 1.6
    assert abs(chi2_quantile(0.99, 5) - 15.086) < 0.05


def test_mcd_against_all_subsets(spark):
    """Twelve rows, three of them far: the subset of least determinant among all 220, by brute force, has the same verdicts."""
    rng = np.random.default_rng(11)
    for _ in range(3):
        x = np.vstack([rng.normal(1, 0.3, (9, DIM)), rng.normal(6, 0.3, (3, DIM))])

        def scatter(pick):
            part = x[list(pick)]
            return np.cov(part.T, bias=True) + RIDGE

        best = min(itertools.combinations(range(12), 9), key=lambda p: np.linalg.slogdet(scatter(p))[1])
        cov = np.cov(x[list(best)].T, bias=True) * _consistency(0.75) + RIDGE
        mean, inverse = estimates(spark, x, 0.75)
        assert np.allclose(mean, x[list(best)].mean(0), atol=1e-9) and np.allclose(np.linalg.inv(inverse), cov, atol=1e-9)


def test_verdicts_against_numpy(spark):
    """The query's distances from plain numpy concentration steps started at its own answer: a fixed point with the least bins' error."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["lorem", "Ipsum", "dolor", "sit", "amet,", "a", "consectetur"]) + rng.choice(["", "", "s", "ing"]) for _ in range(rng.randrange(25, 90))) for _ in range(150)]
    texts += [" ".join("#$%" * 9 for _ in range(40)) + f" {k}" for k in range(12)]
    rows = [(k, t, "en", "web") for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in robust_outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [k for k in got if not got[k].kept and not got[k].base_failed] == [] or all(k >= 150 for k in got if not got[k].kept and not got[k].base_failed)
    sound = [k for k in got if not got[k].base_failed]
    frame = spark.createDataFrame([(k, *[int(getattr(got[k], c)) for c in COUNTS]) for k in sound], "k long, " + ", ".join(f"{c} long" for c in COUNTS))
    x = {r[0]: np.array(r[1:]) for r in frame.select("k", *vector(*[frame[c] for c in COUNTS])).collect()}
    keys = sorted(x)
    m = np.array([x[k] for k in keys])
    near = np.argsort([got[k].distance2 for k in keys])[: round(0.75 * len(keys))]
    cov = np.cov(m[near].T, bias=True) * _consistency(0.75) + RIDGE
    d = m - m[near].mean(0)
    d2 = np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
    assert np.allclose(d2, [got[k].distance2 for k in keys], rtol=0.05, atol=0.05)


def test_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = {r.doc_id: r for r in robust_outliers(docs).collect()}
    assert len(rows) == docs.count()
    for r in docs.collect():
        got = rows[r.doc_id]
        want = counts_of(r.text)
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == want[:5]
        assert got.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (got.base_failed and got.kept)
    clean = [rows[x.doc_id] for x in labels.filter("quality = 1").collect()]
    junk = [rows[x.doc_id] for x in labels.filter("quality = 0").collect()]
    assert all(x.kept or x.base_failed for x in clean)
    assert sum(x.kept for x in junk) < 0.15 * len(junk)


def test_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = spark.createDataFrame([(1, None, None, None, 1), (None, text, "en", None, 2), (2, text, None, "s", 3), (2, text, None, "s", 3)], "doc_id long, text string, lang string, source string, kept int")
    got = sorted([(r.doc_id, r.n_words, r.base_failed, r.kept) for r in robust_outliers(rows).collect()], key=str)
    assert got == [(1, 0, True, False), (2, 30, False, True), (2, 30, False, True), (None, 30, False, True)]
    assert robust_outliers(rows.limit(0)).count() == 0


def test_small_groups_pool_and_nulls_stand_apart(spark):
    rng = random.Random(2)
    text = lambda: " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(25, 60)))
    rows = [(k, text(), *g) for k, g in enumerate([("en", "a")] * 70 + [("en", "b")] * 30 + [("en", "c")] * 35 + [(None, "?")] * 61 + [("?", "?")] * 3 + [("de", None)] * 62)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    sound = docs.selectExpr("coalesce('=' || lang, '') AS lang", "coalesce('=' || source, '') AS source")
    got = {(r.lang, r.source): (r.g1, r.g2, r.level) for r in units(sound, 60).collect()}
    assert got == {("=en", "=a"): ("=en", "=a", 2), ("=en", "=b"): ("=en", "", 1), ("=en", "=c"): ("=en", "", 1), ("", "=?"): ("", "=?", 2), ("=de", ""): ("=de", "", 2)}
    out = robust_outliers(docs).collect()
    assert len(out) == len(rows) and all(r.distance2 == 0 for r in out if 196 <= r.doc_id < 199)
