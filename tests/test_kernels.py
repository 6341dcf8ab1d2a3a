"""Kernel machines against a small exact solver, and on rows held out."""

import numpy as np
import pytest

from gridloom.operators import kernels as K
from gridloom.operators import ml


def exact(x, s, c, gamma):
    """Decisions of the kernel machine with the plain hinge, and its optimum, by pairwise ascent on its dual."""
    k = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(2))
    a, grad = np.zeros(len(x)), -np.ones(len(x))
    while True:
        up = ((s > 0) & (a < c)) | ((s < 0) & (a > 0))
        low = ((s > 0) & (a > 0)) | ((s < 0) & (a < c))
        v = -s * grad
        i, j = np.where(up, v, -np.inf).argmax(), np.where(low, v, np.inf).argmin()
        if v[i] - v[j] < 1e-7:
            free = (a > 1e-9) & (a < c - 1e-9)
            b = v[free].mean() if free.any() else (v[i] + v[j]) / 2
            return lambda q: np.exp(-gamma * ((q[:, None] - x[None]) ** 2).sum(2)) @ (a * s) + b, a.sum() - (a * s) @ k @ (a * s) / 2
        room = [c - a[t] if (s[t] > 0) == (t == i) else a[t] for t in (i, j)]
        step = min((v[i] - v[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12), *room)
        for t, way in ((i, step), (j, -step)):
            a[t] += s[t] * way
            grad += s * s[t] * k[:, t] * s[t] * way


def table(spark, x, y):
    return spark.createDataFrame([(k, [float(v) for v in r], None if t is None else int(t)) for k, (r, t) in enumerate(zip(x, y))], "id long, spectrum array<double>, label int").repartition(3)


@pytest.fixture(scope="module")
def rings():
    """Three classes by distance from the middle, which no line parts."""
    r = np.random.default_rng(5)
    x = r.normal(size=(150, 2)) * 1.5
    return x, np.digitize(np.hypot(*x.T) + r.normal(size=150) * 0.15, [1.0, 2.2]) + 1


def test_decisions_of_the_exact_machine(spark, rings):
    x, y = rings
    m = K.kernel_machine(table(spark, x, y), 2, landmarks=150, scale=False)
    q = np.random.default_rng(6).normal(size=(200, 2)) * 1.5
    assert m.residual < 1e-6
    for p, (a, b) in enumerate(K.pairs(3)):
        of = (y == a + 1) | (y == b + 1)
        s = np.where(y[of] == a + 1, 1.0, -1.0)
        decide, best = exact(x[of], s, 10.0, 0.5)
        got, want = m.decisions(q)[:, p], decide(q)
        assert np.abs(got - want).max() < 0.15 and np.corrcoef(got, want)[0, 1] > 0.999, (a, b)
        assert ((got > 0) == (want > 0))[np.abs(want) > 0.1].all()
        reached = m.weights[p][:-1] @ m.weights[p][:-1] / 2 + 10.0 * np.maximum(0, 1 - s * m.decisions(x[of])[:, p]).sum()
        assert best - 1e-4 <= reached <= best + 10.0 * of.sum() * K.WIDTHS[-1] * np.log(2)  # what rounding off the hinge may cost


def test_votes_held_out_and_saved(spark, rings, tmp_path):
    x, y = rings
    df = table(spark, x, y)
    m = K.kernel_machine(df.filter("id % 3 <> 0"), 2, landmarks=60)
    m.save(spark, str(tmp_path / "m"))
    again = K.KernelMachine.load(spark, str(tmp_path / "m"))
    got = {r["id"]: r for r in K.classify(df.filter("id % 3 = 0"), again).collect()}
    votes = np.zeros((150, 3))
    for p, (a, b) in enumerate(K.pairs(3)):
        d = m.decisions(x)[:, p]
        votes[:, a] += d >= 0
        votes[:, b] += d < 0
    assert all(r["class"] == votes[k].argmax() + 1 and r["share"] == votes[k].max() / 2 for k, r in got.items())
    assert np.mean([r["class"] == r["label"] for r in got.values()]) > 0.8
    assert 0 <= again.residual < 0.05


def test_nulls_one_class_repeats_and_none(spark):
    x = [[0.0, 0.0]] * 30 + [[3.0, 3.0]] * 30
    df = table(spark, x, [1] * 30 + [2] * 30).unionByName(spark.createDataFrame([(100, None, 1), (101, [1.0], 2), (102, [1.0, None], 2), (103, [0.1, 0.0], None)], "id long, spectrum array<double>, label int"))
    m = K.kernel_machine(df, 2, landmarks=4)
    got = {r["id"]: r["class"] for r in K.classify(df, m).collect()}
    assert got == {**{k: 1.0 for k in range(30)}, **{k: 2.0 for k in range(30, 60)}, 100: None, 101: None, 102: None, 103: 1.0}
    assert {r["class"] for r in K.classify(df, K.kernel_machine(df.filter("label = 1"), 2)).collect()} == {1.0, None}
    empty = K.kernel_machine(df.filter("id < 0"), 2)
    assert K.classify(df, empty).filter("class IS NOT NULL").count() == 0


def test_folds_scale_by_their_own_rows(spark, rings):
    x, y = rings
    df = table(spark, x * [1.0, 1000.0], y)
    seen = []

    def fit(train):
        r = train.selectExpr("avg(spectrum[1]) m", "stddev_pop(spectrum[1]) s").first()
        seen.append((r["m"], r["s"]))
        m = K.kernel_machine(train, 2, landmarks=60, scale=False)
        return lambda test: K.classify(test, m)

    rows = ml.cross_validate(df, "id", 2, 3, fit=fit)
    got = {r["fold"]: r for r in rows.collect()}
    assert sorted(got) == [0, 1, 2] and sum(r["n"] for r in got.values()) == 150 and min(r["accuracy"] for r in got.values()) > 0.75
    assert all(abs(m) < 1e-9 and abs(s - 1) < 1e-9 for m, s in seen)
    one = ml.validation_summary(rows).first()
    acc = [r["accuracy"] for r in got.values()]
    assert one["folds"] == 3 and abs(one["mean"] - np.mean(acc)) < 1e-12 and abs(one["std"] - np.std(acc)) < 1e-12
    assert ml.cross_validate(df.filter("id < 0"), "id", 2, 3).count() == 0
    with pytest.raises(ValueError):
        ml.cross_validate(df, "id", 2, 1)
