"""Natural breaks against all partitions, and breaks of columns that do not vary."""

import numpy as np
import pytest

from gridloom.operators import stats as S


def every_value(values, classes):
    """Least sum of squares over all distinct values by dynamic programming, one value a block."""
    v, m = np.unique(values, return_counts=True)
    y = v - values.mean()
    m, s, q = (np.append(0, np.cumsum(x)) for x in (m, m * y, m * y * y))
    best = np.append(0, q[1:] - s[1:] ** 2 / m[1:])
    for _ in range(1, classes):
        new = np.full(len(v) + 1, np.inf)
        for j in range(1, len(v) + 1):
            i = np.arange(j)
            new[j] = (best[i] + q[j] - q[i] - (s[j] - s[i]) ** 2 / (m[j] - m[i])).min()
        best = new
    return best[-1]


def cost(values, ends):
    at = np.searchsorted(ends, values, side="left")
    return sum(((values[at == k] - values[at == k].mean()) ** 2).sum() for k in np.unique(at))


CASES = {
    "even": lambda r: r.uniform(0, 1, 1500),
    "skewed": lambda r: np.exp(r.normal(0, 3, 1200)),
    "heaps": lambda r: np.concatenate([r.normal(k * 5, 1, 300) for k in range(5)]),
    "ties": lambda r: np.round(r.normal(0, 40, 2500)),
    "far": lambda r: 1e9 + r.uniform(0, 1, 800),
    "outlier": lambda r: np.append(r.uniform(0, 1, 900), 1e6),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("classes,bins", [(2, 8), (4, 16), (5, 1024)])
def test_natural_breaks_are_the_best(spark, name, classes, bins):
    values = CASES[name](np.random.default_rng(5))
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double").repartition(3)
    ends = S.jenks(df, "v", classes, bins)
    assert len(ends) == classes and ends[-1] == values.max() and set(ends) <= set(values)
    want = every_value(values, classes)
    assert cost(values, ends) <= want + 1e-9 * ((values - values.mean()) ** 2).sum()


def test_few_or_no_values(spark):
    df = lambda *v: spark.createDataFrame([(x,) for x in v], "v double")
    assert S.jenks(df(1.0, 2.0, 2.0), "v", 5) == [1.0, 2.0]
    assert S.jenks(df(3.0, 3.0), "v", 2, 4) == [3.0]
    assert S.jenks(df(0.0, 1.0, 1.0 + 2**-52, 1.0 + 2**-51), "v", 4, 2) == [0.0, 1.0, 1.0 + 2**-52, 1.0 + 2**-51]
    for method in ("equal", "quantile", "pretty", "stddev", "log", "jenks"):
        assert [x for x in S.breaks(df(None), "v", method, 3) if x is not None] == []
    for method in ("equal", "pretty", "stddev", "jenks"):
        assert S.breaks(df(7.0, 7.0), "v", method, 3) == [7.0]
