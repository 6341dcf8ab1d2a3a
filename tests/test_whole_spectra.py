"""Queries on spectra against numpy over all 64 bands."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from gridloom.plans.all import QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def given():
    t = pq.read_table(f"{D}/embeddings.parquet")
    return np.array(t["vec_id"].to_pylist()), np.array(t["embedding"].to_pylist(), dtype=float), np.array(t["label"].to_pylist())


def test_rx(spark, given):
    ids, x, _ = given
    c = x - x.mean(axis=0)
    want = np.einsum("ij,ij->i", c @ np.linalg.inv(c.T @ c / len(c) + 1e-9 * np.eye(64)), c)
    got = {r.y * 25 + r.x: r.score for r in QUERIES["h22_rx_anomaly"](spark, D).collect()}
    assert [got[i] for i in ids.tolist()] == pytest.approx(want, abs=1e-3)


def test_unmixing(spark, given):
    ids, x, label = given
    e = np.array([x[label == k].mean(axis=0) + 1 for k in np.unique(label)][:4])
    raw = np.clip((x + 1) @ np.linalg.solve(e @ e.T, e).T, 0, 1)
    want = np.sqrt(np.mean((x + 1 - raw / raw.sum(axis=1, keepdims=True) @ e) ** 2, axis=1))
    got = {r.y * 25 + r.x: r.rmse for r in QUERIES["h20_unmixing"](spark, D).collect()}
    assert [got[i] for i in ids.tolist()] == pytest.approx(want, abs=1e-3)


@pytest.mark.parametrize("name", ["h21_endmembers", "i01_kmeans", "i02_svm", "i04_random_forest", "i05_mlp"])
def test_sees_all_bands(spark, name, monkeypatch):
    """Every query but those whose SQL states 8 bands asks for whole spectra."""
    from gridloom.plans import spectral_queries, table_queries

    seen, real = [], spectral_queries.spectra

    def spy(*args, **kw):
        out = real(*args, **kw)
        seen.append(len(out.first()["spectrum"]))
        return out

    monkeypatch.setattr(spectral_queries, "spectra", spy)
    monkeypatch.setattr(table_queries, "spectra", spy)
    assert QUERIES[name](spark, D).count() > 0 and seen == [64]
