"""Latent semantic analysis against numpy's decomposition of the whole matrix."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusmill.operators import vector as N


@pytest.fixture(scope="module")
def chunks():
    r = random.Random(3)
    topics = [[f"word{t}_{i}" for i in range(12)] for t in range(6)]
    rows = []
    for i in range(120):
        own, other = r.sample(topics, 2)
        rows.append((f"/f{i // 4}", i % 4, " ".join(r.choice(own if r.random() < 0.8 else other) for _ in range(r.randint(0, 60)))))
    return rows


def matrix(rows, terms):
    """Unit rows of sublinear TF-IDF, by the published formulas."""
    held = [Counter(re.findall("[a-z][a-z0-9_]{2,}", t.lower())) for _, _, t in rows]
    df = Counter(w for h in held for w in h)
    x = np.array([[(1 + math.log(h[w])) * (math.log((1 + len(rows)) / (1 + df[w])) + 1) if w in h else 0.0 for w in terms] for h in held])
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def test_values_and_vectors_equal_numpys(spark, chunks, monkeypatch):
    monkeypatch.setattr(N, "TERMS", 10)
    monkeypatch.setattr(N, "FAN", 2)
    df = spark.createDataFrame(chunks, "file_path string, chunk_index int, content string").repartition(5)
    model = N.lsa_fit(df, dims=72, rounds=8)
    x = matrix(chunks, model.terms)
    want = np.linalg.svd(x, compute_uv=False)
    assert np.allclose(model.values, want[: len(model.values)], rtol=1e-6, atol=1e-6)
    few = N.lsa_fit(df, dims=12, rounds=12)
    assert np.allclose(few.values[:6], want[:6], rtol=1e-3)
    # encoded chunks have the cosines of the projection on the same subspace, whatever its rotation
    got = {(r["file_path"], r["chunk_index"]): np.array(r["v"]) for r in N.lsa_encode(df, model).collect()}
    for (path, i, _), row in zip(chunks[:20], x[:20], strict=True):
        if row.any():
            y = row @ model.factors
            assert np.allclose(got[path, i], y / np.linalg.norm(y), atol=1e-6)


def test_a_saved_model_encodes_alike(spark, chunks, tmp_path):
    df = spark.createDataFrame(chunks[:30], "file_path string, chunk_index int, content string")
    model = N.lsa_fit(df, dims=5)
    model.save(spark, str(tmp_path / "m"))
    again = N.LatentModel.load(spark, str(tmp_path / "m"))
    assert again.terms == model.terms and np.allclose(again.factors, model.factors) and np.allclose(again.idf, model.idf)
