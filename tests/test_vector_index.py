"""The vector index against full scans in numpy: recall, exactness, later rows, awkward rows."""

import math

import numpy as np
import pytest

from corpusmill.operators import vector_index as I

D = 16


def cloud(n, seed=1, clusters=20):
    r = np.random.default_rng(seed)
    c = r.normal(size=(clusters, D))
    return c[r.integers(0, clusters, n)] + 0.7 * r.normal(size=(n, D))


def frame(spark, x, first=0, name="vec_id"):
    return spark.createDataFrame([(first + i, [float(y) for y in v]) for i, v in enumerate(x)], f"{name} long, v array<double>")


def nearest(x, q, k=10):
    s = np.round(I.unit(q) @ I.unit(x).T, 12)
    return [sorted(range(len(x)), key=lambda j: (-row[j], j))[:k] for row in s]


def found(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    x = cloud(3000)
    return x, I.VectorIndex.build(frame(spark, x).repartition(4), str(tmp_path_factory.mktemp("index") / "a"), lists=60)


def test_recall(spark, built):
    x, index = built
    q = frame(spark, x[::20], name="query_id")
    hits = index.search(q)
    wanted = I.scanned(frame(spark, x), q)
    assert found(wanted) == dict(enumerate(nearest(x, x[::20])))
    n, share = I.recall(hits, wanted).first()
    assert n == 1500 and share >= 0.9
    assert index.probes() < 40  # it does leave lists out
    assert I.recall(wanted, wanted).first()["recall"] == 1


def test_exact(spark, built):
    x, index = built
    q = cloud(40, seed=3)
    for probes in (1, 3, None):
        assert found(index.search(frame(spark, q, name="query_id"), 7, probes, exact=True)) == dict(enumerate(nearest(x, q, 7)))


def test_exact_leaves_lists_out(spark, built):
    x, index = built
    wide = index.widths().toArrow().sort_by("list")
    held = index.centroids()
    near = I.unit(held[:5]) @ held.T
    bound = np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - np.arccos(np.clip(wide["cosine"].to_numpy(), -1, 1))))
    assert (bound < 0.9).any()


def test_added_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "PART", 50)
    monkeypatch.setattr(I, "QUERIES", 7)
    x = cloud(900, seed=5)
    index = I.VectorIndex.build(frame(spark, x[:600]), str(tmp_path / "i"), lists=8)
    before = index.rows().count()
    index.add(frame(spark, x[600:], 600))
    assert before == 600 and index.rows().count() == 900
    q = cloud(30, seed=6)
    assert found(index.search(frame(spark, q, name="query_id"), 5, 2, exact=True)) == dict(enumerate(nearest(x, q, 5)))


def test_ties_copies_and_unusable_rows(spark, tmp_path):
    x = np.repeat(cloud(6, seed=8), 40, axis=0)
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    rows += [(900, None), (901, [math.nan] * D), (902, [None] * D), (903, [0.0] * D), (904, [math.inf] * D), (905, [])]
    v = spark.createDataFrame(rows, "vec_id long, v array<double>")
    index = I.VectorIndex.build(v, str(tmp_path / "i"))
    assert index.rows().count() == 240
    asked = spark.createDataFrame([(1, rows[100][1]), (2, None), (3, [0.0] * D)], "query_id long, v array<double>")
    assert found(index.search(asked, 5, exact=True)) == {1: [80, 81, 82, 83, 84]}


def test_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, v array<double>")
    index = I.VectorIndex.build(none, str(tmp_path / "i"))
    assert not index.search(spark.createDataFrame([(1, [1.0])], "query_id long, v array<double>"), exact=True).count()
    with pytest.raises(ValueError):
        I.VectorIndex.build(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, v array<double>"), str(tmp_path / "j"))


def test_products_are_bounded(monkeypatch):
    """No product of a task has more numbers than CELLS, whatever a batch holds; before, a batch of 10,000 rows met all centroids at once."""
    import pyarrow as pa

    monkeypatch.setattr(I, "CELLS", 100)
    b = pa.RecordBatch.from_arrays([pa.array(range(23))], ["i"])
    parts = list(I._sliced(iter([b]), 30))
    assert [p.num_rows for p in parts] == [3] * 7 + [2]
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(23))
    assert [p.num_rows for p in I._sliced(iter([b]), 1000)] == [1] * 23
