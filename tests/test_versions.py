"""Versioned tables: snapshots, interrupted and competing writers, compaction, vacuum, tiers, high-water marks."""

import datetime as dt
import glob

import pytest

from corpusmill.operators import versions as V


def rows(spark, items):
    return spark.createDataFrame(list(items), "vec_id long, file_path string, chunk_index int, v array<double>")


def ids(df):
    return sorted(r["vec_id"] for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return V.Versions(spark, str(tmp_path / "store"))


def some(a, b, path="f"):
    return [(i, f"{path}{i // 2}", i % 2, [float(i), 1.0]) for i in range(a, b)]


def test_snapshots_and_compaction(spark, store):
    assert store.numbers() == [] and store.manifest().number == 0
    assert store.commit(replace={"t": rows(spark, some(0, 4))}, properties={"a": "1"}) == 1
    assert store.commit(append={"t": rows(spark, some(4, 6))}) == 2
    assert store.commit(replace={"t": rows(spark, some(9, 10)), "u": rows(spark, [])}) == 3
    assert [ids(store.read("t", n)) for n in (1, 2, 3)] == [[0, 1, 2, 3], [0, 1, 2, 3, 4, 5], [9]]
    assert ids(store.read("u")) == [] and store.manifest().properties == {"a": "1"}
    for _ in range(3):
        store.commit(append={"t": rows(spark, some(20, 40))})
    before = ids(store.read("t"))
    assert store.compact("t", 1) == 7
    assert ids(store.read("t")) == before
    assert len(glob.glob(f"{store.path}/data/{store.manifest().tables['t']['folders'][0]}/*.parquet")) == 1
    with pytest.raises(ValueError):
        store.read("t", 99)
    with pytest.raises(ValueError):
        store.commit(append={"t": spark.range(3)})


def test_interrupted_and_competing_writers(spark, store, monkeypatch):
    store.commit(replace={"t": rows(spark, some(0, 2))})
    with monkeypatch.context() as m:
        m.setattr(V.Versions, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.commit(replace={"t": rows(spark, some(5, 9))})
    assert ids(store.read("t")) == [0, 1] and store.numbers() == [1]
    base = store.manifest()
    store.commit(append={"t": rows(spark, some(2, 3))}, base=base)
    with pytest.raises(V.Conflict):
        store.commit(append={"t": rows(spark, some(3, 4))}, base=base)
    assert ids(store.read("t")) == [0, 1, 2]
    reader = store.read("t", 1)
    assert store.vacuum(keep=2) == 2 and ids(reader) == [0, 1]  # what the writers that failed had left
    store.commit(replace={"t": rows(spark, some(7, 8))})
    store.vacuum(keep=1)
    assert store.numbers() == [3] and ids(store.read("t")) == [7]
    assert len(glob.glob(f"{store.path}/data/*")) == 1


def test_tiers(spark, store):
    V.rebuild_tiers(store, rows(spark, some(0, 6)))
    V.add_to_tiers(store, rows(spark, [(10, "f1", 0, [1.0, 1.0]), (11, "g", 0, [1.0, 1.0])]))
    assert ids(V.live_vectors(store)) == [0, 1, 4, 5, 10, 11] and ids(store.read("stale")) == [2, 3]
    V.add_to_tiers(store, rows(spark, [(12, "g", 0, [2.0, 1.0]), (13, "f1", 1, [2.0, 1.0])]))
    assert ids(V.live_vectors(store)) == [0, 1, 4, 5, 12, 13] and ids(store.read("stale")) == [2, 3]
    number = V.compact_tiers(store)
    assert ids(V.live_vectors(store)) == [0, 1, 4, 5, 12, 13] and ids(store.read("minor")) == [] and ids(store.read("stale")) == [2, 3]
    assert ids(V.live_vectors(store, number - 2)) == [0, 1, 4, 5, 10, 11]
    V.rebuild_tiers(store, rows(spark, some(0, 2)))
    assert ids(V.live_vectors(store)) == [0, 1] and ids(store.read("stale")) == []


def test_changed_rows(spark, store):
    at = lambda m: None if m is None else dt.datetime(2024, 1, 1, 0, m)
    source = lambda *r: spark.createDataFrame([(k, at(c), at(u), t) for k, c, u, t in r], "id long, created timestamp, updated timestamp, text string")
    take = lambda df, **kw: [(r["id"], r["text"]) for r in V.take_changed(store, "chats", df, "id", "updated", "created", **kw).collect()]
    whole = lambda: sorted((r["id"], r["text"]) for r in store.read("chats").collect())
    first = [(1, 5, 5, "a"), (2, 3, 6, "b"), (3, 1, None, "never")]
    assert take(source(*first)) == [(2, "b"), (1, "a")]
    assert take(source(*first)) == []
    later = [*first, (1, 5, 9, "a2"), (1, 5, 8, "a1"), (4, 7, 7, "d")]
    assert take(source(*later)) == [(1, "a2"), (4, "d")]
    assert whole() == [(1, "a2"), (2, "b"), (4, "d")]
    late = [*later, (5, 2, 8, "late")]
    assert take(source(*late)) == []  # it came after the mark had passed it
    assert take(source(*late), lag="2 minutes") == [(5, "late")]
    assert whole() == [(1, "a2"), (2, "b"), (4, "d"), (5, "late")]
    assert store.manifest().properties["chats.mark"] == "2024-01-01 00:09:00"
