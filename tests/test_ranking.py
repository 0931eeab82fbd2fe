"""The stateful ranking of a stream against a replay of its turns, and the published score rules."""

import random

import pandas as pd
import pytest

from corpusmill.streaming import ranking as R
from corpusmill.streaming.events import drained


def replay(turns, interval=10, top=8):
    """All sessions' events by a plain loop: turns (session, at, a, b) in order."""
    states, out = {}, []
    for session, _, a, b in turns:
        s = states.setdefault(session, {"turn": 0, "nodes": {}, "snaps": {}})
        s["turn"] += 1
        t, nodes = s["turn"], s["nodes"]
        for n in {*a, *b}:
            c = nodes.setdefault(n, {"a": 0, "b": 0, "last": 0, "shown": 0})
            c["a"] += n in a
            c["b"] += n in b
            c["last"] = t

        def score(n):
            c = nodes[n]
            w = 3 if c["a"] and c["b"] else 2 if c["a"] else 1
            return w * (c["a"] + c["b"]) / max(t - c["last"] + 1, 1) * (min(1, (c["a"] + c["b"]) / c["shown"]) if c["shown"] else 1)

        order = sorted([*b, *(n for n in a if n not in b)], key=score, reverse=True)
        best = [n for n in order if score(n) >= 0.4 * (1 - 1 / t)][:top]
        out += [(session, t, "shown", n, round(score(n), 9), k, "A+B" if n in a and n in b else "A" if n in a else "B") for k, n in enumerate(best, 1)]
        for n in best:
            nodes[n]["shown"] += 1
        take = lambda: {n: (c["a"], c["b"]) for n, c in nodes.items()}
        if t == 1:
            s["snaps"][0] = take()
        if t % interval == 0:
            before = s["snaps"].get(t - interval, {})
            for n, c in nodes.items():
                pa, pb = before.get(n, (0, 0))
                both = c["a"] > 0 and c["b"] > 0
                kind = "new_ab" if both and not pa and not pb else "promoted" if both and pa and not pb else "b_persistent" if not c["a"] and c["b"] > 1 else "faded" if (pa or pb) and c["last"] < t - interval else None
                if kind:
                    out.append((session, t, kind, n, None, None, None))
            s["snaps"][t] = take()
            s["snaps"] = {k: v for k, v in s["snaps"].items() if k in (0, t - interval, t)}
    return out, states


def made_up(seed, sessions=5, most=34):
    r = random.Random(seed)
    rows = []
    for at in range(most):
        for s in range(sessions):
            if r.random() < 0.8:
                pick = lambda k: list(dict.fromkeys(f"n{int(r.expovariate(0.25))}" for _ in range(r.randint(0, k))))
                rows.append((f"s{s}", at, pick(9), pick(12)))
    return rows


@pytest.fixture(scope="module")
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def streamed(spark, folder, batches, **options):
    """Each of the batches is one file and one run of the stream; state is kept in between."""
    schema = "session string, at int, a array<string>, b array<string>"
    out = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        out = drained(R.ranked(stream, **options), f"{folder}/out", "append").collect()
    return [(r["session"], r["turn"], r["event"], r["node"], None if r["score"] is None else round(r["score"], 9), r["rank"], r["pool"]) for r in out]


def same(got, want):
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_stream_equals_replay(rocks, tmp_path):
    rows = made_up(1)
    cut = [rows[:50], rows[50:52], rows[52:]]
    want, states = replay(rows)
    assert {e[2] for e in want} == {"shown", "new_ab", "promoted", "b_persistent", "faded"}
    assert max(c["shown"] for s in states.values() for c in s["nodes"].values()) > 3
    same(streamed(rocks, tmp_path, cut), want)


def test_other_parameters_and_odd_rows(rocks, tmp_path):
    rows = made_up(2, 3, 12)
    odd = [("s0", 99, None, None), ("s1", 99, ["x", None, "x"], []), (None, 100, ["y"], ["y"])]
    want, _ = replay([*rows, ("s0", 99, [], []), ("s1", 99, ["x"], []), odd[2]], interval=3, top=2)
    same(streamed(rocks, tmp_path, [rows + odd], interval=3, shown=2), want)


def test_state_with_a_time_to_live(rocks, tmp_path):
    rows = made_up(3, 2, 5)
    schema = "session string, at int, a array<string>, b array<string>"
    rocks.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = R.ranked(rocks.readStream.schema(schema).parquet(f"{tmp_path}/in"), ttl_ms=3_600_000)
    query = out.writeStream.format("memory").queryName("ranked_with_ttl").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        for _ in range(120):
            if rocks.table("ranked_with_ttl").count():
                break
            query.awaitTermination(1)
        got = [(r["session"], r["turn"], r["event"], r["node"], r["score"] and round(r["score"], 9), r["rank"], r["pool"]) for r in rocks.table("ranked_with_ttl").collect()]
    finally:
        query.stop()
    same(got, replay(rows)[0])


def test_score_rules():
    assert R.score((1, 1, 3, 0, 0), 3) > R.score((2, 0, 3, 0, 0), 3) > R.score((0, 2, 3, 0, 0), 3)
    assert R.score((0, 0, 0, 0, 0), 5) == 0
    assert R.score((1, 1, 3, 4, 3), 3) == R.score((1, 1, 3, 0, 0), 3) / 2
    assert R.score((1, 1, 3, 1, 3), 3) == R.score((1, 1, 3, 0, 0), 3)
    limits = [R.threshold(t) for t in range(1, 1001)]
    assert limits[0] == 0 and limits == sorted(limits) and 0.399 < limits[-1] < 0.4


class Kept:
    """One session's state by name, as a handle gives it; counts the calls."""

    def __init__(self):
        self.values, self.calls = {}, 0

    def _variable(self, name, *_):
        kept, held = self, self.values.setdefault(name, {})

        class Variable:
            def __getattribute__(self, method):
                def call(*args):
                    kept.calls += 1
                    if method in ("update", "updateValue"):
                        held[args[0] if len(args) > 1 else None] = args[-1]
                    elif method == "removeKey":
                        del held[args[0]]
                    elif method in ("iterator", "keys"):
                        return iter(list(held.items() if method == "iterator" else held))
                    else:
                        key = args[0] if args else None
                        return key in held if method in ("exists", "containsKey") else held.get(key)

                return call

        return Variable()

    getValueState = getMapState = _variable

    def batch(self, turns, session="s0", **options):
        """The events of a batch of (at, a, b), by a new processor as in a new run."""
        ranker = R.Ranker(**options)
        ranker.init(self)
        frame = pd.DataFrame(turns, columns=["at", "a", "b"])
        out = pd.concat(ranker.handleInputRows((session,), iter([frame]), None))
        return [(t[0], int(t[1]), t[2], t[3], None if pd.isna(t[4]) else round(t[4], 9), None if pd.isna(t[5]) else int(t[5]), t[6]) for t in out.itertuples(index=False)]


def test_state_calls_do_not_grow_with_turns_and_nodes():
    calls = []
    for turns, nodes in ((1, 1), (3, 40), (25, 400)):
        kept = Kept()
        for k in range(2):
            kept.batch([(k * turns + t, [f"n{i}" for i in range(nodes)], [f"n{i}" for i in range(t, nodes, 2)]) for t in range(turns)])
        calls.append(kept.calls)
    assert calls == [calls[0]] * 3


def test_a_batch_for_each_turn_equals_replay():
    rows = made_up(4, 1, 60)
    want, _ = replay(rows)
    kept = Kept()
    same([e for _, *turn in rows for e in kept.batch([turn])], want)
    assert {e[2] for e in want} == {"shown", "new_ab", "promoted", "b_persistent", "faded"}


def test_events_leave_in_parts(monkeypatch):
    rows = made_up(5, 1, 60)
    monkeypatch.setattr(R, "ROWS", 7)
    same(Kept().batch([turn for _, *turn in reversed(rows)]), replay(rows)[0])
