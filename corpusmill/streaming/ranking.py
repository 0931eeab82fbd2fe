"""Ranking of a session's nodes, turn by turn, as keyed state of a stream.

Each session has a turn counter; for each node the counts of its matches in pool A (what the user wrote) and pool B
(what the model wrote), the turn of its last match, how often it was shown and when last; and snapshots of the counts. A turn updates the nodes
that it matches, ranks them, shows the best over the turn's threshold and counts them as shown. A node that is shown more often than it
matches sinks. Every INTERVAL turns the counts are compared with the snapshot of INTERVAL turns ago.
A session's state is one value, read once and written once a batch, whatever the number of its turns and nodes in that batch: a call for each node
costs far more than its count. Nodes have places in order of arrival, each count is a column over the places, and a snapshot is
the first two columns as they were, so that a node is known to it if its place lies within.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Nodes shown a turn, turns between snapshots, the threshold's limit, weights of (both, A, B).
SHOWN, INTERVAL, LIMIT, WEIGHTS = 8, 10, 0.4, (3.0, 2.0, 1.0)
EVENTS = "session string, turn int, event string, node string, score double, rank int, pool string"
#: A session's state: binaries are columns of 32-bit integers, counts has those of Counts, snapshots two (a, b) for each turn in taken.
STATE = "turn int, nodes array<string>, counts array<binary>, taken array<int>, snapshots array<binary>"
#: Rows after which a session's events leave for the next operator.
ROWS = 10_000
Counts = tuple[int, int, int, int, int]


def score(counts: Counts, turn: int) -> float:
    """Pool weight x matches x 1 / turns since the last match x how far showing outran matching."""
    a, b, last, shown, _ = counts
    weight = WEIGHTS[0] if a > 0 and b > 0 else WEIGHTS[1] if a > 0 else WEIGHTS[2]
    return weight * (a + b) / max(turn - last + 1, 1) * (min(1.0, (a + b) / shown) if shown > 0 else 1.0)


def threshold(turn: int) -> float:
    return LIMIT * (1.0 - 1.0 / max(turn, 1))


def change(now: Counts, before: tuple[int, int], turn: int, interval: int = INTERVAL) -> str | None:
    """The first class that holds: in both pools now and in neither before, in both now and only in A before, more than once in B and never in A, or silent for the interval."""
    a, b, last, *_ = now
    pa, pb = before
    if a > 0 and b > 0 and pb == 0:
        return "new_ab" if pa == 0 else "promoted"
    if a == 0 and b > 1:
        return "b_persistent"
    return "faded" if (pa > 0 or pb > 0) and last < turn - interval else None


class Session:
    """The ranking of one session; of its snapshots those of turn 0, the last and the one before stay."""

    def __init__(self, kept: tuple | None = None):
        turn, nodes, counts, taken, snapshots = kept or (0, [], [b""] * 5, [], [])
        columns = [_column(c) for c in snapshots]
        self.turn, self.places, self.counts = turn, {n: i for i, n in enumerate(nodes)}, [_column(c) for c in counts]
        self.snapshots = dict(zip(taken, zip(columns[::2], columns[1::2], strict=True), strict=True))

    def kept(self) -> tuple:
        return self.turn, list(self.places), [c.tobytes() for c in self.counts], list(self.snapshots), [c.tobytes() for pair in self.snapshots.values() for c in pair]

    def take(self, a: list[str], b: list[str], top: int, interval: int) -> Iterator[tuple]:
        """The events of the next turn: (event, node, score, rank, pool)."""
        self.turn += 1
        turn, in_a, in_b, scores = self.turn, set(a), set(b), {}
        count_a, count_b, last, shown, last_shown = self.counts
        at = {n: self.places.setdefault(n, len(self.places)) for n in [*b, *a]}  # of equal scores, pool B's nodes come first
        for column in self.counts:
            column.frombytes(bytes(column.itemsize * (len(self.places) - len(column))))
        for node, i in at.items():
            count_a[i] += node in in_a
            count_b[i] += node in in_b
            last[i] = turn
            scores[node] = score((count_a[i], count_b[i], turn, shown[i], last_shown[i]), turn)
        limit = threshold(turn)
        best = [n for n in heapq.nlargest(top, scores, key=scores.__getitem__) if scores[n] >= limit]
        for rank, node in enumerate(best, 1):
            pool = "A+B" if node in in_a and node in in_b else "A" if node in in_a else "B"
            yield "shown", node, scores[node], rank, pool
            shown[at[node]] += 1
            last_shown[at[node]] = turn
        if turn == 1:
            self._snapshot(0)
        if interval > 0 and turn % interval == 0:
            yield from self._delta(interval)

    def _snapshot(self, at: int) -> None:
        self.snapshots[at] = (self.counts[0][:], self.counts[1][:])

    def _delta(self, interval: int) -> Iterator[tuple]:
        turn, before = self.turn, self.turn - interval
        old_a, old_b = self.snapshots.get(before, ((), ()))
        for i, (node, now) in enumerate(zip(self.places, zip(*self.counts, strict=True), strict=True)):
            kind = change(now, (old_a[i], old_b[i]) if i < len(old_a) else (0, 0), turn, interval)
            if kind:
                yield kind, node, None, None, None
        self._snapshot(turn)
        self.snapshots = {t: s for t, s in self.snapshots.items() if t in (0, before, turn)}


class Ranker(StatefulProcessor):
    """State: `ranking`, one value a session."""

    def __init__(self, ttl_ms: int | None = None, shown: int = SHOWN, interval: int = INTERVAL):
        self.ttl_ms, self.shown, self.interval = ttl_ms, shown, interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ranking = handle.getValueState("ranking", STATE, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns = [t for frame in rows for t in zip(frame["at"], frame["a"], frame["b"], strict=True)]
        session, out = Session(self.ranking.get()), []
        for _, a, b in sorted(turns, key=lambda t: (1, 0) if pd.isna(t[0]) else (0, t[0])):
            events = session.take(_pool(a), _pool(b), self.shown, self.interval)
            out += [(key[0], session.turn, *e) for e in events]
            if len(out) >= ROWS:
                yield _events(out)
                out = []
        self.ranking.update(session.kept())
        yield _events(out)

    def close(self) -> None:
        pass


def _column(data: bytes) -> array:
    return array("i", bytes(data))


def _events(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["session", "turn", "event", "node", "score", "rank", "pool"], dtype=object)


def _pool(nodes) -> list[str]:
    """A pool's nodes without nulls and repeats, in order; a null pool has none."""
    return [] if nodes is None else list(dict.fromkeys(n for n in nodes if n is not None))


def ranked(turns: DataFrame, ttl_ms: int | None = None, shown: int = SHOWN, interval: int = INTERVAL) -> DataFrame:
    """session, turn, event, node, score, rank, pool: what each turn shows, and what changed since the last snapshot but one.

    turns: a stream (or table) of session string, at (any order within a session), a and b (arrays of nodes). The turns of a batch go by `at`; a turn
    that comes after later ones counts as the next turn. Turns without any node count too. Sessions are spread over tasks by key; the turns
    of one session are a sequence and stay in one task. ttl_ms: sessions without a turn for so long (by the clock) lose their state; without it state stays. With it a stream has
    batches without rows for ever, so an availableNow run doesn't end: give it a trigger by the clock.
    The stream's session must use the RocksDB state store.
    """
    rows = turns.select("session", "at", "a", "b")
    return rows.groupBy("session").transformWithStateInPandas(Ranker(ttl_ms, shown, interval), EVENTS, "append", "processingTime" if ttl_ms else "none")
