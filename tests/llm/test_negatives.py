"""Hard negatives against brute force over all pairs in Python's integers."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score string, row string, anchor string, `window` string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def brute(rows, few=5, each=3):
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i is not None and i % 7 == 0:
            label = int(math.fmod(label + 1, 10))
        kept.append((i, [math.floor(256 * x) for x in v], label))
    out = []
    fits = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0, r[2])
    for k, (i, v, label) in enumerate(kept):
        if i is None or i % 50:
            continue
        scored = sorted(((fits(sum(a * b for a, b in zip(v, w))), j, m, other == label) for m, (j, w, other) in enumerate(kept) if m != k), key=order)
        for p, pid, _, _ in [s for s in scored if s[3]][:few]:
            for rank, (n, nid, _, _) in enumerate([s for s in scored if not s[3] and 50 * p <= 100 * s[0] <= 95 * p][:each], 1):
                out.append((i, pid, rank, nid, p, n))
    return out


def mined(spark, rows, parts=3):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(frame(spark, rows).repartition(parts), F.col("vec_id") % 50 == 0, label)


def same(got, want):
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def vectors(seed, n, d=24, labels=4):
    r = random.Random(seed)
    centre = [[r.gauss(0, 0.2) for _ in range(d)] for _ in range(labels)]
    own = [r.randrange(labels) for _ in range(n)]
    return [(i, [c + r.gauss(0, 0.15) for c in centre[k]], k) for i, k in enumerate(own)]


def test_query(spark, tmp_path):
    rows = vectors(1, 700)
    frame(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = negatives.op12_hard_negatives(spark, str(tmp_path)).collect()
    assert len(got) > 50
    same(got, brute(rows))


def test_awkward(spark):
    rows = vectors(2, 150, d=5)
    rows += [(200, None, 1), (201, [1.0, None, 2.0, 0.0, 0.0], 1), (202, [math.nan] * 5, 1), (203, [math.inf] * 5, 2), (204, [0.1] * 5, None), (None, [0.4] * 5, 1), (None, [0.4] * 5, 2)]
    rows += [(50, rows[50][1], rows[50][2]), (50, rows[50][1], rows[50][2]), (-50, [0.3] * 5, -1), (-7, [0.3, 0.2, 0.3, 0.3, 0.4], -1)]  # repeated anchors, negative ids and labels
    rows += [(300, [], 3), (301, [], 3), (302, [0.5, 0.5], 0), (350, [0.5, 0.5, 0.4], 1), (351, [0.1] * 70, 1), (400, [0.2] * 130, 2)]
    same(mined(spark, rows).collect(), brute(rows))


def test_ties_and_copies(spark):
    rows = [(i, [0.25, -0.5, 0.125], i % 3) for i in range(150)] + [(i, [0.2, -0.4, 0.1], 1) for i in range(200, 290)]
    same(mined(spark, rows, 5).collect(), brute(rows))


@pytest.mark.parametrize("size", [1e3, 1e6, 1e12, 1e30])
def test_wide_components(spark, size):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) * (size if i % 3 == 0 else 1) for _ in range(6)], i % 2) for i in range(120)]
    same(mined(spark, rows).collect(), brute(rows))


def test_groups_of_anchors_change_nothing(spark, monkeypatch):
    rows = vectors(4, 500, d=8)
    monkeypatch.setattr(negatives, "GROUP_BYTES", 300)
    same(mined(spark, rows).collect(), brute(rows))


def test_nothing(spark):
    assert not mined(spark, []).count()
    assert not mined(spark, [(1, [0.5], 1), (2, [0.5], 2)]).count()
    assert not mined(spark, [(50, [0.5], 1)]).count()


@pytest.mark.parametrize("scale,d", [(100, 64), (100, 3), (2**20, 70), (2**40, 5), (2**80, 2)])
@pytest.mark.parametrize("sparse", [0.0, 1 / 16, 1.0])
def test_intervals_lose_nothing(scale, d, sparse, monkeypatch):
    monkeypatch.setattr(negatives, "SPARSE", sparse)
    monkeypatch.setattr(negatives, "PAIRS", 100)
    r = random.Random(d)
    whole = lambda n: [[r.randint(-scale, scale) for _ in range(d)] for _ in range(n)]
    a, b = whole(12), whole(90)
    kind = np.int64 if scale < 2**60 else object
    score = [[sum(x * y for x, y in zip(u, v)) for v in b] for u in a]
    fits = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
    low, high = np.array([fits(sorted(s)[60]) for s in score]), np.array([fits(sorted(s)[80]) for s in score])
    i, j, s = negatives.qualifying(np.array(a, kind), np.array(b, kind), low, high)
    found = defaultdict(dict)
    for x, y, z in zip(i.tolist(), j.tolist(), s.tolist()):
        found[x][y] = z
    for x in range(12):
        assert found[x] == {y: fits(z) for y, z in enumerate(score[x]) if low[x] <= fits(z) <= high[x]}
