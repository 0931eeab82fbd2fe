"""Hard-negative mining by bit-sliced integer products.

A vector's components become integers, floor(scale * x). Its product with an anchor is the sum, over
the bit planes of the components, of the plane's weight times the anchor's components where that bit
is set. Planes are added most significant first. What the planes still to come can add lies
between the sums of the anchor's negative and positive components times their joint weight, so every
score has an interval that halves with each plane; a candidate goes as soon as its interval lies
outside what can still qualify. While most candidates are alive, a plane is one matrix product;
when few are, both sides are sliced and a plane's product is made of population counts.

Anchors go in groups of bounded bytes, each broadcast to two scans of all rows: one for the positives (best rows of the
same label), one for the negatives (best rows of other labels in each positive's window of scores). Every
task keeps a few rows an anchor, and those meet in a ranking by anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, map_arrow, shared_dir, stored

#: Bytes of the integers of one group of anchors.
GROUP_BYTES = 16 << 20
#: Anchors and rows whose products are looked at together.
ANCHORS, ROWS = 256, 4096
#: Below this share of candidates alive, they go on one by one.
SPARSE = 1 / 16
#: Pairs that go on together, one by one.
PAIRS = 1 << 18
_LEAST, _MOST = -(2**63) + 1, 2**63 - 1
#: Components of one class are of at most so many bits; wider ones are Python integers.
_WIDTHS = (12, 24, 40)
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _bits(x: np.ndarray) -> int:
    """Bits of the two's complement of the widest component."""
    return 1 + max(int(x.max()).bit_length(), (-1 - int(x.min())).bit_length()) if x.size else 1


def by_width(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and integers of the rows of x (whole numbers as doubles), those of one class of width together."""
    out, most = [], np.abs(x).max(1, initial=0.0)
    for low, high in zip((0, *_WIDTHS), (*_WIDTHS, 0), strict=True):
        rows = np.flatnonzero((most >= 2.0 ** (low - 1) if low else most >= 0) & (most < 2.0 ** (high - 1) if high else most >= 0))
        if len(rows):
            exact = x[rows].astype(np.int64) if high else np.array([[int(v) for v in r] for r in x[rows]], object).reshape(len(rows), x.shape[1])
            out.append((rows, exact))
    return out


def _sliced(x: np.ndarray, bits: int) -> np.ndarray:
    """Planes of the two's complement as words of 64 components: (bits, rows, words)."""
    width = -(-x.shape[1] // 64) * 64
    planes = np.zeros((bits, len(x), width), np.uint8)
    for k in range(bits):
        planes[k, :, : x.shape[1]] = (x >> k) & 1
    return np.packbits(planes, axis=2).view(np.uint64)


def _kind(most: int):
    """The fastest numbers that hold sums of that size exactly."""
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64 if most < 2**62 else object


def qualifying(anchors: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs whose score is from low to high of the anchor. anchors, rows: integers; low, high: longs; scores beyond 64 bits count as the nearest long."""
    bits = _bits(rows)
    size = np.abs(anchors).sum(1)
    kind = _kind(int(size.max(initial=0)) << bits)
    a = anchors.astype(kind)
    least, most = np.minimum(a, 0).sum(1)[:, None], np.maximum(a, 0).sum(1)[:, None]
    # bounds beyond any score are cut to one beyond the largest, so that they are exact in every kind of number
    edge = (int(size.max(initial=0)) << bits) + 1
    if kind is object:  # scores beyond 64 bits count as the nearest long
        lo = np.array([-edge if v <= _LEAST else int(v) for v in low.tolist()], object)[:, None]
        hi = np.array([edge if v >= _MOST else int(v) for v in high.tolist()], object)[:, None]
    else:
        lo, hi = np.clip(low, -edge, edge).astype(kind)[:, None], np.clip(high, -edge, edge).astype(kind)[:, None]
    lifted = rows + (1 << (bits - 1))
    score = np.repeat(-(least + most) * (1 << (bits - 1)), len(rows), axis=1)
    for k in range(bits - 1, -1, -1):
        plane = ((lifted >> k) & 1).astype(kind)
        score += (a @ plane.T) * (1 << k)
        rest = (1 << k) - 1
        alive = (score + rest * most >= lo) & (score + rest * least <= hi)
        n = int(np.count_nonzero(alive))
        if not n or k and kind is not object and n < SPARSE * alive.size:
            break
    of, at = np.nonzero(alive)
    found = score[of, at]
    if kind is object:
        return of, at, np.array([max(_LEAST, min(_MOST, int(v))) for v in found], np.int64)
    found = found.astype(np.int64)
    if not len(of) or not k:
        return of, at, found
    return _one_by_one(anchors, lifted, of, at, found, k, (low, high), (np.minimum(anchors, 0).sum(1), np.maximum(anchors, 0).sum(1)))


def _one_by_one(anchors, lifted, of, at, score, k, bounds, reach) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The planes below k for the pairs (of, at), whose scores hold those from k on."""
    bits = _bits(anchors)
    mine, out = _sliced(anchors, bits), []
    theirs = _sliced(lifted, k)
    for lo in range(0, len(of), PAIRS):
        i, j, s = of[lo : lo + PAIRS], at[lo : lo + PAIRS], score[lo : lo + PAIRS]
        for p in range(k - 1, -1, -1):
            plane, part = theirs[p][j], np.zeros(len(i), np.int64)
            for q in range(bits):
                common = np.bitwise_count(mine[q][i] & plane).sum(1, dtype=np.int64)
                part += -(common << q) if q == bits - 1 else common << q
            s = s + (part << p)
            rest = (1 << p) - 1
            alive = np.flatnonzero((s + rest * reach[1][i] >= bounds[0][i]) & (s + rest * reach[0][i] <= bounds[1][i]))
            i, j, s = i[alive], j[alive], s[alive]
        out.append((i, j, s))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class _Best:
    """The best few of each slot, by falling score, then id (null ids last), then row."""

    def __init__(self, slots: int, few: int):
        self.few, self.least = few, np.full(slots, _LEAST)
        self.slot = self.score = self.id = self.row = np.empty(0, np.int64)
        self.null = np.empty(0, bool)

    def add(self, slot, score, null, id_, row) -> None:
        good = score >= self.least[slot]
        if not good.any():
            return
        slot, score, null, id_, row = (np.concatenate([old, new[good]]) for old, new in zip((self.slot, self.score, self.null, self.id, self.row), (slot, score, null, id_, row), strict=True))
        order = np.lexsort((row, id_, null, -score, slot))
        slot = slot[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        kept = order[place < self.few]
        last = slot[place == self.few - 1]
        self.slot, self.score, self.null, self.id, self.row = slot[place < self.few], score[kept], null[kept], id_[kept], row[kept]
        self.least[last] = score[order[place == self.few - 1]]


def _share(score: np.ndarray, percent: int) -> np.ndarray:
    """floor(percent * score / 100) without overflow for percent up to 100."""
    return percent * (score // 100) + percent * (score % 100) // 100


def _matrix(column: pa.Array, width: int, scale: float) -> np.ndarray:
    """floor(scale * x) of each list as a row of doubles; lists are cut or filled up with zeros to the width."""
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (n == width).all():
        return np.floor(flat.reshape(len(n), width) * scale)
    inside = np.arange(width) < n[:, None]
    out, start = np.zeros(inside.shape), np.cumsum(n) - n
    out[inside] = flat[(start[:, None] + np.arange(width))[inside]]
    return np.floor(out * scale)


def _label_blocks(labels: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(labels, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(labels[order])) + 1) if len(order) else []


def _tiles(anchors: np.ndarray, rows: np.ndarray, first: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of anchors and rows; a few rows come first where no bounds are known yet."""
    cuts = [0, *([64] if first and len(rows) > 64 else []), *range(ROWS, len(rows), ROWS), len(rows)]
    for a in range(0, len(anchors), ANCHORS):
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo:
                yield anchors[a : a + ANCHORS], rows[lo:hi]


def _scan(group, width: int, scale: float, few: int, windows) -> callable:
    """A task's best rows of its part: of the same label if windows is None, else of other labels in each window (low, high; slots by anchor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_of, labels, vectors = group.value
        classes = [(numbers, ints, labels[numbers]) for numbers, ints in by_width(vectors)]
        low, high = windows.value if windows is not None else (np.full((len(row_of), 1), _LEAST), np.full((len(row_of), 1), _MOST))
        wide = low.shape[1]
        best, first = _Best(low.size, few), True

        def look(mine, ints, theirs, part, ids) -> None:
            """mine, theirs: numbers of anchors and rows; ints, part: their integers."""
            for a, r in _tiles(np.arange(len(mine)), np.arange(len(theirs)), first):
                own, other = mine[a], theirs[r]
                floor = np.maximum(low[own], best.least.reshape(low.shape)[own])
                floor[low[own] > high[own]] = _MOST
                i, j, s = qualifying(ints[a], part[r], floor.min(1), high[own].max(1))
                i, j = own[i], other[j]
                ok = (row_of[i] != ids[0][j]) & ((labels[i] == ids[3][j]) == (windows is None))
                i, j, s = i[ok], j[ok], s[ok]
                for p in range(wide):
                    fits = (s >= low[i, p]) & (s <= high[i, p])
                    k = j[fits]
                    best.add(i[fits] * wide + p, s[fits], ids[1][k], ids[2][k], ids[0][k])

        for batch in batches:
            x = _matrix(batch.column(3), width, scale)
            own_id = batch.column(1)
            ids = (batch.column(0).to_numpy(zero_copy_only=False), own_id.is_null().to_numpy(zero_copy_only=False), own_id.fill_null(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False))
            for theirs, part in by_width(x):
                for mine, ints, label in classes:
                    if windows is not None:
                        some = np.flatnonzero((low[mine] <= high[mine]).any(1))
                        look(mine[some], ints[some], theirs, part, ids)
                        continue
                    blocks = {int(label[b[0]]): b for b in _label_blocks(label)}
                    for b in _label_blocks(ids[3][theirs]):
                        if (same := blocks.get(int(ids[3][theirs[b[0]]]))) is not None:
                            look(mine[same], ints[same], theirs[b], part[b], ids)
            first = False
        yield pa.RecordBatch.from_arrays(
            [pa.array(row_of[best.slot // wide]), pa.array((best.slot % wide).astype(np.int32)), pa.array(best.score), pa.array(best.id, mask=best.null), pa.array(best.row)],
            ["anchor", "window", "score", "id", "row"],
        )

    return run


_FOUND = "anchor long, window int, score long, id long, row long"


def _ranked(found: DataFrame, few: int) -> DataFrame:
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= few)


def mine(
    vectors: DataFrame,
    anchor: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchor, label: expressions over vectors, judged in its columns' names. For each anchor, its best `positives` other rows of the same label, and for each of these
    the best `negatives` rows of other labels whose score is from low to high percent of the positive's. Equal scores go by smaller id, null ids last.
    Rows with a null label, a null vector, or any component that is null or not finite (also after scaling) take no part. Vectors of different lengths
    are compared over the shorter length. Repeated rows are rows of their own; rows with a null id can be positives and negatives. Scores are exact;
    beyond 64 bits they count as the nearest long. An anchor without positives, and a positive without negatives, have no row. Other columns are dropped; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    x = F.col(vector_col)
    usable = label.isNotNull() & F.forall(x, lambda v: F.coalesce(F.abs(v.cast("double") * F.lit(scale)) < F.lit(float("inf")), F.lit(False)))
    chosen = vectors.where(usable).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor")
    )
    rows = stored(chosen)
    n, width = rows.where("anchor").agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        return spark.createDataFrame([], RESULT)
    groups = max(1, -(-2 * n * 8 * max(1, width) // GROUP_BYTES))  # hashed into groups of about half the bound
    scan = rows.select("row", "id", "label", F.col("vector").cast("array<double>").alias("vector"))
    out = shared_dir(spark)
    for g in range(groups):
        own = rows.where("anchor").where(F.pmod(F.xxhash64("row"), F.lit(groups)) == g).select("row", "id", "label", F.col("vector").cast("array<double>").alias("vector"))
        table = own.toArrow().combine_chunks()
        if not table.num_rows:
            continue
        order = np.argsort(table["row"].to_numpy())
        held = [np.concatenate([_matrix(c, width, scale) for c in table["vector"].chunks])[order], table["row"].to_numpy()[order], table["label"].to_numpy()[order]]
        group = spark.sparkContext.broadcast((held[1], held[2], held[0]))
        best = stored(_ranked(map_arrow(scan, _scan(group, width, scale, positives, None), _FOUND), positives))
        kept = best.select("anchor", "rank", "score").toArrow()  # at most `positives` rows an anchor of the group
        at, place, score = np.searchsorted(held[1], kept["anchor"].to_numpy()), kept["rank"].to_numpy() - 1, kept["score"].to_numpy()
        floor, roof = np.full((len(order), positives), _MOST), np.full((len(order), positives), _LEAST)
        floor[at, place], roof[at, place] = -_share(-score, low), _share(score, high)
        windows = spark.sparkContext.broadcast((floor, roof))
        found = _ranked(map_arrow(scan, _scan(group, width, scale, negatives, windows), _FOUND), negatives)
        names = own.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
        pairs = best.select("anchor", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        result = found.join(F.broadcast(pairs), ["anchor", "window"]).join(F.broadcast(names), "anchor")
        result.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out)
        group.unpersist()
        windows.unpersist()
    return spark.read.schema(RESULT).parquet(out)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), FALSE)))
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def op12_hard_negatives(spark, sf_dir):
    """The contract's negatives over all embeddings: labels of ids divisible by 7 moved on, anchors of ids divisible by 50."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mine(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)
