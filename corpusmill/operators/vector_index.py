"""An approximate vector index: a coarse quantiser, inverted lists as a partitioned table, and pruned probing.

Vectors are compared at length one. The quantiser's centroids are fitted on a bounded sample; every vector goes to the list of its nearest
centroid, and a list remembers the widest angle from its centroid to a member. A query looks into the lists of its nearest
centroids first. By the triangle inequality of angles, nothing in a list is nearer to the query than its centroid's angle less the list's
width, so a list whose bound lies beyond the k-th hit can be passed over without loss: `exact=True` looks into all others too.

Lists are split into parts of PART rows, and the queries that look into a list into blocks of QUERIES: however many
members or queries one list has, a task compares one block with one part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that the quantiser is fitted on, at most, and lists, at most (what is broadcast is at most LISTS centroids).
SAMPLE, LISTS = 50_000, 4096
#: Rows of a part of a list, and queries of a block.
PART, QUERIES = 16_384, 1024
#: Numbers in one product of a task.
CELLS = 1 << 20
ROUNDS = 12
_HITS = "query_id long, vec_id long, similarity double"


def unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as unit rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit(flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1))


def usable(rows: DataFrame, vector: str = "v") -> DataFrame:
    """Rows whose vector has components, none null, none but finite numbers, and a length over zero."""
    x = F.col(vector)
    fine = F.forall(x, lambda y: F.coalesce(F.abs(y) < F.lit(math.inf), F.lit(False))) & F.exists(x, lambda y: y != 0)
    return rows.where(fine)


def k_means(x: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Centroids of unit rows by Lloyd's rounds on the sphere; empty ones move to the rows that lie farthest from theirs."""
    lists = min(lists, len(x))
    c = x[np.random.default_rng(seed).choice(len(x), lists, replace=False)]
    for _ in range(ROUNDS):
        near = np.empty(len(x), np.int64)
        best = np.empty(len(x))
        for lo in range(0, len(x), 8192):
            s = x[lo : lo + 8192] @ c.T
            near[lo : lo + 8192] = s.argmax(1)
            best[lo : lo + 8192] = s.max(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        empty = np.flatnonzero(np.bincount(near, minlength=lists) == 0)
        total[empty] = x[np.argsort(best, kind="stable")[: len(empty)]]
        c = unit(total)
    return c


def needed_probes(x: np.ndarray, centroids: np.ndarray, target: float, k: int = 10, queries: int = 500) -> int:
    """Lists that a query must look into so that, within the sample, the share `target` of its k nearest lies there. In all the data hits are nearer, so it is no less."""
    near = np.concatenate([(x[lo : lo + 8192] @ centroids.T).argmax(1) for lo in range(0, len(x), 8192)])
    ranks = []
    for lo in range(0, min(queries, len(x)), 50):
        q = x[lo : min(lo + 50, queries)]
        hits = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, 1 : k + 1]
        place = np.argsort(np.argsort(-(q @ centroids.T), axis=1, kind="stable"), axis=1)
        ranks.append(np.take_along_axis(place, near[hits], 1).reshape(-1))
    found = np.bincount(np.concatenate(ranks), minlength=len(centroids)).cumsum()
    return int(np.searchsorted(found, math.ceil(target * found[-1]))) + 1


@dataclass
class VectorIndex:
    """An index in a folder that all machines share: centroids, and lists partitioned by list and part."""

    spark: SparkSession
    path: str

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE, target: float = 0.95, seed: int = 7) -> VectorIndex:
        """vectors: vec_id, v (arrays of one length). Unusable vectors are left out (see usable()). lists: by default four times the square root of the number of rows, at most LISTS.

        The sample is the `sample` rows whose ids hash lowest; every row is indexed. target: the recall at ten, within the sample, that the number of probes is set by.
        """
        spark = vectors.sparkSession
        rows = usable(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))
        n, least, most = rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
        if n and least != most:
            raise ValueError(f"vectors have from {least} to {most} components")
        lists = min(LISTS, lists or math.ceil(4 * math.sqrt(n)), max(1, n // 8)) if n else 0
        drawn = rows.withColumn("h", F.xxhash64("vec_id")).orderBy("h", "vec_id").limit(sample).select("v").toArrow()
        x = _matrix(drawn["v"])
        centroids = k_means(x, lists, seed) if n else np.zeros((0, 1))
        table = spark.createDataFrame([(i, [float(y) for y in c]) for i, c in enumerate(centroids)], "list int, centroid array<double>")
        table.coalesce(1).write.parquet(f"{path}/centroids")
        probes = needed_probes(x, centroids, target) if n else 1
        spark.createDataFrame([(probes, target)], "probes int, target double").coalesce(1).write.parquet(f"{path}/settings")
        index = cls(spark, path)
        index._write(rows, 0)
        return index

    def centroids(self) -> np.ndarray:
        t = self.spark.read.schema("list int, centroid array<double>").parquet(f"{self.path}/centroids").orderBy("list").toArrow()
        return np.array(t["centroid"].to_pylist(), float).reshape(t.num_rows, -1 if t.num_rows else 1)

    def probes(self) -> int:
        return self.spark.read.schema("probes int, target double").parquet(f"{self.path}/settings").first()["probes"]

    def _write(self, rows: DataFrame, first_part: int) -> None:
        """Rows into the files of their lists: parts of about PART rows, each written by one task."""
        held = self.centroids()
        if not len(held) and rows.limit(1).count():
            raise ValueError("the index was built on no rows; build it anew")
        c = self.spark.sparkContext.broadcast(held)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _sliced(batches, len(c.value)):
                s = _matrix(b.column(1)) @ c.value.T
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s.argmax(1).astype(np.int32)), pa.array(s.max(1))], ["vec_id", "v", "list", "similarity"])

        placed = rows.mapInArrow(near, "vec_id long, v array<double>, list int, similarity double")
        sizes = placed.groupBy("list").agg((F.floor(F.count("*") / PART) + 1).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int") + first_part
        out = placed.join(F.broadcast(sizes), "list").withColumn("part", part).drop("parts")  # sizes: a row a list
        out.repartition("list", "part").write.partitionBy("list", "part").mode("append").parquet(f"{self.path}/lists")

    def add(self, vectors: DataFrame) -> None:
        """More rows, in new parts of the lists of the nearest centroids; those stay as they are."""
        last = self.rows().agg(F.max("part")).first()[0]
        self._write(usable(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v")), 0 if last is None else last + 1)

    def rows(self) -> DataFrame:
        return self.spark.read.schema("vec_id long, v array<double>, similarity double, list int, part int").parquet(f"{self.path}/lists")

    def widths(self) -> DataFrame:
        """list, n, parts, cosine: members, parts, and the cosine of the widest angle from the centroid."""
        return self.rows().groupBy("list").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("part")).alias("parts"), F.min("similarity").alias("cosine"))

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, exact: bool = False) -> DataFrame:
        """query_id, vec_id, similarity, rank: the k nearest by cosine, ties by smaller vec_id; query_id's own row is a hit like any other.

        queries: query_id, v. probes: lists a query looks into (default: as many as build() found to be needed). exact: also into every
        list whose bound allows a hit, so the result is that of a full scan. Queries with an unusable vector have no hits.
        """
        wide = self.widths().toArrow()  # a row a list, at most LISTS
        if not wide.num_rows:
            return self.spark.createDataFrame([], f"{_HITS}, rank int")
        held, order = self.centroids(), np.argsort(wide["list"].to_numpy())
        lists, cosine = wide["list"].to_numpy()[order].astype(np.int32), np.clip(wide["cosine"].to_numpy()[order], -1, 1)
        probes = max(1, self.probes() if probes is None else probes)
        own = self.spark.sparkContext.broadcast((held[lists], lists, np.arccos(cosine)))
        asked = usable(queries).select(F.col("query_id").cast("long").alias("query_id"), F.col("v").cast("array<double>").alias("v"))
        first = self._hits(asked.mapInArrow(_probes(own, probes), "query_id long, v array<double>, list int"), k)
        if exact:
            rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
            first = self._kept(first)
            worst = first.withColumn("rank", rank).where(F.col("rank") == k).select("query_id", F.col("similarity").alias("worst"))
            bounded = asked.join(worst, "query_id", "left")
            more = bounded.mapInArrow(_others(own, probes), "query_id long, v array<double>, list int")
            first = first.unionByName(self._hits(more, k))
        return _best(first, k)

    def _kept(self, hits: DataFrame) -> DataFrame:
        import uuid

        path = f"{self.path}/hits/{uuid.uuid4().hex}"
        hits.write.parquet(path)
        return self.spark.read.schema(hits.schema).parquet(path)

    def _hits(self, probed: DataFrame, k: int) -> DataFrame:
        """query_id, vec_id, similarity of the best k of each part that a query looks into."""
        counts = probed.groupBy("list").agg((F.floor(F.count("*") / QUERIES) + 1).cast("int").alias("blocks"))
        layout = self.widths().select("list", "parts").join(counts, "list")  # a row a list
        block = F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")
        left = probed.join(F.broadcast(layout), "list").withColumn("block", block).select("query_id", "v", "list", "block", F.explode("parts").alias("part"))
        right = self.rows().join(F.broadcast(layout.select("list", "blocks")), "list")
        right = right.select("vec_id", "v", "list", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

        keys = ["list", "part", "block"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_nearest(k), _HITS)


def _nearest(k: int):
    """The k members nearest to each of the queries, ties by smaller vec_id; a slice of queries at a time."""

    def compare(asked: pa.Table, members: pa.Table) -> pa.Table:
        found: list[tuple] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if asked.num_rows and members.num_rows:
            members = members.sort_by("vec_id")
            q, x, names, ids = _matrix(asked["v"]), _matrix(members["v"]), asked["query_id"].to_numpy(), members["vec_id"].to_numpy()
            few = min(k, len(x))
            for lo in range(0, len(q), 64):
                score = np.round(q[lo : lo + 64] @ x.T, 12)  # equal vectors have equal scores, wherever they stand
                i, j = np.nonzero(score >= np.partition(score, -few, axis=1)[:, -few, None])
                s = score[i, j]
                order = np.lexsort((j, -s, i))
                i, j, s = i[order], j[order], s[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < few
                found.append((names[lo + i[keep]], ids[j[keep]], s[keep]))
        a, b, s = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"query_id": a, "vec_id": b, "similarity": s})

    return compare


def _best(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def _sliced(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Batches of so few rows that their products, of `width` numbers a row, have at most CELLS."""
    step = max(1, CELLS // max(1, width))
    for b in batches:
        for lo in range(0, b.num_rows, step):
            yield b.slice(lo, step)


def _probes(own, probes: int):
    """Each query with each of the lists of its nearest centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, lists, _ = own.value
        for b in _sliced(batches, len(centroids) + min(probes, len(centroids)) * centroids.shape[1]):
            near = np.argsort(-(_matrix(b.column(1)) @ centroids.T), axis=1, kind="stable")[:, :probes]
            yield _pairs(b, np.repeat(np.arange(len(near)), near.shape[1]), lists[near.reshape(-1)])

    return run


def _others(own, probes: int):
    """Each query with each of the further lists whose bound reaches its k-th hit; without k hits, with all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, lists, width = own.value
        for b in _sliced(batches, len(centroids) * (1 + centroids.shape[1])):
            s = _matrix(b.column(1)) @ centroids.T
            bound = np.cos(np.maximum(0, np.arccos(np.clip(s, -1, 1)) - width))
            worst = b.column(2).fill_null(-2.0).to_numpy(zero_copy_only=False)
            reach = bound >= worst[:, None] - 1e-9  # rounding loses no list
            np.put_along_axis(reach, np.argsort(-s, axis=1, kind="stable")[:, :probes], False, 1)
            i, j = np.nonzero(reach)
            yield _pairs(b, i, lists[j])

    return run


def _pairs(b: pa.RecordBatch, i: np.ndarray, lists: np.ndarray) -> pa.RecordBatch:
    rows = pa.array(i)
    return pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(lists)], ["query_id", "v", "list"])


def scanned(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The result of search() by a full scan, in blocks of queries and rows: what recall is measured against."""
    n, m = usable(vectors).count(), usable(queries).count()
    parts, blocks = n // PART + 1, m // QUERIES + 1
    own = lambda df, id_, of: df.withColumn("v", F.col("v").cast("array<double>")).select(id_, "v", F.pmod(F.xxhash64(id_), F.lit(of)).cast("int").alias(id_ + "_part"))
    left = own(usable(queries), "query_id", blocks).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = own(usable(vectors), "vec_id", parts).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    hits = left.groupBy("query_id_part", "other").cogroup(right.groupBy("other", "vec_id_part")).applyInArrow(_nearest(k), _HITS)
    return _best(hits, k)


def recall(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: hits wanted, and the share of them that was found."""
    both = wanted.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.agg(F.count("*").alias("wanted"), F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0)).alias("recall"))
