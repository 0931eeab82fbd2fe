"""Vector search: exact top-k, two tiers with tombstones, centroids and their neighbours, LSA."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import groups as B
from ..functions import vectors as V


#: Groups up to which centroids are broadcast.
CENTROIDS = 20_000


def top_k(vectors: DataFrame, query: list[float], k: int = 10, measure: str = "cosine", key: str = "vec_id") -> DataFrame:
    """The k nearest by cosine, inner product ("ip") or squared distance ("l2", similarity 1 / (1 + d)); rows with NaN or null are out.

    The query is a literal, so this is a scan and a top-k without a join.
    """
    v, q = F.col("v"), V.literal(query)
    ok = vectors.where(v.isNotNull() & ~V.has_nan(v))
    score: Column = {"cosine": V.cosine(v, q), "ip": V.inner(v, q), "l2": 1 / (1 + V.squared_distance(v, q))}[measure]
    return ok.withColumn("similarity", score).where("similarity is not null").orderBy(F.desc("similarity"), key).limit(k).withColumn("similarity", F.round("similarity", 6))


def search_files(vectors: DataFrame, contents: DataFrame, files: DataFrame, query: list[float], k: int = 10, scope: str | None = None, around: int = 0, cut: int = 200) -> DataFrame:
    """The k nearest chunks of files in scope, with the file's size and time and a preview of the chunk (and of so many neighbours to either side)."""
    from .metadata import in_scope

    own = vectors if scope is None else vectors.where(in_scope(F.col("file_path"), scope))
    hits = recall(own, contents, query, k, cut, around).withColumnRenamed("context", "preview")
    return hits.join(files.select("file_path", "file_size", "last_modified"), "file_path").orderBy(F.desc("similarity"), "file_path", "chunk_index")


def coverage(rows: DataFrame, column: str) -> DataFrame:
    """How many rows there are, and how many have a vector in the column."""
    return rows.agg(F.count("*").alias("total"), F.count(column).alias("with_vector"))


def available(rows: DataFrame, column: str) -> bool:
    return bool(rows.where(F.col(column).isNotNull()).limit(1).count())


def is_indexed(files: DataFrame, vectors: DataFrame) -> DataFrame:
    """file_path and whether any of its vectors is indexed."""
    have = vectors.select("file_path").distinct().withColumn("indexed", F.lit(True))
    return files.select("file_path").join(have, "file_path", "left").fillna(False, ["indexed"])


def checked(vectors: DataFrame, dims: int) -> DataFrame:
    """vectors with v of length one; a vector of another size than dims is an error."""
    right = F.assert_true(F.size("v") == dims, F.lit(f"a vector has not {dims} dimensions"))
    return vectors.where(right.isNull()).withColumn("v", V.unit(F.col("v")))


def register(spark) -> None:
    """SQL functions over arrays of doubles: vector_cosine, vector_inner, vector_l2 (squared) and vector_l2_similarity (1 / (1 + d))."""
    two = "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN"
    total = lambda x: f"aggregate(zip_with(a, b, (x, y) -> {x}), 0D, (s, x) -> s + x)"
    own = lambda v: f"sqrt(aggregate({v}, 0D, (s, x) -> s + x * x))"
    bodies = {"inner": total("x * y"), "cosine": f"{total('x * y')} / nullif({own('a')} * {own('b')}, 0D)", "l2": total("(x - y) * (x - y)"), "l2_similarity": f"1 / (1 + {total('(x - y) * (x - y)')})"}
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION vector_{name}{two} {body}")


def recall(vectors: DataFrame, contents: DataFrame, query: list[float], k: int = 5, cut: int = 600, around: int = 1) -> DataFrame:
    """The k nearest chunks, each with the texts of its neighbours joined in order and cut."""
    from .chunking import adjacent

    hits = top_k(vectors, query, k)
    near = adjacent(hits, contents, around, around).groupBy("file_path", "hit_index").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("c"))
    joined = near.select("file_path", F.col("hit_index").alias("chunk_index"), F.left(F.array_join("c.content", "\n"), F.lit(cut)).alias("context"))
    return hits.select("file_path", "chunk_index", "similarity").join(joined, ["file_path", "chunk_index"])


def two_tiers(major: DataFrame, minor: DataFrame, tombstones: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """Nearest over both tiers without tombstoned rows (which apply to the major tier), best of each (path, index)."""
    live = major.join(tombstones, "vec_id", "left_anti").unionByName(minor)
    live = live.where(F.col("v").isNotNull() & ~V.has_nan(F.col("v")))
    best = Window.partitionBy("file_path", "chunk_index").orderBy(F.desc("similarity"), "vec_id")
    scored = live.withColumn("similarity", F.round(V.inner(F.col("v"), V.literal(query)), 6))
    return scored.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn").orderBy(F.desc("similarity"), "vec_id").limit(k)


def needs_compaction(major: DataFrame, minor: DataFrame, most: int = 1000, share: float = 0.1) -> DataFrame:
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(major, "major").crossJoin(n(minor, "minor")).withColumn("needed", (F.col("minor") >= most) | (F.col("minor") > share * F.col("major")))  # one row each


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """Mean vector of each group, dimension by dimension."""
    means = vectors.select(group, F.posexplode("v").alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("x"))
    return means.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).select(group, F.col("c.x").alias("v"))


def centroid_neighbours(vectors: DataFrame, group: str, k: int = 40, threshold: float = 0.5) -> DataFrame:
    """Pairs of groups: for each centroid its k nearest vectors of other groups over the threshold, counted and averaged by group.

    The centroids, a row for each group, are the stated query set; every vector is read once.
    """
    c = centroids(vectors, group).select(F.col(group).alias("from_group"), F.col("v").alias("c"))
    few = c.limit(CENTROIDS + 1).count() <= CENTROIDS
    c = F.broadcast(c) if few else c.repartition("from_group")
    pairs = vectors.join(c, F.col(group) != F.col("from_group")).withColumn("similarity", V.cosine(F.col("v"), F.col("c"))).where(F.col("similarity") > threshold)
    rank = F.row_number().over(Window.partitionBy("from_group").orderBy(F.desc("similarity"), "vec_id"))
    top = pairs.withColumn("rn", rank).where(F.col("rn") <= k)
    return top.groupBy("from_group", F.col(group).alias("to_group")).agg(F.count("*").alias("hits"), F.round(F.avg("similarity"), 6).alias("similarity"))


def linked_groups(neighbours: DataFrame, group: str = "to_group") -> DataFrame:
    """Edges between groups, once for both directions: a, b, and the best similarity and all hits of either direction."""
    a, b = F.least("from_group", group), F.greatest("from_group", group)
    return neighbours.groupBy(a.alias("a"), b.alias("b")).agg(F.max("similarity").alias("similarity"), F.sum("hits").alias("hits"))


class LatentModel:
    """A vocabulary with idf weights and the leading right singular vectors of the TF-IDF matrix: (terms, dims); values: the singular values, where it was fitted just now."""

    def __init__(self, terms: list[str], idf: np.ndarray, factors: np.ndarray, values: np.ndarray | None = None):
        self.terms, self.idf, self.factors, self.values = terms, idf, factors, values

    def save(self, spark, path: str) -> None:
        rows = [(t, float(w), [float(x) for x in f]) for t, w, f in zip(self.terms, self.idf, self.factors, strict=True)]
        spark.createDataFrame(rows, "term string, idf double, factors array<double>").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> LatentModel:
        t = spark.read.parquet(path).orderBy("term").toArrow()  # a row for each term of the bounded vocabulary
        return cls(t.column("term").to_pylist(), np.array(t.column("idf")), np.array(t.column("factors").to_pylist()).reshape(len(t), -1))


def _term_counts(t: pa.Table, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Chunk, code of the term, and 1 + ln(tf) of the terms of whole chunks, in order; and the terms."""
    row, _, code, terms = B.coded(t["w"])
    order, starts = B.runs(of[row], code)
    at = order[starts]
    return of[row[at]], code[at], 1 + np.log(B.lengths(starts, len(order))), terms


def _words(chunks: DataFrame, key: list[str]) -> DataFrame:
    """key and w, the chunk's words, which begin with a letter and have three characters or more; texts are dealt out by key."""
    words = F.regexp_extract_all(F.lower("content"), F.lit("[a-z][a-z0-9_]{2,}"), F.lit(0))
    return B.gathered(chunks.select(*key, "content"), key).select(*key, words.alias("w"))


def _added_up(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(rows, starts, axis=0) if len(starts) else rows[:0]


#: Terms of a block of a product, and tasks whose blocks are added up together.
TERMS, FAN = 4096, 8
#: Entries of a task's rows of factors at a time.
ENTRIES = 1 << 21
_PARTS = "task long, block int, part binary"


def _added(parts: pa.Table) -> pa.Table:
    """One block as the sum of those of several tasks."""
    total = sum(np.frombuffer(p) for p in parts["part"].to_pylist())
    return pa.table({"task": parts["task"][:1], "block": parts["block"][:1], "part": pa.array([total.tobytes()], pa.binary())})


def lsa_fit(chunks: DataFrame, dims: int = 256, min_df: int = 2, most_terms: int = 100_000, rounds: int = 5, seed: int = 42, key: tuple[str, ...] = ("file_path", "chunk_index")) -> LatentModel:
    """Latent semantic analysis: sublinear TF-IDF rows of length one, and a truncated SVD by randomized subspace iteration.

    Each round multiplies by the matrix and its transpose where the rows are, in Arrow batches. The tasks' products are cut into
    blocks of TERMS terms and added up a few tasks at a time, block by block, so what reaches the driver is
    one (terms, dims) matrix a round, bounded by most_terms, however many tasks there are. Terms that fewer than min_df chunks hold are out; of more than most_terms the most frequent stay.
    """
    spark, cols = chunks.sparkSession, list(key)
    words = _words(chunks, cols)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, of in B.whole(batches, cols):
            _, code, x, terms = _term_counts(t, of)
            df, all_ = np.bincount(code, minlength=len(terms)), np.bincount(code, x, len(terms))
            yield pa.RecordBatch.from_arrays([terms, pa.array(df, pa.int64()), pa.array(all_, pa.float64())], ["term", "df", "all"])

    n = chunks.count()
    counts = words.mapInArrow(counted, "term string, df long, all double").groupBy("term").agg(F.sum("df").alias("df"), F.sum("all").alias("all"))
    # sums are added up in another order each time; a fixed number of places keeps equals equal
    top = counts.where(F.col("df") >= min_df).orderBy(F.round("all", 6).desc(), "term").limit(most_terms)
    table = top.toArrow().sort_by("term")
    terms = table.column("term").to_pylist()
    idf = np.log((1 + n) / (1 + np.array(table.column("df"), float))) + 1
    dims = min(dims, len(terms))
    known = spark.sparkContext.broadcast((pa.array(terms, pa.string()), idf))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, of in B.whole(batches, cols):
            chunk, place, x = _weighed(t, of, *known.value)
            ends = pa.array(np.append(np.flatnonzero(np.diff(chunk, prepend=-1)), len(chunk)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(place, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(x))], ["at", "x"])

    rows = words.mapInArrow(weighed, "at array<int>, x array<double>").persist()

    def products(q: np.ndarray):
        def run(batches):
            total = np.zeros_like(q)
            for b in batches:
                at, x = b.column(0), b.column(1)
                place, value = at.flatten().to_numpy(), x.flatten().to_numpy()
                row = np.repeat(np.arange(len(at)), np.diff(at.offsets.to_numpy()))
                value = value / np.sqrt(np.bincount(row, value * value, len(at)))[row]
                size = max(1, ENTRIES // max(1, q.shape[1]))
                for lo in range(0, len(at), step := max(1, size * len(at) // max(1, len(row)))):
                    own = slice(*np.searchsorted(row, (lo, lo + step)))
                    p, w, r = place[own], value[own, None], row[own]
                    if not len(p):
                        continue
                    y = _added_up(q[p] * w, np.flatnonzero(np.diff(r, prepend=-1)))
                    order = np.argsort(p, kind="stable")
                    starts = np.flatnonzero(np.diff(p[order], prepend=-1))
                    among = np.cumsum(np.diff(r, prepend=r[0]) > 0)
                    total[p[order[starts]]] += _added_up((y[among] * w)[order], starts)
            task = TaskContext.get().partitionId()
            for k, lo in enumerate(range(0, len(total), TERMS)):
                yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([k], pa.int32()), pa.array([total[lo : lo + TERMS].tobytes()], pa.binary())], names=["task", "block", "part"])

        return run

    values = np.zeros(0)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(terms), dims)))[0] if terms else np.zeros((0, 0))
    for _ in range(rounds if terms else 0):
        parts, tasks = rows.mapInArrow(products(q), _PARTS), rows.rdd.getNumPartitions()
        while tasks > 1:
            parts = parts.withColumn("task", F.floor(F.col("task") / FAN)).groupBy("task", "block").applyInArrow(_added, _PARTS)
            tasks = -(-tasks // FAN)
        total = np.zeros_like(q)
        for r in parts.toLocalIterator():
            lo = r["block"] * TERMS
            total[lo : lo + TERMS] += np.frombuffer(r["part"]).reshape(-1, q.shape[1])
        q, values, _ = np.linalg.svd(total, full_matrices=False)
    rows.unpersist()
    return LatentModel(terms, idf, q, np.sqrt(values))


def lsa_encode(chunks: DataFrame, model: LatentModel, key: tuple[str, ...] = ("file_path", "chunk_index")) -> DataFrame:
    """key and v, of length one; chunks without a known term have none. The terms' factors are bounded and broadcast; each chunk's are added up where it is."""
    cols = list(key)
    known = chunks.sparkSession.sparkContext.broadcast((pa.array(model.terms, pa.string()), model.idf, model.factors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf, factors = known.value
        for t, of in B.whole(batches, cols):
            chunk, place, x = _weighed(t, of, terms, idf)
            starts = np.flatnonzero(np.diff(chunk, prepend=-1))
            if not len(starts):
                continue
            out = np.zeros((len(starts), factors.shape[1]))
            size = max(1, ENTRIES // max(1, factors.shape[1]))
            among = np.cumsum(np.diff(chunk, prepend=chunk[0]) > 0)
            for lo in range(0, len(chunk), size):
                own = slice(lo, lo + size)
                first = np.flatnonzero(np.diff(among[own], prepend=-1))
                out[among[own][first]] += _added_up(factors[place[own]] * x[own, None], first)
            length = np.sqrt((out * out).sum(1, keepdims=True))
            out = np.divide(out, length, out=out, where=length > 0)
            held = t.select(cols).take(pa.array(np.searchsorted(of, chunk[starts]))).combine_chunks()
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * factors.shape[1], pa.int32()), pa.array(out.reshape(-1)))
            yield from pa.table([*held.columns, v], names=[*cols, "v"]).combine_chunks().to_batches()

    words = _words(chunks, cols)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema if f.name != "w")
    return words.mapInArrow(run, f"{kept}, v array<double>")


def _weighed(t: pa.Table, of: np.ndarray, terms: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk, place in the vocabulary and weight (1 + ln(tf)) * idf of the terms of whole chunks that the vocabulary has."""
    chunk, code, x, own = _term_counts(t, of)
    place = pc.index_in(own, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)[code]
    stays = place >= 0
    return chunk[stays], place[stays], x[stays] * idf[place[stays]]
