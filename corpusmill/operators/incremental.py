"""Incremental work: what is new, changed, half done or missing; run log; delta and major tiers of vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def since(files: DataFrame, last_scan: Column | None, force: bool = False) -> DataFrame:
    """Files modified after the last scan began; without a last scan, or with force, all. A file that arrives late with an older time is not seen."""
    return files if force or last_scan is None else files.where(F.col("last_modified") > last_scan)


def to_process(found: DataFrame, known: DataFrame, chunks: DataFrame, analysis: DataFrame) -> DataFrame:
    """Files that are not known at their time of modification, or whose chunks or analysis are missing."""
    whole = known.join(chunks.select("file_path").distinct(), "file_path", "left_semi").join(analysis.select("file_path").distinct(), "file_path", "left_semi")
    return found.join(whole.select("file_path", "last_modified"), ["file_path", "last_modified"], "left_anti")


def missing(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows that have no result yet: what a resumed backfill goes on with."""
    return rows.join(done.select(*key), key, "left_anti")


def versions_to_index(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files with the state that the index has them in: new, modified; unchanged ones are left out."""
    was = indexed.groupBy("file_path").agg(F.max("version").alias("was"))
    both = files.join(was, "file_path", "left").withColumn("state", F.when(F.col("was").isNull(), "new").when(F.col("version") > F.col("was"), "modified"))
    return both.where("state is not null").drop("was")


def next_step(major: DataFrame, pending: DataFrame) -> DataFrame:
    """rebuild where nothing is indexed, add where something is pending, else report."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    step = F.when(F.col("indexed") == 0, "rebuild").when(F.col("pending") > 0, "add").otherwise("report")
    return n(major, "indexed").crossJoin(n(pending, "pending")).withColumn("step", step)  # one row each


def run_summary(outcomes: DataFrame, statuses: list[str]) -> DataFrame:
    """One row of a run log: files, how many came out with each status, and these as a JSON bag. outcomes: file_path, status."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in statuses]
    row = outcomes.agg(F.count("*").alias("files"), *counts)
    return row.withColumn("stats", F.to_json(F.struct(*statuses)))


def appended(row: DataFrame, path: str) -> None:
    row.write.mode("append").parquet(path)


#: Tables that rows may be deleted from.
DELETABLE = ("files", "chunks", "analysis", "directories", "runs")


def without(rows: DataFrame, table: str, keys: DataFrame | None = None, key: str = "file_path") -> DataFrame:
    """A table's rows without those of the keys, or without any; other tables than DELETABLE are refused."""
    if table not in DELETABLE:
        raise ValueError(f"rows of {table} are not deleted")
    return rows.limit(0) if keys is None else rows.join(keys.select(key), key, "left_anti")


def rewritten(rows: DataFrame, path: str, files: int) -> None:
    """A table's rows in so many files, in a new place."""
    rows.repartition(files).write.parquet(path)


def with_vectors(rows: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """rows with v from vectors where these have one, else their own."""
    new = vectors.select(key, F.col("v").alias("__v"))
    return rows.join(new, key, "left").withColumn("v", F.coalesce("__v", "v")).drop("__v")


def added(major: DataFrame, minor: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(minor tier with the new vectors, tombstones of the major tier's vectors of the same files)."""
    files = new.select("file_path").distinct()
    stale = major.join(files, "file_path", "left_semi").select("vec_id")
    return minor.join(files, "file_path", "left_anti").unionByName(new), stale


def merged(major: DataFrame, minor: DataFrame) -> DataFrame:
    """The major tier after compaction; tombstones stay valid, as ids do."""
    return major.unionByName(minor)


def tier_stats(major: DataFrame, minor: DataFrame, tombstones: DataFrame, most: int = 1000, share: float = 0.1) -> DataFrame:
    """name and n of what the tiers hold, and whether compaction is due (1 or 0)."""
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    rows = [count(major, "major"), count(minor, "minor"), count(tombstones, "stale")]
    both = rows[0].select(F.col("n").alias("a")).crossJoin(rows[1].select(F.col("n").alias("b")))  # one row each
    due = both.select(F.lit("needs_compaction").alias("name"), ((F.col("b") >= most) | (F.col("b") > share * F.col("a"))).cast("long").alias("n"))
    return reduce(DataFrame.unionByName, [*rows, due])
