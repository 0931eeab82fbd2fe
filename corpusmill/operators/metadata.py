"""Metadata search, rollups and statistics over file rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def search(files: DataFrame, *, name=None, file_type=None, directory=None, modified_after=None, modified_before=None, min_size=None, max_size=None, strict_sizes: bool = False, limit: int | None = 20) -> DataFrame:
    """Conjunction of the filters given, newest first, undated last. strict_sizes: bounds exclude themselves. A filter that is None, 0 or empty is not given."""
    out = files
    if name:
        out = out.where(F.col("file_path").ilike(f"%{name}%"))
    if file_type:
        out = out.where(F.col("file_type").ilike(f"%{file_type}%") | F.col("mime_type").ilike(f"%{file_type}%"))
    if directory:
        out = out.where(F.col("file_path").startswith(directory))
    if modified_after:
        out = out.where(F.col("last_modified") >= F.lit(modified_after).cast("timestamp_ntz"))
    if modified_before:
        out = out.where(F.col("last_modified") <= F.lit(modified_before).cast("timestamp_ntz"))
    size = F.col("file_size")
    if min_size:
        out = out.where(size > min_size if strict_sizes else size >= min_size)
    if max_size:
        out = out.where(size < max_size if strict_sizes else size <= max_size)
    out = out.orderBy(F.desc_nulls_last("last_modified"), "file_path")
    return out.limit(limit) if limit else out


def in_scope(path: Column, scope: str) -> Column:
    """Whether a path lies below a directory; siblings that share its name's beginning don't."""
    return path.startswith(scope.rstrip("/") + "/")


def directory_rollup(files: DataFrame, parent: str = "", limit: int | None = None) -> DataFrame:
    rolled = files.where(F.col("file_path").startswith(parent)).groupBy(X.dirname(F.col("file_path")).alias("directory")).agg(F.count("*").alias("file_count"), F.sum("file_size").alias("total_size"))
    rolled = rolled.orderBy(F.desc("file_count"), "directory")
    return rolled if limit is None else rolled.limit(limit)


def directory_totals(files: DataFrame) -> DataFrame:
    """Every directory with the count and size of all files below it, at any depth."""
    parts = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 2), lambda n: F.array_join(F.slice(parts, 1, n + 1), "/"))
    return files.select(F.explode(above).alias("directory"), "file_size").groupBy("directory").agg(F.count("*").alias("file_count"), F.sum("file_size").alias("total_size"))


def corpus_stats(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size"), F.count_distinct(X.dirname(F.col("file_path"))).alias("n_directories"))


def top_types(files: DataFrame, n: int = 10) -> DataFrame:
    return files.groupBy(F.coalesce("file_type", F.lit("")).alias("file_type")).count().orderBy(F.desc("count"), "file_type").limit(n)


def compound_directories(files: DataFrame, holds: dict[str, str]) -> DataFrame:
    """Directories that hold a file for each condition (a pattern of the file's name, by label)."""
    name = X.basename(F.col("file_path"))
    flags = [F.bool_or(name.like(p)).alias(k) for k, p in holds.items()]
    out = files.groupBy(X.dirname(F.col("file_path")).alias("directory")).agg(*flags)
    for k in holds:
        out = out.where(k)
    return out.select("directory")


def file_info(files: DataFrame, analysis: DataFrame, chunks: DataFrame) -> DataFrame:
    counts = chunks.groupBy("file_path").agg(F.count("*").alias("chunk_count"))
    return files.join(analysis, "file_path", "left").join(counts, "file_path", "left").fillna(0, ["chunk_count"])
