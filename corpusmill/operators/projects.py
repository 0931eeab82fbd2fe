"""Projects: files grouped under roots by their first path part, seeds, active names, and the project of a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def project_of(path: Column, roots: list[str]) -> Column:
    """The path part after the longest root that holds the path, or null."""
    out = F.lit(None).cast("string")
    for root in sorted(roots, key=len):
        r = root.rstrip("/") + "/"
        out = F.when(path.startswith(r), F.nullif(F.split_part(F.substring(path, F.lit(len(r) + 1), F.length(path)), F.lit("/"), F.lit(1)), F.lit(""))).otherwise(out)
    return out


def discover(files: DataFrame, roots: list[str], suffix: str = ".md", least: int = 1) -> DataFrame:
    """Projects with files of the suffix: project, n_files, and the seed file: a README, else a CLAUDE, else the first by path."""
    found = files.where(F.col("file_path").endswith(suffix)).select("file_path", project_of(F.col("file_path"), roots).alias("project")).where("project is not null")
    name = F.upper(X.basename(F.col("file_path")))
    rank = F.when(name.startswith("README"), 0).when(name.startswith("CLAUDE"), 1).otherwise(2)
    return found.groupBy("project").agg(F.count("*").alias("n_files"), F.min_by("file_path", F.struct(rank, "file_path")).alias("seed")).where(F.col("n_files") >= least)


def active_names(text: Column) -> Column:
    """Names in headings of the form '## 3. name'."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^##\s+\d+\.\s+(\S+)"), F.lit(1))


def latest_other(transcripts: DataFrame, current: str) -> DataFrame:
    """The transcript that was modified last, other than the current one. transcripts: path, modified."""
    return transcripts.where(F.col("path") != current).agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def without_signal(concepts: DataFrame, signals: DataFrame, most: int = 10_000) -> DataFrame:
    """Concepts that no signal's text holds; the concepts are a bounded list, and the signals are reduced to the concepts they hold where they are."""
    names = [r[0] for r in concepts.select("concept").distinct().orderBy("concept").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} concepts")
    held = signals.select(F.explode(F.filter(F.lit(names), lambda c: F.contains(F.lower("text"), F.lower(c)))).alias("concept")).distinct()
    return concepts.join(held, "concept", "left_anti")
