"""File trees as DataFrames: discovery rules, metadata rows, decoded text. All through Spark's own readers."""

from __future__ import annotations

import os
import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

#: Names of directories never entered (those with a leading dot are hidden anyway), patterns of directory names,
#: names of files never read, suffixes read as text, limits.
SYSTEM = (
    "__pycache__", "node_modules", "venv", "env", "virtualenv", "site-packages", "Lib", "conda-env", "conda-envs", "build", "dist", "out",
    "target", "bin", "obj", "vendor", "Pods", "coverage", "htmlcov", "logs", "log", "Thumbs.db",
)
DENIED = ("linux-6.*", "linux-6*", "kernel-*", "llvm-project*", "chromium*", "gecko-dev*", "webkit*")
NEVER = ("thumbs.db", "desktop.ini", "package-lock.json", "yarn.lock")
TEXT = (".md", ".txt", ".py")
MOST_BYTES, MOST_HASHED, MOST_PARTS = 100 * 2**20, 10 * 2**20, 20


def under(path: Column, roots: list[str]) -> Column:
    """Whether a path is one of the roots or below it."""
    out = F.lit(False)
    for r in roots:
        out = out | (path == r) | path.startswith(r.rstrip("/") + "/")
    return out


def hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda p: p.startswith(".") & ~p.isin(".", ".."))


def _glob(pattern: str) -> str:
    return "(?s)\\A" + re.escape(pattern).replace(r"\*", ".*").replace(r"\?", ".") + "\\z"


def skip_reason(directory: Column, allowed: list[str] | None = None, denied: tuple[str, ...] = DENIED) -> Column:
    """Why a directory is left out, or null; the first rule that holds. `denied` are patterns of * and ? for its name."""
    name = X.basename(directory)
    matches = F.lit(False)
    for pattern in denied:
        matches = matches | name.rlike(_glob(pattern))
    return (
        F.when(under(directory, allowed or []), F.lit(None).cast("string"))
        .when(hidden(directory), "hidden")
        .when(name.isin(*SYSTEM), "system")
        .when(matches, "denied")
        .when(F.size(F.split(directory, "/")) > MOST_PARTS, "too deep")
    )


def _found(spark: SparkSession, root: str, allowed: list[str] | None, denied: tuple[str, ...], suffixes: tuple[str, ...]) -> DataFrame:
    """binaryFile rows below root that the rules let through; names are tested before any byte is read, content only if selected."""
    any_case = ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s.lower()) for s in suffixes)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{{{any_case}}}").load(root)
    found = raw.withColumn("file_path", F.regexp_replace("path", "^file:/+", "/"))
    base = (root if ":/" in root else os.path.abspath(root)).rstrip("/")
    n, path = len(re.sub("^file:/+", "/", base).split("/")), F.col("file_path")
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(n), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    clear = F.when(F.size(parts) > n, ~F.exists(above, lambda d: skip_reason(d, allowed, denied).isNotNull())).otherwise(True)
    name = X.basename(path)
    return found.where(clear & (~hidden(path) | under(path, allowed or [])) & X.suffix(path).isin(*suffixes) & ~F.lower(name).isin(*NEVER))


def discover(
    spark: SparkSession, root: str, since: datetime | None = None, allowed: list[str] | None = None, denied: tuple[str, ...] = DENIED, suffixes: tuple[str, ...] = TEXT
) -> DataFrame:
    """Paths, sizes and times of the files to process, no bytes read; with `since`, only those modified after it. Files over 100 MB are left out.

    A root without a scheme is a local path. Spark lists no file or directory whose name starts with an underscore.
    """
    found = _found(spark, root, allowed, denied, suffixes).where(F.col("length") <= MOST_BYTES)
    if since is not None:
        found = found.where(F.col("modificationTime") > F.lit(since))
    return found.select("file_path", F.col("length").alias("file_size"), F.col("modificationTime").alias("last_modified"))


def crawl(spark: SparkSession, root: str, allowed: list[str] | None = None, denied: tuple[str, ...] = DENIED, suffixes: tuple[str, ...] = TEXT) -> DataFrame:
    """Metadata rows of the files below root that the rules let through, with their text; files over 100 MB are rows without text, never read."""
    found = _found(spark, root, allowed, denied, suffixes)
    size, kind = F.col("length"), X.suffix(F.col("file_path"))
    binary = F.contains(F.substring(F.col("content"), 1, 1024), F.lit(b"\x00"))
    as_utf8 = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(as_utf8), as_utf8).otherwise(F.decode("content", "ISO-8859-1"))

    def rows(df: DataFrame, file_hash: Column, status: Column, content: Column) -> DataFrame:
        return df.select(
            "file_path", file_hash.alias("file_hash"), size.alias("file_size"), kind.alias("file_type"),
            F.col("modificationTime").alias("last_modified"), status.alias("processing_status"), content.alias("content"),
        )

    read = rows(found.where(size <= MOST_BYTES), F.when(size > MOST_HASHED, "too_large").otherwise(F.md5("content")), F.when(binary, "binary").otherwise("success"), F.when(~binary, text))
    return read.union(rows(found.where(size > MOST_BYTES), F.lit("too_large"), F.lit("size_limit_exceeded"), F.lit(None).cast("string")))


def changed(found: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """Files not known at their time of modification; all of them with force."""
    return found if force else found.join(known.select("file_path", "last_modified"), ["file_path", "last_modified"], "left_anti")
