"""Changes as derivations of new table versions: upserts, replacement, copies by hash, signals, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """Rows of both, the latest version of each key; of equal versions, the new table's."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    latest = Window.partitionBy(*key).orderBy(F.desc(version), F.desc("__new"))
    return both.withColumn("__rn", F.row_number().over(latest)).where("__rn = 1").drop("__rn", "__new")


def merge_nodes(sightings: DataFrame) -> DataFrame:
    """Nodes from sightings (node_id, label, seen, metadata): first label and time stay, last time and metadata replace."""
    return sightings.groupBy("node_id").agg(F.min_by("label", "seen").alias("label"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.max_by("metadata", "seen").alias("metadata"))


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"))


def replace_children(old: DataFrame, new: DataFrame, parent: str = "file_path") -> DataFrame:
    """Children of the parents in new give way to new's."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def copy_by_hash(files: DataFrame, analysed: DataFrame) -> DataFrame:
    """Unanalysed files whose content hash is known, with the source (smallest path) to copy from."""
    known = files.join(analysed, "file_path", "left_semi").groupBy("file_hash").agg(F.min("file_path").alias("source_path"))
    return files.join(analysed, "file_path", "left_anti").join(known, "file_hash").select("file_path", "source_path")


def signals(sightings: DataFrame, key: list[str], order: str) -> DataFrame:
    """Each key once: the first sighting's time, and whether it is the only one."""
    return sightings.groupBy(*key).agg(F.min(order).alias("first_seen"), (F.count("*") == 1).alias("is_new"))


def orphans(children: DataFrame, parents: DataFrame, key: str = "file_path") -> DataFrame:
    return children.join(parents, key, "left_anti")
