"""Sessions, nodes and edges of the memory graph: upserts, the searchable session node, search by keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X


def upsert_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sessions (id, cwd, project, started_at, ended_at, keywords): of a known id only ended_at and keywords change, to the new row's."""
    fresh = new.select("id", *[F.col(c).alias(f"new_{c}") for c in new.columns if c != "id"], F.lit(True).alias("found"))
    both = old.withColumn("known", F.lit(True)).join(fresh, "id", "full")
    kept = lambda c: F.when(F.col("known"), F.col(c)).otherwise(F.col(f"new_{c}")).alias(c)
    replaced = lambda c: F.when(F.col("found"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    return both.select("id", *[(replaced if c in ("ended_at", "keywords") else kept)(c) for c in old.columns if c != "id"])


def session_nodes(sessions: DataFrame, app: str, most: int = 20) -> DataFrame:
    """The searchable node of each session: id, type, label 'project — date (app)', source, and its first keywords as text."""
    label = F.concat(F.col("project"), F.lit(" — "), F.date_format("started_at", "yyyy-MM-dd"), F.lit(f" ({app})"))
    source = F.concat(F.lit("session:"), F.col("id"))
    return sessions.select(X.short_hash(F.lit("session"), source).alias("id"), F.lit("session").alias("type"), label.alias("label"), source.alias("source"), F.array_join(F.slice("keywords", 1, most), " ").alias("keywords"))


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges by (from_id, to_id, relation): score, created_at and session_id are those of the latest row, the new table's among equals."""
    key = ["from_id", "to_id", "relation"]
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in old.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("__new", "created_at")).alias("r")).select(*key, "r.*")


def search_nodes(nodes: DataFrame, keywords: list[str], k: int = 10) -> DataFrame:
    """Nodes that any keyword finds in label or keywords: k of each keyword by id, in the order of the keywords, each node once, k in all."""
    wanted = [(i, safe) for i, w in enumerate(keywords) if (safe := _safe(w))]
    text = F.concat_ws(" ", "label", "keywords")
    spaced = F.concat(F.lit(" "), F.array_join(X.tokens(text), " "), F.lit(" "))
    hits = F.filter(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(w).alias("w")) for i, w in wanted]), lambda x: F.contains(spaced, x["w"])) if wanted else F.array().cast("array<struct<at:int,w:string>>")
    found = nodes.withColumn("hit", F.explode(hits)).select("id", "label", F.col("hit.at").alias("at"))
    rank = F.row_number().over(Window.partitionBy("at").orderBy("id"))
    first = found.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("id", "label").agg(F.min(F.struct("at", "rank")).alias("first"))
    return first.orderBy("first").limit(k).select("id", "label", F.col("first.at").alias("keyword"))


def _safe(word: str) -> str:
    """A keyword as a run of words between spaces; empty if nothing is left of it."""
    import re

    words = re.findall(r"[^\W_]+", word.replace("'", "").replace('"', "").strip("-+^():").lower())
    return f" {' '.join(words)} " if words else ""


def newest_nodes(nodes: DataFrame, schema: str, limit: int = 10) -> DataFrame:
    """Nodes with their metadata (JSON text) parsed, last seen first."""
    return nodes.withColumn("metadata", F.from_json("metadata", schema)).orderBy(F.desc("last_seen"), "id").limit(limit)


def overlaid(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Values of both tables by key; where both have one, a's."""
    return a.select(key, F.col(value).alias("__a")).join(b.select(key, F.col(value).alias("__b")), key, "full").select(key, F.coalesce("__a", "__b").alias(value))


def heat(signals: DataFrame, key: str, time: str) -> DataFrame:
    """How often each key was signalled, and when last."""
    return signals.groupBy(key).agg(F.count("*").alias("n"), F.max(time).alias("last"))


def usage_band(share: Column) -> Column:
    """How full a context is."""
    return F.when(share >= 0.9, "critical").when(share >= 0.75, "high").when(share >= 0.5, "medium").otherwise("low")


def context_lines(ranked: DataFrame, k: int = 8) -> DataFrame:
    """The context text of each session: a line for each of its best nodes with the tag of its pools. ranked: session, rank, node, pools."""
    line = F.format_string("[%s] %s", "pools", "node")
    return ranked.where(F.col("rank") <= k).groupBy("session").agg(F.array_join(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).getField("line"), "\n").alias("context"))
