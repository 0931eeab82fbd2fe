"""Conversation transcripts: JSON lines whose content is a string or a list of typed blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def content_text(content: Column) -> Column:
    """The text of a content VARIANT: itself, or its text blocks joined by line feeds."""
    blocks = F.expr("try_variant_get({0}, '$', 'array<struct<type:string,text:string>>')".replace("{0}", "content"))
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    return F.when(F.schema_of_variant(content).startswith("ARRAY"), joined).otherwise(F.try_variant_get(content, "$", "string"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0), value of text files; a large file is read by several tasks.

    A line's number is its place in its block of the file plus the lines of the blocks before; only blocks are joined and summed, not texts.
    """
    at = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    blocks = at.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    return at.join(blocks.select("file", "block", (F.col("first") - before).alias("base")), ["file", "block"]).select("file", (F.col("id") - F.col("base")).alias("line"), "value")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """file, line, role, text of each line that parses; others are dropped."""
    parsed = lines(spark, path).withColumn("v", F.try_parse_json("value")).where("v is not null")
    return parsed.select("file", "line", F.try_variant_get("v", "$.role", "string").alias("role"), F.try_variant_get("v", "$.content", "variant").alias("content")).where("content is not null").select("file", "line", "role", content_text(F.col("content")).alias("text"))


def feedback_csv(spark: SparkSession, path: str) -> DataFrame:
    """Edge rows of a feedback graph kept as CSV."""
    return spark.read.schema("timestamp string, source_node string, edge_type string, target_node string, weight double, context_summary string, command string").csv(path, header=True)
