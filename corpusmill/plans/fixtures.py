"""Tables of the data model derived from the test tables: as DataFrames, and as a WITH list for the SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File rows: path, hash, size, type, mime type, time; and the text."""
    d = F.col("doc_id")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".py", ".md", ".txt", ".sql", ".rst")]), (d % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("/corpus/"), "lang", F.lit("/"), "source", F.lit("/doc_"), d.cast("string"), ext).alias("file_path"),
        F.md5("text").alias("file_hash"),
        F.col("n_chars").alias("file_size"),
        ext.alias("file_type"),
        F.when(d % 5 == 0, "text/x-python").when(d % 5 == 1, "text/markdown").otherwise("text/plain").alias("mime_type"),
        F.when(d % 17 != 0, F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int), 0)")).alias("last_modified"),
        F.col("text").alias("content"),
        "lang",
        "source",
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback edges: context, file, kind, weight, time."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.concat(F.lit("context:"), F.left(F.md5((F.col("user_id") % 40).cast("string")), F.lit(8))).alias("source_node"),
        F.when(kind == "purchase", "accepted").when(kind == "error", "rejected").when(kind == "signup", "discusses").otherwise("ignored").alias("edge_type"),
        F.when(kind == "purchase", 1.0).when(kind == "error", -0.5).when(kind == "signup", 0.5).otherwise(0.0).alias("weight"),
        F.concat(F.lit("file:"), F.get_json_object("props", "$.k")).alias("target_node"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    cwd = F.concat(F.lit("/work/p"), (c % 7).cast("string"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns")).select(
        F.left(F.sha2(F.concat(cwd, F.lit("|"), c.cast("string")), 256), F.lit(16)).alias("id"),
        cwd.alias("cwd"),
        F.concat(F.lit("p"), (c % 7).cast("string")).alias("project"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id as int), 0, 0)").alias("started_at"),
        "turns",
        "conv_id",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.concat(F.lit("/vec/"), F.expr("vec_id div 5").cast("string")).alias("file_path"), (v % 5).cast("int").alias("chunk_index"), "label", F.col("embedding").cast("array<double>").alias("v")
    )


FILES_SQL = """files AS (
  SELECT doc_id, '/corpus/' || lang || '/' || source || '/doc_' || doc_id || ext AS file_path, md5(text) AS file_hash, n_chars AS file_size, ext AS file_type,
         CASE doc_id % 5 WHEN 0 THEN 'text/x-python' WHEN 1 THEN 'text/markdown' ELSE 'text/plain' END AS mime_type,
         CASE WHEN doc_id % 17 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) END AS last_modified, text AS content, lang, source
  FROM (SELECT *, CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.txt' WHEN 3 THEN '.sql' ELSE '.rst' END AS ext FROM documents))"""
EDGES_SQL = """edges AS (
  SELECT event_id, ts, 'context:' || left(md5(CAST(user_id % 40 AS VARCHAR)), 8) AS source_node,
         CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'discusses' ELSE 'ignored' END AS edge_type,
         CAST(CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'error' THEN -0.5 WHEN 'signup' THEN 0.5 ELSE 0.0 END AS DOUBLE) AS weight,
         'file:' || json_extract_string(props, '$.k') AS target_node
  FROM events)"""
SESSIONS_SQL = """sessions AS (
  SELECT left(sha256('/work/p' || conv_id % 7 || '|' || conv_id), 16) AS id, '/work/p' || conv_id % 7 AS cwd, 'p' || conv_id % 7 AS project,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) AS started_at, count(*) AS turns, conv_id
  FROM conversations GROUP BY conv_id)"""
VECTORS_SQL = """vectors AS (
  SELECT vec_id, '/vec/' || vec_id // 5 AS file_path, CAST(vec_id % 5 AS INTEGER) AS chunk_index, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""
#: Lines greedily packed to 350, by a loop over a text's lines.
CHUNKS_SQL = (
    FILES_SQL
    + """,
lines AS (SELECT file_path, unnest(range(len(string_split(content, chr(10))))) AS i, unnest(string_split(content, chr(10))) AS line FROM files WHERE content <> ''),
packed AS (
  SELECT file_path, i, line, 0 AS chunk_index, length(line) + 1 AS size FROM lines WHERE i = 0
  UNION ALL
  SELECT l.file_path, l.i, l.line, p.chunk_index + CASE WHEN p.size + length(l.line) + 1 > 350 THEN 1 ELSE 0 END,
         CASE WHEN p.size + length(l.line) + 1 > 350 THEN 0 ELSE p.size END + length(l.line) + 1
  FROM packed p JOIN lines l ON l.file_path = p.file_path AND l.i = p.i + 1),
chunks AS (SELECT file_path, CAST(chunk_index AS INTEGER) AS chunk_index, string_agg(line, chr(10) ORDER BY i) AS content FROM packed GROUP BY file_path, chunk_index)"""
)
