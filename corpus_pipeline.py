"""Training-data pipeline: quality rules, line dedup, near-duplicate join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a
DataFrame that is written as Parquet and read back as the next stage's docs. All but the
last return the columns of documents; texts that change bring n_chars up to date. The last returns the
pieces of packed sequences. Null ids and texts, repeated rows and empty tables are treated as
the operators' docstrings say; columns beside doc_id and text pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import documents, hash_pair, stored
from corpusmill.llm.decontaminate import decontaminate
from corpusmill.llm.jaccard import BROADCAST_ROWS, jaccard_components
from corpusmill.llm.lines import drop_shared_lines
from corpusmill.llm.packing import pack
from corpusmill.llm.quality import fit, keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules and the isolation forest keep."""
    return keep_good(docs, fit(docs, documents(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of ten code points or more that a smaller id holds too."""
    out = drop_shared_lines(docs.withColumnsRenamed({c: f"__own_{c}" for c in ("n_lines", "n_dropped") if c in docs.columns}))
    out = out.drop("n_lines", "n_dropped").withColumnsRenamed({f"__own_{c}": c for c in ("n_lines", "n_dropped")})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of Jaccard links (five words, 0.8): the smallest id.

    Rows with a null id are documents of their own, below all others, one for each text; of rows with equal id and
    text one stays. Different texts of one id are one document and stay or go together.
    """
    one, two = hash_pair(F.col("text"))
    low = F.lit(-(2**63) + 1) + one.bitwiseAND(F.lit(2**61 - 1))
    own = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), low), "__one": one, "__two": two})
    others = jaccard_components(own, k=5, num=80, den=100, id_col="__id").where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    kept = own.join(others, F.col("__id") == F.col("__gone"), "left_anti")
    row = ["__id", "__one", "__two"]
    repeated = stored(own.groupBy(*row).count().where("count > 1").select(*row))
    n = repeated.count()
    if n:
        repeated = F.broadcast(repeated) if n <= BROADCAST_ROWS else repeated
        kept = kept.join(repeated, row, "left_anti").unionByName(kept.join(repeated, row, "left_semi").dropDuplicates(row))
    return kept.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window like a benchmark item."""
    return decontaminate(docs, documents(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 2048 tokens; workers keep little in memory, since earlier stages have filled the executors' heaps."""
    return pack(docs, remembered=300_000, batch_bytes=2_500_000)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The forest, the links' components and the plan can't be said in SQL; tests hold near duplicates and the operators that the stages call against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
