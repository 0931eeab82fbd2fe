"""The tool API: one method a tool, each giving a DataFrame; envelopes as JSON."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunking, fulltext, graph, keywords, metadata, vector


@dataclass
class Tools:
    """Tables that the tools read: files, chunks (file_path, chunk_index, content), analysis (file_path, keywords, ...), vectors (vec_id, file_path, chunk_index, v), edges."""

    files: DataFrame
    chunks: DataFrame
    analysis: DataFrame
    vectors: DataFrame
    edges: DataFrame

    def search_files(self, **filters) -> DataFrame:
        return metadata.search(self.files, **filters)

    def full_text_search(self, query: str, limit: int = 20) -> DataFrame:
        return fulltext.search_files(self.chunks, self.files, query, limit)

    def get_file_info(self, path: str) -> DataFrame:
        mine = lambda df: df.where(F.col("file_path") == path)
        return metadata.file_info(mine(self.files), mine(self.analysis), mine(self.chunks))

    def get_file_chunks(self, path: str, index: int | None = None) -> DataFrame:
        own = self.chunks.where(F.col("file_path") == path)
        return (own if index is None else own.where(F.col("chunk_index") == index)).orderBy("chunk_index")

    def list_directories(self, parent: str = "", limit: int = 50) -> DataFrame:
        return metadata.directory_rollup(self.files, parent, limit)

    def search_by_keywords(self, words: list[str], limit: int = 20) -> DataFrame:
        return keywords.search(self.analysis.join(self.files.select("file_path", "last_modified"), "file_path"), words, limit)

    def get_stats(self) -> DataFrame:
        return metadata.corpus_stats(self.files)

    def semantic_search(self, query: list[float], k: int = 10, scope: str | None = None, around: int = 0) -> DataFrame:
        """The k nearest chunks with their files' rows and a preview; around: neighbours to either side, joined into the preview."""
        return vector.search_files(self.vectors, self.chunks, self.files, query, k, scope, around)

    def recall(self, query: list[float], k: int = 5, scope: str | None = None) -> DataFrame:
        own = self.vectors if scope is None else self.vectors.where(metadata.in_scope(F.col("file_path"), scope))
        return vector.recall(own, self.chunks, query, k)

    def log_autograph(self, feedback: DataFrame) -> DataFrame:
        """The edges with those of new feedback (context, offered, accepted, rejected)."""
        new = graph.outcome_edges(feedback).select(F.col("context").alias("source_node"), "target_node", "edge_type", "weight")
        return self.edges.select("source_node", "target_node", "edge_type", "weight").unionByName(new)

    def query_autographs(self, similar: DataFrame, limit: int = 10) -> DataFrame:
        return graph.feedback(self.edges, similar, limit)

    def autograph_suggest(self, similar: DataFrame, threshold: float = 0.5, k: int = 5) -> DataFrame:
        return graph.recommend(self.edges, similar, threshold, k)

    def autograph_stats(self) -> DataFrame:
        return graph.phase(self.edges)

    def store_file(self, path: str, text: DataFrame) -> DataFrame:
        """The chunks with those of one file (file_path, content) replaced."""
        from .maintenance import replace_children

        return replace_children(self.chunks, chunking.chunk_code(text.where(F.col("file_path") == path)))

    def search(self, method: str, what, **how) -> DataFrame:
        """One door to metadata, fulltext, keyword and semantic search; the last is what an unknown method means."""
        doors = {"metadata": lambda: self.search_files(name=what, **how), "fulltext": lambda: self.full_text_search(what, **how), "keyword": lambda: self.search_by_keywords(what, **how)}
        return doors.get(method, lambda: self.semantic_search(what, **how))()


def envelope(results: DataFrame, kind: str, hints: list[str]) -> DataFrame:
    """One JSON text: status, query metadata, the (few) results in their order, usage hints, and a summary of files and scores."""
    rows = F.collect_list(F.struct(*results.columns))
    score = F.round(F.avg("similarity"), 4) if "similarity" in results.columns else F.lit(None).cast("double")
    body = results.agg(rows.alias("results"), F.count("*").alias("n"), F.count_distinct("file_path").alias("files"), score.alias("score"))
    return body.select(
        F.to_json(
            F.struct(
                F.lit("success").alias("status"),
                F.struct(F.lit(kind).alias("type"), F.col("n").alias("total")).alias("query_metadata"),
                "results",
                F.lit(hints).alias("usage_hints") if hints else F.array().cast("array<string>").alias("usage_hints"),
                F.struct(F.col("files").alias("unique_files"), F.col("score").alias("average_score")).alias("summary"),
            )
        ).alias("response")
    )
