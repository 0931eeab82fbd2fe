"""Feedback graph: edges, recommendation, phase; components and labels; reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def outcome_edges(feedback: DataFrame) -> DataFrame:
    """Accepted, rejected and ignored edges from arrays offered, accepted, rejected."""
    ignored = F.array_except(F.array_except("offered", "accepted"), "rejected")
    kinds = (("accepted", F.col("accepted"), 1.0), ("rejected", F.col("rejected"), -0.5), ("ignored", ignored, 0.0))
    rows = F.flatten(F.array(*[F.transform(c, _edge(kind, weight)) for kind, c, weight in kinds]))
    return feedback.select("context", F.explode(rows).alias("e")).select("context", "e.*")


def _edge(kind: str, weight: float):
    return lambda x: F.struct(x.alias("target_node"), F.lit(kind).alias("edge_type"), F.lit(weight).alias("weight"))


def recommend(edges: DataFrame, similar: DataFrame, threshold: float = 0.5, k: int = 5) -> DataFrame:
    """Targets that similar contexts accepted; confidence = accepted / (accepted + rejected), each summed by similarity; total_weight sums edge weight times similarity.

    similar: source_node, similarity.
    """
    s = edges.where(F.col("edge_type").isin("accepted", "rejected")).join(similar.where(F.col("similarity") >= threshold), "source_node")
    part = lambda kind: F.sum(F.when(F.col("edge_type") == kind, F.col("similarity")).otherwise(0.0))
    sums = s.groupBy("target_node").agg(part("accepted").alias("yes"), part("rejected").alias("no"), F.sum(F.col("weight") * F.col("similarity")).alias("w"))
    total = F.col("yes") + F.col("no")
    rows = sums.where((total > 0) & (F.col("yes") / total >= threshold))
    out = rows.select("target_node", F.bround(F.col("yes") / total, 3).alias("confidence"), F.bround("w", 3).alias("total_weight"), F.bround("yes", 2).alias("accept_count"), F.bround("no", 2).alias("reject_count"))
    return out.orderBy(F.desc("confidence"), F.desc("total_weight"), "target_node").limit(k)


def feedback(edges: DataFrame, similar: DataFrame, limit: int = 10) -> DataFrame:
    """Edges of similar contexts, most similar first, then heaviest; equals go by target (none last), kind and event_id. similar: source_node, similarity."""
    out = edges.join(similar, "source_node")
    return out.orderBy(F.desc("similarity"), F.desc("weight"), F.asc_nulls_last("target_node"), F.asc_nulls_last("edge_type"), F.asc_nulls_last("event_id")).limit(limit)


def feedback_by_text(edges: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Where there are no vectors: edges whose context summary holds the text, in any case."""
    return edges.where(F.contains(F.lower("context_summary"), F.lit(text.lower()))).orderBy("event_id").limit(limit)


def new_nodes(seen: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """Nodes that are seen and not known yet, each once."""
    return seen.select(key).distinct().join(known.select(key), key, "left_anti")


def related(edges: DataFrame, k: int = 20, most: int = 1000) -> DataFrame:
    """Pairs of targets that the most contexts share. A context's targets are paired within its row, so a context of more than `most` targets is an error."""
    own = edges.groupBy("source_node").agg(F.array_sort(F.collect_set("target_node")).alias("t"))
    own = own.where(F.assert_true(F.size("t") <= most, F.lit(f"a context has more than {most} targets")).isNull())
    pairs = F.flatten(F.transform("t", lambda a: F.transform(F.filter("t", lambda b: b > a), lambda b: F.struct(a.alias("concept"), b.alias("related")))))
    return own.select(F.explode(pairs).alias("p")).groupBy("p.concept", "p.related").agg(F.count("*").alias("shared")).orderBy(F.desc("shared"), "concept", "related").limit(k)


def phase(edges: DataFrame) -> DataFrame:
    n = F.col("n_edges")
    ladder = F.when(n == 0, "Cold").when(n < 10, "Learning").when(n < 50, "Warm").otherwise("Hot")
    return edges.agg(F.count("*").alias("n_edges"), F.count_distinct("source_node").alias("n_contexts"), F.count_distinct("target_node").alias("n_targets")).withColumn("phase", ladder)


def components(pairs: DataFrame, shared: str) -> DataFrame:
    """(node, root) of an undirected graph (a, b): minima spread along edges and through roots, a written table a round."""
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    spark, n = pairs.sparkSession, 0
    both.write.mode("overwrite").parquet(f"{shared}/edges")
    both = spark.read.parquet(f"{shared}/edges")
    label = both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("least"))
        new = label.join(near, label.node == near.a).select("node", F.least("root", "least").alias("root"), F.col("root").alias("old"))
        up = new.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = new.join(up, "root").select("node", "above", "old").withColumnRenamed("above", "root")
        new.write.mode("overwrite").parquet(f"{shared}/{n}")
        label, n = spark.read.parquet(f"{shared}/{n}"), n + 1
        if not label.where("root <> old").limit(1).count():
            return label.select("node", "root")
        label = label.drop("old")


def labels(component: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each component its hub and the next two by degree."""
    degree = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("degree"), "node"))
    top = component.join(degree, "node").withColumn("rank", rank).where("rank <= 3")
    return top.groupBy("root").agg(F.array_join(F.array_sort(F.collect_list(F.struct("rank", F.col("node").cast("string").alias("name")))).getField("name"), " + ").alias("label"))


def hops(pairs: DataFrame, start, shared: str, most: int = 5) -> DataFrame:
    """Least number of edges from start to each node, up to `most`: a frontier a round, each round a written table."""
    spark = pairs.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{shared}/{name}")
        return spark.read.parquet(f"{shared}/{name}")

    both = written(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    seen = written(spark.range(1).select(F.lit(start).alias("node"), F.lit(0).alias("hops")), "0")
    frontier = seen
    for n in range(1, most + 1):
        reached = both.join(frontier.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        frontier = written(reached.join(seen, "node", "left_anti").withColumn("hops", F.lit(n)), str(n))
        if not frontier.limit(1).count():
            break
        seen = seen.union(frontier)
    return seen
