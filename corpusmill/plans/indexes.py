"""Queries over kept structures: the vector index and ranking state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import english
from ..functions import text as X
from ..operators import text_index as P
from ..operators import vector_index as I
from ..operators import versions as W
from .catalog import _folder, _query
from .fixtures import FILES_SQL, VECTORS_SQL, files, table, vectors

_ASKED_SQL = f"WITH {VECTORS_SQL}, r AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.v, v.v) AS s FROM vectors q JOIN vectors v ON TRUE WHERE q.vec_id % 20 = 0), t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INTEGER) AS rank FROM r)"


def _asked(spark, sf):
    """The query set: every vector whose id is divisible by 20."""
    return vectors(spark, sf).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "v")


@_query("vector_index_exact", f"{_ASKED_SQL} SELECT query_id, vec_id, rank, round(s, 6) AS similarity FROM t WHERE rank <= 10")
def vector_index_exact(spark, sf):
    """The ten nearest of each query by the index, lists left out only where their bound allows."""
    index = I.VectorIndex.build(vectors(spark, sf), _folder(spark))
    return index.search(_asked(spark, sf), 10, exact=True).select("query_id", "vec_id", "rank", F.round("similarity", 6).alias("similarity"))


@_query("vector_index_search")
def vector_index_search(spark, sf):
    """The ten nearest that the index finds in the lists that it looks into; vector_index_recall measures it."""
    index = I.VectorIndex.build(vectors(spark, sf), _folder(spark))
    return index.search(_asked(spark, sf), 10).select("query_id", "vec_id", "rank", F.round("similarity", 6).alias("similarity"))


@_query("vector_index_recall", f"{_ASKED_SQL} SELECT count(*) AS wanted, TRUE AS enough FROM t WHERE rank <= 10")
def vector_index_recall(spark, sf):
    """Hits of a full scan, and whether the index finds at least nine tenths of them."""
    index, asked = I.VectorIndex.build(vectors(spark, sf), _folder(spark)), _asked(spark, sf)
    return I.recall(index.search(asked, 10), I.scanned(vectors(spark, sf), asked, 10)).select("wanted", (F.col("recall") >= 0.9).alias("enough"))


@_query("stream_ranking")
def stream_ranking(spark, sf):
    """Each conversation as a session: user turns feed pool A with their words, the assistant's feed pool B; what each turn shows and what changed."""
    from ..streaming.events import drained
    from ..streaming.ranking import ranked

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        c = spark.readStream.schema(table(spark, sf, "conversations").schema).parquet(f"{sf}/conversations.parque[t]").where("role <> 'system'")
        words = F.array_distinct(X.tokens(F.col("text")))
        pool = lambda role: F.when(F.col("role") == role, words).otherwise(F.array().cast("array<string>"))
        turns = c.select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("at"), pool("user").alias("a"), pool("assistant").alias("b"))
        return drained(ranked(turns), _folder(spark), "append").withColumn("score", F.round("score", 6))
    finally:
        spark.conf.set(name, before)


_PLACES = "p AS (SELECT file_path, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT file_path, regexp_extract_all(lower(content), 'WORD') AS w FROM {source}))"


def _documents(df, content):
    return df.select(F.col("file_path").alias("doc"), F.lit(0).alias("at"), content.alias("content"))


@_query("fts_cover_density", f"""WITH {FILES_SQL}, {_PLACES.format(source="files")}, q AS (SELECT *, lag(term) OVER w AS before, lag(pos) OVER w AS place FROM p WHERE term IN ('of', 'the') WINDOW w AS (PARTITION BY file_path ORDER BY pos))
SELECT file_path AS doc, round(sum(0.1 / CAST(pos - place AS DOUBLE)), 6) AS rank, CAST(count(*) AS INTEGER) AS covers FROM q WHERE before <> term GROUP BY 1""")
def fts_cover_density(spark, sf):
    """All files with both words, by cover density. With two words, each pair of neighbours that differ is a cover."""
    index = P.TextIndex(spark, _folder(spark))
    index.put(_documents(files(spark, sf), F.col("content")), 0)
    return index.search("of the", None).withColumn("rank", F.round("rank", 6))


@_query("fts_index_maintained", f"""WITH {FILES_SQL}, live AS (SELECT file_path, CASE WHEN doc_id % 5 = 0 THEN lang || ' ' || source || ' moved' ELSE content END AS content FROM files WHERE doc_id % 7 <> 0), {_PLACES.format(source="live")}
SELECT term, count(DISTINCT file_path) AS docs, count(*) AS occurrences FROM p GROUP BY 1""")
def fts_index_maintained(spark, sf):
    """Every live term after all files were put in, a fifth was written anew, a seventh deleted, and the segments merged."""
    f, index = files(spark, sf), P.TextIndex(spark, _folder(spark))
    index.put(_documents(f, F.col("content")), 0)
    index.put(_documents(f.where("doc_id % 5 = 0 or doc_id % 7 = 0"), F.when(F.col("doc_id") % 7 != 0, F.concat_ws(" ", "lang", "source", F.lit("moved")))), 1)
    index.merge(2)
    return P.documents_of(index)


@_query("fts_fragment")
def fts_fragment(spark, sf):
    """The best twenty words of each file that has the word, marked."""
    return files(spark, sf).where(F.array_contains(X.tokens(F.col("content")), "license")).select("file_path", P.fragment(F.col("content"), ["license", "licensed", "rights"]).alias("fragment"))


_TIERS = f"WITH {VECTORS_SQL}, new AS (SELECT * FROM vectors WHERE vec_id % 11 = 0), old AS (SELECT * FROM vectors WHERE vec_id % 11 <> 0), stale AS (SELECT vec_id FROM old WHERE file_path IN (SELECT file_path FROM new)), live AS (SELECT vec_id FROM old WHERE vec_id NOT IN (SELECT vec_id FROM stale) UNION ALL SELECT vec_id FROM new)"


@_query("versioned_tiers", f"""{_TIERS} SELECT 'added' AS name, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM live UNION ALL SELECT 'compacted', count(*), CAST(sum(vec_id) AS BIGINT) FROM live UNION ALL SELECT 'first', count(*), CAST(sum(vec_id) AS BIGINT) FROM old
UNION ALL SELECT 'major', count(*), CAST(sum(vec_id) AS BIGINT) FROM vectors UNION ALL SELECT 'minor', 0, 0 UNION ALL SELECT 'stale', count(*), CAST(coalesce(sum(vec_id), 0) AS BIGINT) FROM stale""")
def versioned_tiers(spark, sf):
    """Three versions of the two-tier store: rebuilt, with an eleventh of the vectors added, and compacted; each is still readable at the end."""
    store, v = W.Versions(spark, _folder(spark)), vectors(spark, sf)
    first = W.rebuild_tiers(store, v.where("vec_id % 11 <> 0"))
    second = W.add_to_tiers(store, v.where("vec_id % 11 = 0"))
    third = W.compact_tiers(store)
    shown = {"first": W.live_vectors(store, first), "added": W.live_vectors(store, second), "compacted": W.live_vectors(store, third)} | {t: store.read(t) for t in ("major", "minor", "stale")}
    sums = [df.agg(F.count("*").alias("n"), F.coalesce(F.sum("vec_id"), F.lit(0)).alias("ids")).withColumn("name", F.lit(name)) for name, df in shown.items()]
    return reduce(lambda a, b: a.unionByName(b), sums)


@_query("changed_rows", "SELECT event_id, round(value + 1, 6) AS value FROM events WHERE event_id % 10 = 0")
def changed_rows(spark, sf):
    """What a second run takes after a tenth of the rows got a later time and another value."""
    store, e = W.Versions(spark, _folder(spark)), table(spark, sf, "events").select("event_id", "ts", "value")
    W.take_changed(store, "events", e, "event_id", "ts", "ts")
    moved = e.withColumns({"ts": F.when(F.col("event_id") % 10 == 0, F.expr("ts + interval 400 days")).otherwise(F.col("ts")), "value": F.when(F.col("event_id") % 10 == 0, F.col("value") + 1).otherwise(F.col("value"))})
    return W.take_changed(store, "events", moved, "event_id", "ts", "ts").select("event_id", F.round("value", 6).alias("value"))


@_query("fts_english")
def fts_english(spark, sf):
    """All files that satisfy a query of English stems, stop words left out, by cover density."""
    index = P.TextIndex(spark, _folder(spark), english.tokens, english.query_words)
    index.put(_documents(files(spark, sf), F.col("content")), 0)
    return index.search('"rights reserved" or licensing -apaches', None).withColumn("rank", F.round("rank", 6))
