"""Named queries of sessions, incremental work, projects and the tool API, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import chunking as C
from ..operators import graph as G
from ..operators import incremental as I
from ..operators import projects as P
from ..operators import sessions as S
from ..operators import vector as N
from ..operators.tools import Tools, envelope
from .catalog import _BM25, _NEWEST, _Q, _QS, _alike, _fts_sql, _matches, _query, _time, TIME
from .fixtures import CHUNKS_SQL, EDGES_SQL, FILES_SQL, SESSIONS_SQL, VECTORS_SQL, edges, files, sessions, table, vectors

# --- sessions and nodes -----------------------------------------------------------

_ENDED = "SELECT id, cwd, project, strftime(started_at, '%Y-%m-%d') AS day, {ended} AS ended_at, {words} AS keywords FROM sessions"


def _sessions(spark, sf):
    return sessions(spark, sf).select("id", "cwd", "project", F.date_format("started_at", "yyyy-MM-dd").alias("day"), "conv_id")


@_query("upsert_sessions", f"WITH {SESSIONS_SQL} SELECT id, CASE WHEN conv_id % 4 = 3 THEN 'moved' ELSE cwd END AS cwd, CASE WHEN conv_id % 2 = 1 THEN conv_id ELSE 0 END AS ended_at, CASE WHEN conv_id % 2 = 1 THEN 'b' ELSE 'a' END AS keywords FROM sessions")
def upsert_sessions(spark, sf):
    s = _sessions(spark, sf)
    old = s.where("conv_id % 4 <> 3").select("id", "cwd", F.lit(0).cast("long").alias("ended_at"), F.lit("a").alias("keywords"))
    new = s.where("conv_id % 2 = 1").select("id", F.lit("moved").alias("cwd"), F.col("conv_id").alias("ended_at"), F.lit("b").alias("keywords"))
    return S.upsert_sessions(old, new)


@_query("session_nodes", f"WITH {SESSIONS_SQL} SELECT left(sha256('session|session:' || id), 16) AS id, 'session' AS type, project || ' — ' || strftime(started_at, '%Y-%m-%d') || ' (app)' AS label, 'session:' || id AS source, project || ' turns' AS keywords FROM sessions")
def session_nodes(spark, sf):
    return S.session_nodes(sessions(spark, sf).withColumn("keywords", F.array("project", F.lit("turns"))), "app")


@_query("upsert_edges", f"WITH {EDGES_SQL} SELECT source_node AS from_id, target_node AS to_id, edge_type AS relation, arg_max(weight * 2, event_id) AS score, max(event_id) AS created_at FROM edges GROUP BY 1, 2, 3")
def upsert_edges(spark, sf):
    e = edges(spark, sf).select(F.col("source_node").alias("from_id"), F.col("target_node").alias("to_id"), F.col("edge_type").alias("relation"), F.col("weight").alias("score"), F.col("event_id").alias("created_at"))
    return S.upsert_edges(e, e.withColumn("score", F.col("score") * 2))


_LABELS = f"""{FILES_SQL}, t AS (SELECT doc_id AS id, left(content, 60) AS label, lang || ' ' || source AS keywords FROM files), s AS (SELECT id, label, ' ' || array_to_string(regexp_extract_all(lower(label || ' ' || keywords), 'WORD'), ' ') || ' ' AS s FROM t),
h AS (SELECT id, label, 0 AS kw FROM s WHERE s LIKE '% src3 %' UNION ALL SELECT id, label, 1 FROM s WHERE s LIKE '% de %' UNION ALL SELECT id, label, 3 FROM s WHERE s LIKE '% en %'),
r AS (SELECT *, row_number() OVER (PARTITION BY kw ORDER BY id) AS rank FROM h), f AS (SELECT id, label, min(kw * 1000 + rank) AS f FROM r WHERE rank <= 12 GROUP BY 1, 2)"""


@_query("fts_node_keywords", f"WITH {_LABELS} SELECT id, label, CAST(f // 1000 AS INTEGER) AS keyword FROM f ORDER BY f LIMIT 12")
def fts_node_keywords(spark, sf):
    nodes = files(spark, sf).select(F.col("doc_id").alias("id"), F.left("content", F.lit(60)).alias("label"), F.concat_ws(" ", "lang", "source").alias("keywords"))
    return S.search_nodes(nodes, ["'src3'", '"de"', "^()", "en"], 12)


@_query("nodes_newest", "SELECT event_id AS id, ts AS last_seen, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events ORDER BY ts DESC, event_id LIMIT 10")
def nodes_newest(spark, sf):
    nodes = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("last_seen"), F.col("props").alias("metadata"))
    return S.newest_nodes(nodes, "k long").select("id", "last_seen", F.col("metadata.k").alias("k"))


@_query("pools_overlaid", "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN lang END, CASE WHEN doc_id % 2 = 0 THEN source END) AS value FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0")
def pools_overlaid(spark, sf):
    d = table(spark, sf, "documents")
    return S.overlaid(d.where("doc_id % 3 = 0").select("doc_id", F.col("lang").alias("value")), d.where("doc_id % 2 = 0").select("doc_id", F.col("source").alias("value")), "doc_id", "value")


@_query("signal_heat", f"WITH {EDGES_SQL} SELECT target_node, count(*) AS n, max(event_id) AS last FROM edges GROUP BY 1")
def signal_heat(spark, sf):
    return S.heat(edges(spark, sf), "target_node", "event_id")


@_query("nodes_created", f"WITH {EDGES_SQL} SELECT DISTINCT target_node AS id FROM edges WHERE target_node NOT IN (SELECT target_node FROM edges WHERE event_id % 5 = 0)")
def nodes_created(spark, sf):
    e = edges(spark, sf)
    return G.new_nodes(e.select(F.col("target_node").alias("id")), e.where("event_id % 5 = 0").select(F.col("target_node").alias("id")))


@_query("concept_hops", f"WITH {EDGES_SQL}, p AS (SELECT DISTINCT source_node, target_node FROM edges WHERE edge_type = 'accepted') SELECT a.target_node AS concept, b.target_node AS related, count(*) AS shared FROM p a JOIN p b ON a.source_node = b.source_node AND a.target_node < b.target_node GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20")
def concept_hops(spark, sf):
    return G.related(edges(spark, sf).where("edge_type = 'accepted'"), 20)


@_query("daily_kinds", "SELECT strftime(ts, '%Y-%m-%d') AS day, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, max(CASE WHEN value > 100 THEN 1 ELSE 0 END) AS has_high, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 2")
def daily_kinds(spark, sf):
    kinds = F.array_join(F.array_sort(F.collect_set("event_type")), ",")
    return table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(kinds.alias("kinds"), F.max(F.when(F.col("value") > 100, 1).otherwise(0)).alias("has_high"), F.count("*").alias("n")).where("n >= 2")


@_query("freshness", f"WITH {FILES_SQL} SELECT count(*) AS chunks, count(DISTINCT file_path) AS files, {TIME.format('max(last_modified)')} AS newest FROM files")
def freshness(spark, sf):
    return files(spark, sf).agg(F.count("*").alias("chunks"), F.count_distinct("file_path").alias("files"), _time(F.max("last_modified")).alias("newest"))


# --- incremental work ---------------------------------------------------------------


@_query("scan_since", f"WITH {FILES_SQL} SELECT file_path FROM files WHERE last_modified > TIMESTAMP '2024-01-01 02:00:00'")
def scan_since(spark, sf):
    return I.since(files(spark, sf), F.lit("2024-01-01 02:00:00").cast("timestamp_ntz")).select("file_path")


@_query("second_chance", f"WITH {FILES_SQL} SELECT file_path FROM files WHERE last_modified IS NULL OR NOT (doc_id % 2 = 0 AND doc_id % 3 <> 0 AND content <> '')")
def second_chance(spark, sf):
    f = files(spark, sf)
    return I.to_process(f, f.where("doc_id % 2 = 0"), C.chunk_code(f), f.where("doc_id % 3 <> 0")).select("file_path")


@_query("backfill_pending", f"WITH RECURSIVE {CHUNKS_SQL} SELECT file_path, chunk_index FROM chunks WHERE chunk_index % 3 <> 0")
def backfill_pending(spark, sf):
    c = C.chunk_code(files(spark, sf)).select("file_path", "chunk_index")
    return I.missing(c, c.where("chunk_index % 3 = 0"), ["file_path", "chunk_index"])


@_query("versions_to_index", "SELECT doc_id AS file_path, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE 'modified' END AS state FROM documents WHERE doc_id % 4 = 0 OR doc_id % 4 = 1")
def versions_to_index(spark, sf):
    f = table(spark, sf, "documents").select(F.col("doc_id").alias("file_path"), (F.col("doc_id") % 4).alias("version"))
    return I.versions_to_index(f, f.where("version <> 0").withColumn("version", F.when(F.col("version") == 1, 0).otherwise(F.col("version")))).select("file_path", "state")


@_query("index_next_step", "SELECT count(*) FILTER (WHERE vec_id % 10 <> 0) AS indexed, count(*) FILTER (WHERE vec_id % 10 = 0) AS pending, 'add' AS step FROM embeddings")
def index_next_step(spark, sf):
    v = vectors(spark, sf)
    return I.next_step(v.where("vec_id % 10 <> 0"), v.where("vec_id % 10 = 0"))


@_query("run_summary", "SELECT count(*) AS files, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'error') AS error, '{\"view\":' || count(*) FILTER (WHERE event_type = 'view') || ',\"error\":' || count(*) FILTER (WHERE event_type = 'error') || '}' AS stats FROM events")
def run_summary(spark, sf):
    return I.run_summary(table(spark, sf, "events").select(F.col("event_id").alias("file_path"), F.col("event_type").alias("status")), ["view", "error"])


@_query("delete_rows", f"WITH {FILES_SQL} SELECT file_path FROM files WHERE doc_id % 5 <> 2")
def delete_rows(spark, sf):
    f = files(spark, sf)
    return I.without(f, "files", f.where("doc_id % 5 = 2")).select("file_path")


@_query("vector_update", f"WITH {VECTORS_SQL} SELECT vec_id, round(CASE WHEN vec_id % 2 = 0 THEN v[1] + 1 ELSE v[1] END, 6) AS x FROM vectors")
def vector_update(spark, sf):
    v = vectors(spark, sf)
    new = v.where("vec_id % 2 = 0").withColumn("v", F.transform("v", lambda x: x + 1))
    return I.with_vectors(v, new, "vec_id").select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("x"))


_TIERS = f"{VECTORS_SQL}, fresh AS (SELECT DISTINCT file_path FROM vectors WHERE vec_id % 35 = 0), live AS (SELECT v.* FROM vectors v WHERE (vec_id % 10 <> 0 AND file_path NOT IN (SELECT file_path FROM fresh)) OR (vec_id % 10 = 0 AND file_path NOT IN (SELECT file_path FROM fresh)) OR vec_id % 35 = 0)"


@_query("tier_add_search", f"WITH {_TIERS} SELECT vec_id FROM live")
def tier_add_search(spark, sf):
    v = vectors(spark, sf)
    major, minor, new = v.where("vec_id % 10 <> 0"), v.where("vec_id % 10 = 0"), v.where("vec_id % 35 = 0")
    minor, stale = I.added(major, minor, new)
    return I.merged(major.join(stale, "vec_id", "left_anti"), minor).select("vec_id").distinct()


@_query("tier_stats", "SELECT 'major' AS name, count(*) FILTER (WHERE vec_id % 10 <> 0) AS n FROM embeddings UNION ALL SELECT 'minor', count(*) FILTER (WHERE vec_id % 10 = 0) FROM embeddings UNION ALL SELECT 'stale', count(*) FILTER (WHERE vec_id % 7 = 0) FROM embeddings UNION ALL SELECT 'needs_compaction', 1")
def tier_stats(spark, sf):
    v = vectors(spark, sf)
    return I.tier_stats(v.where("vec_id % 10 <> 0"), v.where("vec_id % 10 = 0"), v.where("vec_id % 7 = 0"))


# --- vectors ------------------------------------------------------------------------


@_query("vector_coverage", "SELECT count(*) AS total, count(*) FILTER (WHERE vec_id % 3 <> 0) AS with_vector FROM embeddings")
def vector_coverage(spark, sf):
    return N.coverage(vectors(spark, sf).withColumn("v", F.when(F.col("vec_id") % 3 != 0, F.col("v"))), "v")


@_query("vector_indexed", f"WITH {VECTORS_SQL} SELECT DISTINCT file_path, file_path IN (SELECT file_path FROM vectors WHERE vec_id % 11 = 0) AS indexed FROM vectors")
def vector_indexed(spark, sf):
    v = vectors(spark, sf)
    return N.is_indexed(v.select("file_path").distinct(), v.where("vec_id % 11 = 0"))


@_query("vector_format", f"WITH {VECTORS_SQL} SELECT vec_id, '[' || array_to_string(list_transform(v, lambda x: printf('%.8f', x)), ',') || ']' AS text FROM vectors")
def vector_format(spark, sf):
    v = vectors(spark, sf).select("vec_id", V.formatted(F.col("v")).alias("text"))
    return v.select("vec_id", V.formatted(V.parse(F.col("text"))).alias("text"))


@_query("vector_checked", f"WITH {VECTORS_SQL} SELECT vec_id, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS x FROM vectors")
def vector_checked(spark, sf):
    return N.checked(vectors(spark, sf), 64).select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("x"))


@_query("vector_sql_functions", f"WITH {VECTORS_SQL} SELECT vec_id, round(list_inner_product(v, {_QS}), 6) AS i, round(list_cosine_similarity(v, {_QS}), 6) AS c, round(1 / (1 + list_distance(v, {_QS}) * list_distance(v, {_QS})), 6) AS s FROM vectors")
def vector_sql_functions(spark, sf):
    N.register(spark)
    q = "array(" + ", ".join(f"{x}D" for x in _Q) + ")"
    return vectors(spark, sf).selectExpr("vec_id", *[f"round(vector_{f}(v, {q}), 6) AS {a}" for f, a in (("inner", "i"), ("cosine", "c"), ("l2_similarity", "s"))])


_KNN = f"""{VECTORS_SQL}, e AS (SELECT label, unnest(v) AS x, unnest(range(64)) AS i FROM vectors), m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY label),
p AS (SELECT c.label AS from_group, v.label AS to_group, v.vec_id, list_cosine_similarity(v.v, c.c) AS s FROM vectors v JOIN c ON v.label <> c.label), r AS (SELECT *, row_number() OVER (PARTITION BY from_group ORDER BY s DESC, vec_id) AS rn FROM p WHERE s > 0.1),
k AS (SELECT from_group, to_group, count(*) AS hits, round(avg(s), 6) AS similarity FROM r WHERE rn <= 40 GROUP BY ALL)"""


@_query("group_edges", f"WITH {_KNN} SELECT least(from_group, to_group) AS a, greatest(from_group, to_group) AS b, max(similarity) AS similarity, CAST(sum(hits) AS BIGINT) AS hits FROM k GROUP BY 1, 2")
def group_edges(spark, sf):
    return N.linked_groups(N.centroid_neighbours(vectors(spark, sf), "label", threshold=0.1).withColumnRenamed("label", "to_group"))


# --- projects -----------------------------------------------------------------------

_ROOTS = ["/corpus", "/corpus/en"]
_PROJECT = "CASE WHEN starts_with(file_path, '/corpus/en/') THEN nullif(split_part(substring(file_path, 12), '/', 1), '') WHEN starts_with(file_path, '/corpus/') THEN nullif(split_part(substring(file_path, 9), '/', 1), '') END"


@_query("project_of_path", f"WITH {FILES_SQL} SELECT file_path, {_PROJECT} AS project FROM files")
def project_of_path(spark, sf):
    return files(spark, sf).select("file_path", P.project_of(F.col("file_path"), _ROOTS).alias("project"))


@_query("project_discovery", f"WITH {FILES_SQL}, p AS (SELECT file_path, {_PROJECT} AS project FROM files WHERE file_path LIKE '%.md') SELECT project, count(*) AS n_files, min(file_path) AS seed FROM p WHERE project IS NOT NULL GROUP BY 1 HAVING count(*) >= 2")
def project_discovery(spark, sf):
    return P.discover(files(spark, sf), _ROOTS, least=2)


@_query("active_names", "SELECT doc_id, 'n' || doc_id || ',other' AS names FROM documents")
def active_names(spark, sf):
    text = F.concat(F.lit("# Top\n## 1. n"), F.col("doc_id"), F.lit(" rest\nprose ## 2. no\n##  12.  other\n## x. no"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(P.active_names(text), ",").alias("names"))


@_query("latest_transcript", f"WITH {SESSIONS_SQL} SELECT arg_max(id, started_at) AS path FROM sessions WHERE conv_id <> (SELECT max(conv_id) FROM conversations)")
def latest_transcript(spark, sf):
    s = sessions(spark, sf).select(F.col("id").alias("path"), F.col("started_at").alias("modified"), "conv_id")
    current = s.orderBy(F.desc("conv_id")).first()["path"]
    return P.latest_other(s, current)


@_query("concepts_unsignalled", "WITH c AS (SELECT unnest(['license', 'zebra', 'und', 'xylophone']) AS concept) SELECT concept FROM c WHERE NOT EXISTS (SELECT 1 FROM conversations WHERE contains(lower(text), concept))")
def concepts_unsignalled(spark, sf):
    concepts = spark.createDataFrame([("license",), ("zebra",), ("und",), ("xylophone",)], "concept string")
    return P.without_signal(concepts, table(spark, sf, "conversations"))


# --- scalar functions -----------------------------------------------------------------


@_query("mime_guess", f"WITH {FILES_SQL} SELECT file_path, CASE file_type WHEN '.py' THEN 'text/x-python' WHEN '.md' THEN 'text/markdown' WHEN '.txt' THEN 'text/plain' END AS mime FROM files")
def mime_guess(spark, sf):
    return files(spark, sf).select("file_path", X.mime_type(F.col("file_type")).alias("mime"))


@_query("term_pairs", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a:1.0,b:1.0' WHEN doc_id % 3 = 1 THEN 'a:0.5,c:1.0' ELSE '' END AS terms FROM documents")
def term_pairs(spark, sf):
    d = F.col("doc_id") % 3
    given = F.when(d == 0, '["a", "b"]').when(d == 1, '[["a", 0.5], "c"]').otherwise("[broken")
    shown = lambda t: F.concat(t["term"], F.lit(":"), t["score"].cast("string"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(X.term_scores(given), shown), ",").alias("terms"))


@_query("term_pair_search", "SELECT doc_id FROM documents WHERE doc_id % 3 = 1")
def term_pair_search(spark, sf):
    given = F.when(F.col("doc_id") % 3 == 1, '[["a", 0.5], "c"]').otherwise('[["b", 1]]')
    return table(spark, sf, "documents").where(F.exists(X.term_scores(given), lambda t: t["term"] == "c")).select("doc_id")


@_query("prompt_cleaned", "SELECT conv_id, turn, nullif(trim(split_part(text, chr(10), 1)), '') AS cleaned, 'a,b c' AS words FROM conversations WHERE NOT contains(text, chr(13))")
def prompt_cleaned(spark, sf):
    c = table(spark, sf, "conversations").where(~F.contains("text", F.lit("\r")))
    cleaned, words = X.cleaned_prompt(F.concat(F.lit("CLEANED: "), F.split_part("text", F.lit("\n"), F.lit(1)), F.lit("\nKEYWORDS: A, b c,, ")))
    return c.select("conv_id", "turn", cleaned.alias("cleaned"), F.array_join(words, ",").alias("words"))


@_query("shown_lists", f"WITH {FILES_SQL} SELECT file_path, array_to_string(regexp_extract_all(lower(content), 'WORD')[1:5], ', ') AS words FROM files")
def shown_lists(spark, sf):
    return files(spark, sf).select("file_path", X.shown_list(X.tokens(F.col("content")), 5).alias("words"))


@_query("usage_bands", "SELECT doc_id, CASE WHEN s >= 0.9 THEN 'critical' WHEN s >= 0.75 THEN 'high' WHEN s >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM (SELECT doc_id, (doc_id % 100) / 100::DOUBLE AS s FROM documents)")
def usage_bands(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.usage_band(F.col("doc_id") % 100 / 100).alias("band"))


@_query("bankers_rounding", "SELECT event_id, round_even(event_id / 8::DOUBLE, 2) AS x FROM events")
def bankers_rounding(spark, sf):
    return table(spark, sf, "events").select("event_id", F.bround(F.col("event_id") / 8, 2).alias("x"))


# --- tools ----------------------------------------------------------------------------


def _tools(spark, sf):
    f = files(spark, sf)
    analysis = f.select("file_path", X.keywords(F.col("content"), 40).alias("keywords"))
    return Tools(f, C.chunk_code(f), analysis, vectors(spark, sf), edges(spark, sf))


@_query("tool_search_files", f"WITH {FILES_SQL} SELECT file_path, file_size FROM files WHERE file_size >= 300 {_NEWEST} 20")
def tool_search_files(spark, sf):
    return _tools(spark, sf).search_files(min_size=300, max_size=0, name="").select("file_path", "file_size")


@_query("tool_full_text", _fts_sql("s LIKE '% version %'", "LIMIT 5"))
def tool_full_text(spark, sf):
    return _tools(spark, sf).full_text_search("version", 5).withColumn("last_modified", _time("last_modified")).withColumnRenamed("last_modified", "modified")


@_query("tool_file_chunks", f"WITH RECURSIVE {CHUNKS_SQL} SELECT * FROM chunks WHERE file_path = (SELECT file_path FROM files ORDER BY doc_id LIMIT 1)")
def tool_file_chunks(spark, sf):
    tools = _tools(spark, sf)
    return tools.get_file_chunks(tools.files.orderBy("doc_id").first()["file_path"])


@_query("tool_directories", f"WITH {FILES_SQL} SELECT regexp_replace(file_path, '/[^/]+$', '') AS directory, count(*) AS file_count, CAST(sum(file_size) AS BIGINT) AS total_size FROM files WHERE starts_with(file_path, '/corpus/de') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def tool_directories(spark, sf):
    return _tools(spark, sf).list_directories("/corpus/de")


@_query("tool_semantic", f"WITH {VECTORS_SQL}, h AS (SELECT file_path, chunk_index, list_cosine_similarity(v, {_QS}) AS s, vec_id FROM vectors WHERE starts_with(file_path, '/vec/') ORDER BY 3 DESC, 4 LIMIT 10) SELECT h.file_path, chunk_index, round(s, 6) AS similarity, 'chunk ' || chunk_index AS preview, length(h.file_path) AS file_size FROM h")
def tool_semantic(spark, sf):
    v = vectors(spark, sf)
    contents = v.select("file_path", "chunk_index", F.format_string("chunk %d", "chunk_index").alias("content"))
    known = v.select("file_path").distinct().select("file_path", F.length("file_path").alias("file_size"), F.lit(None).cast("timestamp_ntz").alias("last_modified"))
    tools = Tools(known, contents, known, v, edges(spark, sf))
    return tools.semantic_search(_Q, 10, "/vec").drop("last_modified")


@_query("tool_log_feedback", f"WITH {EDGES_SQL} SELECT count(*) AS n, round(sum(weight), 4) AS weight FROM (SELECT weight FROM edges UNION ALL SELECT CASE WHEN turn % 3 = 0 THEN 1.0 WHEN turn % 3 = 1 THEN -0.5 ELSE 0.0 END FROM (SELECT DISTINCT conv_id, turn FROM conversations))")
def tool_log_feedback(spark, sf):
    offered = table(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("context")).agg(F.collect_set(F.col("turn").cast("string")).alias("offered"))
    picked = lambda r: F.filter("offered", lambda x: x.cast("int") % 3 == r)
    out = _tools(spark, sf).log_autograph(offered.withColumns({"accepted": picked(0), "rejected": picked(1)}))
    return out.agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


@_query("tool_suggest", f"""WITH {EDGES_SQL}, alike AS (SELECT DISTINCT source_node, (ascii(right(source_node, 1)) % 10) / CAST(10 AS DOUBLE) AS similarity FROM edges), s AS (SELECT target_node, sum(CASE WHEN edge_type = 'accepted' THEN similarity ELSE 0 END) AS yes, sum(CASE WHEN edge_type = 'rejected' THEN similarity ELSE 0 END) AS no FROM edges JOIN alike USING (source_node) WHERE similarity >= 0.3 AND edge_type IN ('accepted', 'rejected') GROUP BY 1)
SELECT target_node FROM s WHERE yes + no > 0 AND yes / (yes + no) >= 0.3""")
def tool_suggest(spark, sf):
    return _tools(spark, sf).autograph_suggest(_alike(spark, sf), 0.3, 1_000_000).select("target_node")


@_query("response_envelope", f"WITH {FILES_SQL} SELECT 'success' AS status, count(*) AS total, count(DISTINCT file_path) AS files FROM (SELECT file_path FROM files WHERE file_size > 100 {_NEWEST} 20)")
def response_envelope(spark, sf):
    found = _tools(spark, sf).search_files(min_size=101).select("file_path", "file_size")
    text = envelope(found, "metadata", ["get_file_chunks"]).select("response")
    part = lambda path: F.get_json_object("response", path)
    return text.select(part("$.status").alias("status"), part("$.query_metadata.total").cast("long").alias("total"), part("$.summary.unique_files").cast("long").alias("files"))


@_query("ground_context")
def ground_context(spark, sf):
    from ..operators import grounding as R

    ranked = R.ranked(_matches(spark, sf)).withColumn("pools", F.lit("AB"))
    return S.context_lines(ranked)
