"""The named queries over the test tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import vectors as V
from ..functions.stems import stem_words, stems
from ..operators import chunking as C
from ..operators import fulltext as T
from ..operators import graph as G
from ..operators import grounding as R
from ..operators import keywords as K
from ..operators import maintenance as M
from ..operators import metadata as D
from ..operators import vector as N
from .fixtures import CHUNKS_SQL, EDGES_SQL, FILES_SQL, SESSIONS_SQL, VECTORS_SQL, edges, files, sessions, table, vectors

#: The pattern of a word in the oracles.
WORD = r"'[\p{L}\p{N}]+'"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.replace("'WORD'", WORD)
        return f

    return add


def _time(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_SHOWN = ("file_path", "file_size", "file_type")


def _shown(df):
    return df.select(*_SHOWN, _time("last_modified").alias("modified"))


_SHOWN_SQL = f"SELECT file_path, file_size, file_type, {TIME.format('last_modified')} AS modified FROM files "
_NEWEST = " ORDER BY last_modified DESC NULLS LAST, file_path LIMIT "

# --- metadata ---------------------------------------------------------------


@_query("files_by_metadata", f"WITH {FILES_SQL} {_SHOWN_SQL} WHERE file_path ILIKE '%SRC1%' AND (file_type ILIKE '%py%' OR mime_type ILIKE '%py%') AND file_size >= 200 AND file_size <= 9000 AND last_modified >= TIMESTAMP '2024-01-01 00:30:00' {_NEWEST} 20")
def files_by_metadata(spark, sf):
    return _shown(D.search(files(spark, sf), name="SRC1", file_type="py", min_size=200, max_size=9000, modified_after="2024-01-01 00:30:00"))


@_query("files_by_metadata_v2", f"WITH {FILES_SQL} {_SHOWN_SQL} WHERE file_size > 500 AND file_size < 5000 AND last_modified <= TIMESTAMP '2024-01-01 03:00:00'")
def files_by_metadata_v2(spark, sf):
    return _shown(D.search(files(spark, sf), min_size=500, max_size=5000, modified_before="2024-01-01 03:00:00", strict_sizes=True, limit=None))


@_query("files_undated_last", f"WITH {FILES_SQL} {_SHOWN_SQL} WHERE file_path LIKE '/corpus/de%' {_NEWEST} 40")
def files_undated_last(spark, sf):
    return _shown(D.search(files(spark, sf), directory="/corpus/de", limit=40))


@_query("files_prefix", f"WITH {FILES_SQL} {_SHOWN_SQL} WHERE starts_with(file_path, '/corpus/en/src1')")
def files_prefix(spark, sf):
    return _shown(files(spark, sf).where(F.col("file_path").startswith("/corpus/en/src1")))


@_query("files_scope", f"WITH {FILES_SQL} {_SHOWN_SQL} WHERE starts_with(file_path, '/corpus/en/src1/')")
def files_scope(spark, sf):
    return _shown(files(spark, sf).where(D.in_scope(F.col("file_path"), "/corpus/en/src1/")))


@_query("files_not_prefix", f"WITH {FILES_SQL} {_SHOWN_SQL} WHERE NOT starts_with(file_path, '/corpus/en')")
def files_not_prefix(spark, sf):
    return _shown(files(spark, sf).where(~F.col("file_path").startswith("/corpus/en")))


@_query("files_in_set", f"WITH {FILES_SQL} {_SHOWN_SQL} WHERE lang IN ('de', 'fr') AND file_hash NOT IN ('too_large', 'error') AND doc_id BETWEEN 50 AND 150 AND doc_id <> 75")
def files_in_set(spark, sf):
    return _shown(files(spark, sf).where(F.col("lang").isin("de", "fr") & ~F.col("file_hash").isin("too_large", "error") & F.col("doc_id").between(50, 150) & (F.col("doc_id") != 75)))


@_query("prefix_of_literal", f"WITH {FILES_SQL}, dirs AS (SELECT DISTINCT regexp_replace(file_path, '/[^/]+$', '') AS directory FROM files) SELECT directory FROM dirs WHERE starts_with('/corpus/en/src11/x.py', directory)")
def prefix_of_literal(spark, sf):
    dirs = files(spark, sf).select(X.dirname(F.col("file_path")).alias("directory")).distinct()
    return dirs.where(F.lit("/corpus/en/src11/x.py").startswith(F.col("directory")))


@_query("file_info", f"WITH RECURSIVE {CHUNKS_SQL} SELECT f.file_path, f.file_size, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic, (SELECT count(*) FROM chunks c WHERE c.file_path = f.file_path) AS chunk_count FROM files f LEFT JOIN labels l ON l.doc_id = f.doc_id")
def file_info(spark, sf):
    f = files(spark, sf)
    analysis = f.select("file_path", "doc_id").join(table(spark, sf, "labels"), "doc_id").drop("doc_id")
    return D.file_info(f, analysis, C.chunk_code(f)).fillna(-1, ["quality", "toxic"]).select("file_path", "file_size", "quality", "toxic", "chunk_count")


@_query("directory_rollup", f"WITH {FILES_SQL} SELECT regexp_replace(file_path, '/[^/]+$', '') AS directory, count(*) AS file_count, CAST(sum(file_size) AS BIGINT) AS total_size FROM files WHERE starts_with(file_path, '/corpus/') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def directory_rollup(spark, sf):
    return D.directory_rollup(files(spark, sf), "/corpus/", 50)


@_query("directory_ancestors", f"WITH {FILES_SQL}, up AS (SELECT file_size, '/corpus' AS directory FROM files UNION ALL SELECT file_size, '/corpus/' || lang FROM files UNION ALL SELECT file_size, '/corpus/' || lang || '/' || source FROM files) SELECT directory, count(*) AS file_count, CAST(sum(file_size) AS BIGINT) AS total_size FROM up GROUP BY 1")
def directory_ancestors(spark, sf):
    return D.directory_totals(files(spark, sf))


@_query("corpus_stats", f"WITH {FILES_SQL} SELECT count(*) AS n_files, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_size, count(DISTINCT regexp_replace(file_path, '/[^/]+$', '')) AS n_directories FROM files")
def corpus_stats(spark, sf):
    return D.corpus_stats(files(spark, sf))


@_query("type_top10", f"WITH {FILES_SQL} SELECT coalesce(file_type, '') AS file_type, count(*) AS count FROM files GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def type_top10(spark, sf):
    return D.top_types(files(spark, sf))


@_query("filtered_counts", f"WITH {FILES_SQL} SELECT count(*) AS n, count(*) FILTER (WHERE last_modified IS NULL) AS undated, count(*) FILTER (WHERE file_size > 800) AS large FROM files")
def filtered_counts(spark, sf):
    return files(spark, sf).agg(F.count("*").alias("n"), F.count_if(F.col("last_modified").isNull()).alias("undated"), F.count_if(F.col("file_size") > 800).alias("large"))


_TABLES = ("documents", "labels", "events", "conversations", "embeddings")


@_query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def table_counts(spark, sf):
    parts = [table(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in _TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@_query("dir_compound", f"WITH {FILES_SQL} SELECT regexp_replace(file_path, '/[^/]+$', '') AS directory FROM files GROUP BY 1 HAVING bool_or(file_path LIKE '%/doc_%1%') AND bool_or(file_path LIKE '%/doc_%2%')")
def dir_compound(spark, sf):
    return D.compound_directories(files(spark, sf), {"one": "doc_%1%", "two": "doc_%2%"})


@_query("status_counts", "SELECT count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error FROM events")
def status_counts(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy().pivot("event_type", ["view", "click", "error"]).count()


# --- chunks -----------------------------------------------------------------


@_query("chunk_code", f"WITH RECURSIVE {CHUNKS_SQL} SELECT * FROM chunks")
def chunk_code(spark, sf):
    return C.chunk_code(files(spark, sf))


@_query("chunk_prose_overlap", f"""WITH RECURSIVE {FILES_SQL},
w AS (SELECT file_path, 0 AS k, 0 AS a, length(content) AS n FROM files WHERE content <> '' UNION ALL SELECT file_path, k + 1, e - 120, n FROM
  (SELECT w.file_path, k, n, CASE WHEN a + 800 < n AND strpos(substring(f.content, a + 701, 200), chr(10) || chr(10)) > 0 THEN a + 699 + strpos(substring(f.content, a + 701, 200), chr(10) || chr(10)) ELSE a + 800 END AS e FROM w JOIN files f USING (file_path)) WHERE e - 120 < n),
e AS (SELECT w.*, f.content, CASE WHEN a + 800 < n AND strpos(substring(f.content, a + 701, 200), chr(10) || chr(10)) > 0 THEN a + 699 + strpos(substring(f.content, a + 701, 200), chr(10) || chr(10)) ELSE a + 800 END AS e FROM w JOIN files f USING (file_path)),
p AS (SELECT file_path, k, regexp_replace(substring(content, a + 1, e - a), '^\\s+|\\s+$', '', 'g') AS piece FROM e)
SELECT file_path, CAST(row_number() OVER (PARTITION BY file_path ORDER BY k) - 1 AS INTEGER) AS chunk_index, piece AS content FROM p WHERE piece <> ''""")
def chunk_prose_overlap(spark, sf):
    return C.exploded(files(spark, sf), C.overlapping_pieces(F.col("content")))


_PARAGRAPHS = FILES_SQL + """,
ps AS (SELECT file_path, unnest(range(len(p))) AS pi, unnest(p) AS p FROM (SELECT file_path, list_filter(list_transform(regexp_split_to_array(content, '\\n\\s*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS p FROM files)),
ss AS (SELECT file_path, pi, p, CASE WHEN length(p) > 800 THEN flatten(list_transform(range(len(regexp_split_to_array(p, '[.!?]+\\s+'))), lambda i: [regexp_split_to_array(p, '[.!?]+\\s+')[i + 1], regexp_extract_all(p, '[.!?]+\\s+')[i + 1]])) ELSE [p] END AS s FROM ps),
parts AS (SELECT file_path, row_number() OVER (PARTITION BY file_path ORDER BY pi, si) - 1 AS i, x, CASE WHEN NOT long THEN 0 WHEN si = 0 THEN 1 ELSE 2 END AS kind FROM (SELECT file_path, pi, length(p) > 800 AS long, unnest(range(len(s))) AS si, unnest(s) AS x FROM ss) WHERE x IS NOT NULL),
packed AS (
  SELECT file_path, i, x, kind, 0 AS chunk_index, length(x) + CASE kind WHEN 0 THEN 2 ELSE 0 END AS size FROM parts WHERE i = 0
  UNION ALL
  SELECT l.file_path, l.i, l.x, l.kind,
    p.chunk_index + CASE WHEN l.kind = 1 OR (l.kind = 0 AND (p.kind > 0 OR p.size + length(l.x) > 800)) OR (l.kind = 2 AND p.size + length(l.x) > 800) THEN 1 ELSE 0 END,
    CASE WHEN l.kind = 1 THEN length(l.x) WHEN l.kind = 0 AND p.kind > 0 THEN length(l.x) + 2 WHEN l.kind = 0 AND p.size + length(l.x) > 800 THEN length(l.x) WHEN l.kind = 0 THEN p.size + length(l.x) + 2
         WHEN p.size + length(l.x) > 800 THEN length(l.x) ELSE p.size + length(l.x) END
  FROM packed p JOIN parts l ON l.file_path = p.file_path AND l.i = p.i + 1)"""


@_query("chunk_prose_discrete", f"WITH RECURSIVE {_PARAGRAPHS} SELECT file_path, CAST(chunk_index AS INTEGER) AS chunk_index, CASE WHEN max(kind) = 0 THEN string_agg(x, chr(10) || chr(10) ORDER BY i) ELSE regexp_replace(string_agg(x, '' ORDER BY i), '^\\s+|\\s+$', '', 'g') END AS content FROM packed GROUP BY file_path, chunk_index")
def chunk_prose_discrete(spark, sf):
    return C.exploded(files(spark, sf), C.paragraph_pieces(F.col("content")))


_LIVE = """live AS (SELECT file_path, CASE WHEN file_type = '.py' THEN chr(10) ELSE chr(10) || chr(10) END AS mark, CASE WHEN file_type = '.py' THEN 350 ELSE 800 END AS most, content FROM files WHERE content <> '' AND {which}),
parts AS (SELECT file_path, most, unnest(range(len(string_split(content, mark)))) AS i, unnest(string_split(content, mark)) || mark AS x FROM live),
packed AS (SELECT file_path, i, x, 0 AS chunk_index, length(x) AS size FROM parts WHERE i = 0 UNION ALL
  SELECT l.file_path, l.i, l.x, p.chunk_index + CASE WHEN p.size + length(l.x) > most THEN 1 ELSE 0 END, CASE WHEN p.size + length(l.x) > most THEN 0 ELSE p.size END + length(l.x) FROM packed p JOIN parts l ON l.file_path = p.file_path AND l.i = p.i + 1)
SELECT file_path, CAST(chunk_index AS INTEGER) AS chunk_index, string_agg(x, '' ORDER BY i) AS content FROM packed GROUP BY file_path, chunk_index"""


def _live(spark, sf, code):
    f = files(spark, sf).where((F.col("file_type") == ".py") == F.lit(code))
    return C.exploded(f, C.live_pieces(F.col("content"), F.col("file_type")))


@_query("chunk_live_code", f"WITH RECURSIVE {FILES_SQL}, {_LIVE.format(which="file_type = '.py'")}")
def chunk_live_code(spark, sf):
    return _live(spark, sf, True)


@_query("chunk_live_prose", f"WITH RECURSIVE {FILES_SQL}, {_LIVE.format(which="file_type <> '.py'")}")
def chunk_live_prose(spark, sf):
    return _live(spark, sf, False)


@_query("chunk_positions", f"WITH RECURSIVE {CHUNKS_SQL} SELECT file_path, chunk_index, CAST(sum(length(content) + 1) OVER (PARTITION BY file_path ORDER BY chunk_index) - length(content) - 1 AS BIGINT) AS start, length(content) AS size FROM chunks")
def chunk_positions(spark, sf):
    before = Window.partitionBy("file_path").orderBy("chunk_index")
    size = F.length("content")
    return C.chunk_code(files(spark, sf)).select("file_path", "chunk_index", (F.sum(size + 1).over(before) - size - 1).alias("start"), size.alias("size"))


@_query("chunk_envelope_json", f"WITH RECURSIVE {CHUNKS_SQL}, t AS (SELECT *, count(*) OVER (PARTITION BY file_path) AS n FROM chunks) SELECT file_path, chunk_index, n AS total_chunks, left(content, 50) AS starts_with FROM t")
def chunk_envelope_json(spark, sf):
    rows = C.as_json(C.envelope(C.chunk_code(files(spark, sf))))
    return C.from_json(rows, "file_path string, chunk_index int, total_chunks long, starts_with string")


@_query("chunk_strategy", f"WITH {FILES_SQL} SELECT file_path, CASE WHEN file_type IN ('.py', '.sql') THEN 'code_discrete' ELSE 'prose_discrete' END AS strategy FROM files")
def chunk_strategy(spark, sf):
    return files(spark, sf).select("file_path", C.strategy(X.suffix(F.col("file_path"))).alias("strategy"))


@_query("chunk_envelope", f"""WITH RECURSIVE {CHUNKS_SQL}, t AS (SELECT *, count(*) OVER (PARTITION BY file_path) AS n FROM chunks)
SELECT file_path, chunk_index, n AS total_chunks, length(content) AS chunk_size, CASE WHEN chunk_index = 0 THEN 'start' WHEN chunk_index = n - 1 THEN 'end' ELSE 'middle' END AS position, chunk_index > 0 AS has_previous, chunk_index < n - 1 AS has_next,
array_to_string(range(greatest(chunk_index - 2, 0), least(chunk_index + 2, n - 1) + 1), ',') AS adjacent, left(content, 50) AS starts_with, right(content, 50) AS ends_with, CASE WHEN n > 3 THEN 'adjacent_1' ELSE 'full_file' END AS suggestion FROM t""")
def chunk_envelope(spark, sf):
    return C.envelope(C.chunk_code(files(spark, sf)))


@_query("chunk_stats", f"WITH RECURSIVE {CHUNKS_SQL} SELECT file_path, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS total_size, round(avg(length(content)), 2) AS avg_size, min(length(content)) AS min_size, max(length(content)) AS max_size FROM chunks GROUP BY file_path")
def chunk_stats(spark, sf):
    return C.stats(C.chunk_code(files(spark, sf)))


_ADJACENT = f"WITH RECURSIVE {CHUNKS_SQL}, hits AS (SELECT file_path, chunk_index FROM chunks WHERE ' ' || array_to_string(regexp_extract_all(lower(content), 'WORD'), ' ') || ' ' LIKE '% the %') SELECT h.file_path, h.chunk_index AS hit_index, c.chunk_index, c.content FROM hits h JOIN chunks c ON c.file_path = h.file_path AND c.chunk_index BETWEEN h.chunk_index - 1 AND h.chunk_index + 1"


@_query("adjacent_chunks", _ADJACENT)
def adjacent_chunks(spark, sf):
    c = C.chunk_code(files(spark, sf))
    return C.adjacent(c.where(T.Query.parse("the").matches(X.tokens(F.col("content")))), c)


@_query("adjacent_excl_self", _ADJACENT + " WHERE c.chunk_index <> h.chunk_index")
def adjacent_excl_self(spark, sf):
    c = C.chunk_code(files(spark, sf))
    return C.adjacent(c.where(T.Query.parse("the").matches(X.tokens(F.col("content")))), c, with_self=False)


# --- full text ----------------------------------------------------------------

_SPACED = "' ' || array_to_string(regexp_extract_all(lower(content), 'WORD'), ' ') || ' '"


def _fts_sql(predicate: str, limit: str = "LIMIT 20") -> str:
    return f"""WITH RECURSIVE {CHUNKS_SQL}, t AS (SELECT *, {_SPACED} AS s FROM chunks), hits AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY chunk_index) AS rn FROM t WHERE {predicate})
SELECT h.file_path, f.file_size, {TIME.format("f.last_modified")} AS modified, h.chunk_index, left(h.content, 200) AS preview FROM hits h JOIN files f ON f.file_path = h.file_path WHERE rn = 1 ORDER BY f.last_modified DESC NULLS LAST, h.file_path {limit}"""


def _fts(spark, sf, query, limit=20):
    f = files(spark, sf)
    return T.search_files(C.chunk_code(f), f, query, limit).withColumn("last_modified", _time("last_modified")).withColumnRenamed("last_modified", "modified")


@_query("fts_files_first_chunk", _fts_sql("s LIKE '% license %'"))
def fts_files_first_chunk(spark, sf):
    return _fts(spark, sf, "license")


@_query("fts_phrase", _fts_sql("s LIKE '% all rights reserved %'"))
def fts_phrase(spark, sf):
    return _fts(spark, sf, '"all rights reserved"')


@_query("fts_exclude", _fts_sql("s LIKE '% license %' AND s NOT LIKE '% apache %'"))
def fts_exclude(spark, sf):
    return _fts(spark, sf, "license -apache")


@_query("fts_or", _fts_sql("(s LIKE '% apache %' AND s LIKE '% version %') OR s LIKE '% rights reserved %'"))
def fts_or(spark, sf):
    return _fts(spark, sf, 'apache version OR "rights reserved"')


_BM25 = """t AS (SELECT {key}, regexp_extract_all(lower(content), 'WORD') AS w FROM {source}), d AS (SELECT *, len(w) AS length FROM t WHERE len(w) > 0), tot AS (SELECT count(*) AS n, avg(length) AS mean FROM d),
p AS (SELECT {key}, length, term, count(*) AS tf FROM (SELECT {key}, length, unnest(w) AS term FROM d) WHERE term IN ({words}) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
scored AS (SELECT {key}, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM p JOIN df USING (term), tot GROUP BY {key})"""


@_query("fts_bm25", f"WITH {FILES_SQL}, {_BM25.format(key='file_path', source='files', words=repr('license') + ', ' + repr('version') + ', ' + repr('the'))} SELECT * FROM scored")
def fts_bm25(spark, sf):
    return T.bm25(files(spark, sf), ["file_path"], ["license", "version", "the"], None)


@_query("fts_postings", f"WITH {FILES_SQL}, t AS (SELECT file_path, regexp_extract_all(lower(content), 'WORD') AS w FROM files) SELECT file_path, length, term, count(*) AS tf FROM (SELECT file_path, CAST(len(w) AS INTEGER) AS length, unnest(w) AS term FROM t) GROUP BY ALL")
def fts_postings(spark, sf):
    return T.postings(files(spark, sf), ["file_path"])


@_query("fts_stemmed")
def fts_stemmed(spark, sf):
    f = files(spark, sf)
    hits = f.select("file_path", stems(F.col("content")).alias("t")).where(T.Query.parse("licensing versions", stem_words).matches(F.col("t"))).select("file_path")
    return hits.join(T.bm25(f, ["file_path"], ["licensing", "versions"], None, stems, stem_words), "file_path")


@_query("fts_headline")
def fts_headline(spark, sf):
    f = files(spark, sf).where(T.Query.parse("license").matches(X.tokens(F.col("content"))))
    return f.select("file_path", T.headline(F.col("content"), ["license", "licensed"]).alias("headline"))


# --- vectors ------------------------------------------------------------------

_Q = [((i * 37) % 11 - 5) / 10 for i in range(64)]
_QS = "CAST([" + ", ".join(map(str, _Q)) + "] AS DOUBLE[])"


@_query("vector_cosine_topk", f"WITH {VECTORS_SQL} SELECT vec_id, round(list_cosine_similarity(v, {_QS}), 6) AS similarity FROM vectors ORDER BY list_cosine_similarity(v, {_QS}) DESC, 1 LIMIT 10")
def vector_cosine_topk(spark, sf):
    return N.top_k(vectors(spark, sf), _Q).select("vec_id", "similarity")


@_query("vector_l2_topk", f"WITH {VECTORS_SQL} SELECT vec_id, round(1 / (1 + list_distance(v, {_QS}) * list_distance(v, {_QS})), 6) AS similarity FROM vectors ORDER BY list_distance(v, {_QS}), 1 LIMIT 10")
def vector_l2_topk(spark, sf):
    return N.top_k(vectors(spark, sf), _Q, measure="l2").select("vec_id", "similarity")


@_query("vector_ip_topk", f"WITH {VECTORS_SQL} SELECT vec_id, round(list_inner_product(v, {_QS}), 6) AS similarity FROM vectors ORDER BY list_inner_product(v, {_QS}) DESC, 1 LIMIT 10")
def vector_ip_topk(spark, sf):
    return N.top_k(vectors(spark, sf), _Q, measure="ip").select("vec_id", "similarity")


@_query("vector_nan_guard", f"WITH {VECTORS_SQL} SELECT vec_id, round(list_cosine_similarity(v, {_QS}), 6) AS similarity FROM vectors WHERE vec_id % 3 <> 0 ORDER BY list_cosine_similarity(v, {_QS}) DESC, 1 LIMIT 10")
def vector_nan_guard(spark, sf):
    broken = vectors(spark, sf).withColumn("v", F.when(F.col("vec_id") % 3 != 0, F.col("v")).otherwise(F.transform("v", lambda x: F.lit(float("nan")))))
    return N.top_k(broken, _Q).select("vec_id", "similarity")


@_query("two_tier_search", f"WITH {VECTORS_SQL}, live AS (SELECT * FROM vectors WHERE vec_id % 10 = 0 OR vec_id % 7 <> 0), s AS (SELECT *, round(list_inner_product(v, {_QS}), 6) AS similarity FROM live) SELECT vec_id, similarity FROM s ORDER BY 2 DESC, 1 LIMIT 10")
def two_tier_search(spark, sf):
    v = vectors(spark, sf)
    major, minor = v.where("vec_id % 10 <> 0"), v.where("vec_id % 10 = 0")
    return N.two_tiers(major, minor, major.where("vec_id % 7 = 0").select("vec_id"), _Q).select("vec_id", "similarity")


@_query("needs_compaction", "SELECT count(*) FILTER (WHERE vec_id % 10 <> 0) AS major, count(*) FILTER (WHERE vec_id % 10 = 0) AS minor, count(*) FILTER (WHERE vec_id % 10 = 0) >= 1000 OR count(*) FILTER (WHERE vec_id % 10 = 0) > 0.1 * count(*) FILTER (WHERE vec_id % 10 <> 0) AS needed FROM embeddings")
def needs_compaction(spark, sf):
    v = vectors(spark, sf)
    return N.needs_compaction(v.where("vec_id % 10 <> 0"), v.where("vec_id % 10 = 0"))


@_query("centroids", f"WITH {VECTORS_SQL}, e AS (SELECT label, unnest(v) AS x, unnest(range(64)) AS i FROM vectors) SELECT label, CAST(i AS INTEGER) AS i, round(avg(x), 6) AS x FROM e GROUP BY ALL")
def centroids(spark, sf):
    return N.centroids(vectors(spark, sf), "label").select("label", F.posexplode("v").alias("i", "x")).withColumn("x", F.round("x", 6))


@_query("centroid_knn", f"""WITH {VECTORS_SQL}, e AS (SELECT label, unnest(v) AS x, unnest(range(64)) AS i FROM vectors), m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY label),
p AS (SELECT c.label AS from_group, v.label AS to_group, v.vec_id, list_cosine_similarity(v.v, c.c) AS s FROM vectors v JOIN c ON v.label <> c.label), r AS (SELECT *, row_number() OVER (PARTITION BY from_group ORDER BY s DESC, vec_id) AS rn FROM p WHERE s > 0.1)
SELECT from_group, to_group, count(*) AS hits, round(avg(s), 6) AS similarity FROM r WHERE rn <= 40 GROUP BY ALL""")
def centroid_knn(spark, sf):
    return N.centroid_neighbours(vectors(spark, sf), "label", threshold=0.1).withColumnRenamed("label", "to_group")


@_query("recall_context", f"""WITH {VECTORS_SQL}, h AS (SELECT file_path, chunk_index, round(list_cosine_similarity(v, {_QS}), 6) AS similarity, vec_id FROM vectors ORDER BY list_cosine_similarity(v, {_QS}) DESC, 4 LIMIT 5),
t AS (SELECT file_path, chunk_index, 'chunk ' || chunk_index || ' of ' || file_path AS content FROM vectors) SELECT h.file_path, h.chunk_index, h.similarity, left(string_agg(t.content, chr(10) ORDER BY t.chunk_index), 600) AS context FROM h JOIN t ON t.file_path = h.file_path AND t.chunk_index BETWEEN h.chunk_index - 1 AND h.chunk_index + 1 GROUP BY ALL""")
def recall_context(spark, sf):
    v = vectors(spark, sf)
    return N.recall(v, v.select("file_path", "chunk_index", F.format_string("chunk %d of %s", "chunk_index", "file_path").alias("content")), _Q)


_HYBRID = f"{FILES_SQL}, {VECTORS_SQL}, {_BM25.format(key='doc_id', source='files', words=repr('license') + ', ' + repr('version'))}, l AS (SELECT * FROM scored ORDER BY score DESC, doc_id LIMIT 20), r AS (SELECT vec_id AS doc_id, round(list_cosine_similarity(v, {_QS}), 6) AS score FROM vectors ORDER BY list_cosine_similarity(v, {_QS}) DESC, 1 LIMIT 20)"


def _hybrid(spark, sf):
    left = T.bm25(files(spark, sf), ["doc_id"], ["license", "version"], 20)
    return left, N.top_k(vectors(spark, sf), _Q, 20).select(F.col("vec_id").alias("doc_id"), F.col("similarity").alias("score"))


@_query("hybrid_rrf", f"WITH {_HYBRID}, a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r1 FROM l), b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r2 FROM r) SELECT doc_id, round(coalesce(1.0::DOUBLE / (60 + r1), 0) + coalesce(1.0::DOUBLE / (60 + r2), 0), 9) AS score FROM a FULL JOIN b USING (doc_id)")
def hybrid_rrf(spark, sf):
    return T.fuse_ranks(*_hybrid(spark, sf), ["doc_id"])


@_query("hybrid_weighted", f"WITH {_HYBRID} SELECT doc_id, round(0.4::DOUBLE * coalesce(l.score, 0) + 0.6::DOUBLE * coalesce(r.score, 0), 6) AS score FROM l FULL JOIN r USING (doc_id)")
def hybrid_weighted(spark, sf):
    return T.fuse_weighted(*_hybrid(spark, sf), ["doc_id"])


@_query("lsa_topk")
def lsa_topk(spark, sf):
    f = files(spark, sf).select("file_path", F.lit(0).alias("chunk_index"), "content")
    model = N.lsa_fit(f, dims=32)
    question = spark.range(1).select(F.lit("?").alias("file_path"), F.lit(0).alias("chunk_index"), F.lit("license version rights the of and").alias("content"))
    q = N.lsa_encode(question, model).first()["v"]
    return N.top_k(N.lsa_encode(f, model), q, 10, key="file_path").select("file_path", F.round("similarity", 4).alias("similarity"))


# --- keywords -----------------------------------------------------------------


@_query("term_freq_top", f"""WITH {FILES_SQL}, t AS (SELECT file_path, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT file_path, regexp_extract_all(lower(content), 'WORD') AS w FROM files)), g AS (SELECT file_path, term, count(*) AS tf, min(pos) AS first FROM t GROUP BY ALL)
SELECT file_path, term, tf, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY tf DESC, first) AS rank FROM g) WHERE rank <= 10""")
def term_freq_top(spark, sf):
    return K.top_terms(files(spark, sf), X.tokens(F.col("content")))


_KEYWORD_STOPS = "[" + ", ".join(f"'{w}'" for w in X.KEYWORD_STOPS) + "]"
_STOPS = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"


@_query("tokens_stopword", f"""WITH {FILES_SQL}, t AS (SELECT file_path, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT file_path, list_transform(regexp_extract_all(lower(content), '[a-z][a-z_\\-'']{{2,}}'), lambda x: trim(x, '''-_')) AS w FROM files)),
g AS (SELECT file_path, term, min(pos) AS first FROM t WHERE term <> '' AND NOT list_contains({_KEYWORD_STOPS}, term) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY first) AS rn FROM g)
SELECT f.file_path, coalesce(string_agg(term, ',' ORDER BY rn) FILTER (WHERE rn <= 20), '') AS keywords FROM files f LEFT JOIN r ON r.file_path = f.file_path GROUP BY f.file_path""")
def tokens_stopword(spark, sf):
    return files(spark, sf).select("file_path", F.array_join(X.keywords(F.col("content")), ",").alias("keywords"))


_TFIDF = f"""{CHUNKS_SQL}, w AS (SELECT file_path, chunk_index, list_filter(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({_STOPS}, x)) AS w FROM chunks),
terms AS (SELECT file_path, chunk_index, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM w), tf AS (SELECT file_path, chunk_index, term, count(*) AS tf FROM terms GROUP BY ALL),
n AS (SELECT file_path, count(*) AS n FROM chunks GROUP BY 1 HAVING count(*) > 1), df AS (SELECT file_path, term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY ALL),
few AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY total DESC, term) AS place FROM df JOIN n USING (file_path) WHERE df <= 0.95 * n),
x AS (SELECT tf.*, few.n, tf * (ln((1 + few.n) / CAST(1 + few.df AS DOUBLE)) + 1) AS x FROM tf JOIN few USING (file_path, term) WHERE place <= 1000),
u AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY file_path, chunk_index)) AS y FROM x), m AS (SELECT file_path, term, round(sum(y) / n, 6) AS score FROM u GROUP BY file_path, term, n),
tfidf AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY file_path ORDER BY score DESC, term) AS INTEGER) AS rank FROM m) WHERE rank <= 20)"""


@_query("tfidf_file_top20", f"WITH RECURSIVE {_TFIDF} SELECT file_path, score, rank FROM tfidf")
def tfidf_file_top20(spark, sf):
    return K.file_tfidf(C.chunk_code(files(spark, sf))).select("file_path", "score", "rank")


@_query("global_idf", f"WITH {FILES_SQL}, t AS (SELECT DISTINCT file_path, unnest(regexp_extract_all(lower(content), 'WORD')) AS term FROM files) SELECT term, count(*) AS df, round(ln((SELECT count(*) FROM files) / CAST(count(*) + 1 AS DOUBLE)), 6) AS idf FROM t GROUP BY term")
def global_idf(spark, sf):
    f = files(spark, sf)
    return K.global_idf(f.select("file_path", F.explode(X.tokens(F.col("content"))).alias("term")), f.select("file_path"))


_FREQUENT = f"""t AS (SELECT file_path, lang, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT file_path, lang, regexp_extract_all(lower(content), 'WORD') AS w FROM files)), g AS (SELECT file_path, lang, term, count(*) AS tf, min(pos) AS first FROM t GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY tf DESC, first) AS rank FROM g) WHERE rank <= 20), idf AS (SELECT term, round(ln((SELECT count(*) FROM files) / CAST(count(*) + 1 AS DOUBLE)), 6) AS idf FROM top GROUP BY term)"""
_NOISY = "length(term) > 40 OR contains(term, '/') OR suffix(term, '.md') OR suffix(term, '.py') OR suffix(term, '.txt') OR suffix(term, '.json') OR suffix(term, '.csv') OR length(regexp_replace(term, '[^\\p{L}]', '', 'g')) < greatest(length(term), 1) * 0.5"


@_query("project_keywords", f"WITH {FILES_SQL}, {_FREQUENT}, x AS (SELECT lang, term, tf * idf AS x FROM top JOIN idf USING (term) WHERE NOT ({_NOISY})), s AS (SELECT lang, term, round(sum(x), 6) AS weight FROM x WHERE x > 0.001 GROUP BY ALL) SELECT lang, term, weight, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS rank FROM s) WHERE rank <= 25")
def project_keywords(spark, sf):
    f = files(spark, sf)
    scored = K.top_terms(f, X.tokens(F.col("content")), 20, ("lang",)).select("file_path", "lang", "term", F.col("tf").alias("score"))
    return K.group_keywords(scored, K.global_idf(scored, f.select("file_path")), "lang")


@_query("project_top_files", f"WITH {FILES_SQL} SELECT lang, file_path, file_size, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY file_size DESC, file_path) AS rank FROM files) WHERE rank <= 5")
def project_top_files(spark, sf):
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("file_size"), "file_path"))
    return files(spark, sf).withColumn("rank", rank).where("rank <= 5").select("lang", "file_path", "file_size", "rank")


@_query("noise_filter", f"WITH t AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS term FROM documents) SELECT term FROM t WHERE {_NOISY}")
def noise_filter(spark, sf):
    return table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("term")).distinct().where(K.noise(F.col("term")))


@_query("keyword_search", f"WITH {FILES_SQL} SELECT file_path, {TIME.format('last_modified')} AS modified FROM files WHERE list_has_any(regexp_extract_all(lower(content), 'WORD'), ['license', 'reserved']) {_NEWEST} 20")
def keyword_search(spark, sf):
    analysis = files(spark, sf).withColumn("keywords", X.tokens(F.col("content")))
    return K.search(analysis, ["license", "reserved"]).select("file_path", _time("last_modified").alias("modified"))


# --- table versions -------------------------------------------------------------


@_query("upsert_files", f"WITH {FILES_SQL} SELECT file_path, CASE WHEN doc_id % 3 = 0 THEN file_size + 1 ELSE file_size END AS file_size FROM files")
def upsert_files(spark, sf):
    old = files(spark, sf).select("file_path", "file_size", "doc_id", F.lit(1).alias("version"))
    new = old.where("doc_id % 3 = 0").withColumns({"file_size": F.col("file_size") + 1, "version": F.lit(2)})
    return M.upsert(old, new, ["file_path"], "version").select("file_path", "file_size")


@_query("upsert_nodes", f"WITH {EDGES_SQL} SELECT target_node AS node_id, arg_min(source_node, event_id) AS label, min(event_id) AS first_seen, max(event_id) AS last_seen, arg_max(edge_type, event_id) AS metadata FROM edges GROUP BY 1")
def upsert_nodes(spark, sf):
    return M.merge_nodes(edges(spark, sf).select(F.col("target_node").alias("node_id"), F.col("source_node").alias("label"), F.col("event_id").alias("seen"), F.col("edge_type").alias("metadata")))


@_query("insert_ignore", f"WITH {FILES_SQL} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'old' ELSE 'new' END AS origin FROM files")
def insert_ignore(spark, sf):
    f = files(spark, sf).select("doc_id")
    return M.insert_or_ignore(f.where("doc_id % 2 = 0").withColumn("origin", F.lit("old")), f.withColumn("origin", F.lit("new")), ["doc_id"])


@_query("signals_first_seen", f"WITH {EDGES_SQL} SELECT source_node, target_node, min(event_id) AS first_seen, count(*) = 1 AS is_new FROM edges GROUP BY 1, 2")
def signals_first_seen(spark, sf):
    return M.signals(edges(spark, sf), ["source_node", "target_node"], "event_id")


@_query("signals_unacknowledged", f"WITH {EDGES_SQL} SELECT source_node, target_node, min(event_id) AS first_seen FROM edges GROUP BY 1, 2 HAVING count(*) = 1 ORDER BY 3 DESC LIMIT 20")
def signals_unacknowledged(spark, sf):
    return M.signals(edges(spark, sf), ["source_node", "target_node"], "event_id").where("is_new").orderBy(F.desc("first_seen")).limit(20).drop("is_new")


@_query("replace_chunks", f"WITH RECURSIVE {CHUNKS_SQL} SELECT c.file_path, c.chunk_index, c.content FROM chunks c JOIN files f USING (file_path) WHERE f.doc_id % 5 <> 0 UNION ALL SELECT file_path, 0, content FROM files WHERE doc_id % 5 = 0")
def replace_chunks(spark, sf):
    f = files(spark, sf)
    return M.replace_children(C.chunk_code(f), f.where("doc_id % 5 = 0").select("file_path", F.lit(0).alias("chunk_index"), "content"))


@_query("copy_by_hash", f"WITH {FILES_SQL}, k AS (SELECT file_hash, min(file_path) AS source_path FROM files WHERE doc_id % 2 = 0 GROUP BY 1) SELECT f.file_path, k.source_path FROM files f JOIN k USING (file_hash) WHERE f.doc_id % 2 = 1")
def copy_by_hash(spark, sf):
    f = files(spark, sf).select("file_path", "file_hash", "doc_id")
    return M.copy_by_hash(f, f.where("doc_id % 2 = 0").select("file_path"))


@_query("orphans_anti", f"WITH {FILES_SQL} SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def orphans_anti(spark, sf):
    return M.orphans(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"), "doc_id")


@_query("fk_semi", "SELECT d.doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def fk_semi(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_semi")


@_query("duplicate_hashes", f"WITH {FILES_SQL} SELECT file_hash, count(*) AS n, min(file_path) AS first_path FROM files GROUP BY 1 HAVING count(*) > 1")
def duplicate_hashes(spark, sf):
    return files(spark, sf).groupBy("file_hash").agg(F.count("*").alias("n"), F.min("file_path").alias("first_path")).where("n > 1")


# --- graph ----------------------------------------------------------------------


@_query("feedback_edges", "SELECT conv_id AS context, target_node, CASE WHEN target_node % 3 = 0 THEN 'accepted' WHEN target_node % 3 = 1 THEN 'rejected' ELSE 'ignored' END AS edge_type, CAST(CASE WHEN target_node % 3 = 0 THEN 1.0 WHEN target_node % 3 = 1 THEN -0.5 ELSE 0.0 END AS DOUBLE) AS weight FROM (SELECT DISTINCT conv_id, turn AS target_node FROM conversations)")
def feedback_edges(spark, sf):
    offered = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("context")).agg(F.collect_set("turn").alias("offered"))
    picked = lambda r: F.filter("offered", lambda x: x % 3 == r)
    return G.outcome_edges(offered.withColumns({"accepted": picked(0), "rejected": picked(1)}))


_SIMILAR = "alike AS (SELECT DISTINCT source_node, (ascii(right(source_node, 1)) % 10) / CAST(10 AS DOUBLE) AS similarity FROM edges)"


@_query("recommend_sources", f"""WITH {EDGES_SQL}, {_SIMILAR}, s AS (SELECT target_node, sum(CASE WHEN edge_type = 'accepted' THEN similarity ELSE 0 END) AS yes, sum(CASE WHEN edge_type = 'rejected' THEN similarity ELSE 0 END) AS no, sum(weight * similarity) AS w FROM edges JOIN alike USING (source_node) WHERE similarity >= 0.5 AND edge_type IN ('accepted', 'rejected') GROUP BY 1)
SELECT target_node, round_even(yes / (yes + no), 3) AS confidence, round_even(w, 3) AS total_weight, round_even(yes, 2) AS accept_count, round_even(no, 2) AS reject_count FROM s WHERE yes + no > 0 AND yes / (yes + no) >= 0.5 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 5""")
def recommend_sources(spark, sf):
    return G.recommend(edges(spark, sf), _alike(spark, sf))


def _alike(spark, sf):
    return edges(spark, sf).select("source_node").distinct().withColumn("similarity", F.ascii(F.right("source_node", F.lit(1))) % 10 / 10)


@_query("feedback_query", f"WITH {EDGES_SQL}, {_SIMILAR} SELECT source_node, event_id, edge_type, target_node, weight, similarity FROM edges JOIN alike USING (source_node) ORDER BY similarity DESC, weight DESC, target_node, edge_type, event_id LIMIT 10")
def feedback_query(spark, sf):
    return G.feedback(edges(spark, sf), _alike(spark, sf)).select("source_node", "event_id", "edge_type", "target_node", "weight", "similarity")


@_query("feedback_by_text", "SELECT event_id, props AS context_summary FROM events WHERE contains(lower(props), '\"k\": 1') ORDER BY event_id LIMIT 10")
def feedback_by_text(spark, sf):
    return G.feedback_by_text(table(spark, sf, "events").select("event_id", F.col("props").alias("context_summary")), '"K": 1')


@_query("graph_phase", f"WITH {EDGES_SQL} SELECT count(*) AS n_edges, count(DISTINCT source_node) AS n_contexts, count(DISTINCT target_node) AS n_targets, CASE WHEN count(*) = 0 THEN 'Cold' WHEN count(*) < 10 THEN 'Learning' WHEN count(*) < 50 THEN 'Warm' ELSE 'Hot' END AS phase FROM edges")
def graph_phase(spark, sf):
    return G.phase(edges(spark, sf))


@_query("edge_type_counts", f"WITH {EDGES_SQL} SELECT edge_type, count(*) AS n, round(sum(weight), 6) AS weight FROM edges GROUP BY 1")
def edge_type_counts(spark, sf):
    return edges(spark, sf).groupBy("edge_type").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


@_query("degree", f"WITH {EDGES_SQL} SELECT node, count(*) AS degree FROM (SELECT source_node AS node FROM edges UNION ALL SELECT target_node FROM edges) GROUP BY 1")
def degree(spark, sf):
    e = edges(spark, sf)
    return e.select(F.col("source_node").alias("node")).union(e.select("target_node")).groupBy("node").agg(F.count("*").alias("degree"))


def _pairs(spark, sf):
    d = table(spark, sf, "documents")
    return d.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("a"), F.expr("doc_id div 2").alias("b"))


def _folder(spark):
    """A new folder under the shared one that the session names; only where all runs on one machine, a temporary one."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


_COMPONENTS = """up AS (SELECT doc_id AS node, doc_id AS now FROM documents UNION ALL SELECT node, now // 2 FROM up WHERE now % 11 <> 0 AND now <> now // 2),
roots AS (SELECT node, min(now) AS root FROM up GROUP BY node), ends AS (SELECT DISTINCT node FROM (SELECT doc_id AS node FROM documents WHERE doc_id % 11 <> 0 AND doc_id <> doc_id // 2 UNION ALL SELECT doc_id // 2 FROM documents WHERE doc_id % 11 <> 0 AND doc_id <> doc_id // 2))"""


@_query("components", f"WITH RECURSIVE {_COMPONENTS} SELECT r.node, r.root FROM roots r JOIN ends USING (node)")
def components(spark, sf):
    return G.components(_pairs(spark, sf), _folder(spark))


@_query("cluster_labels", f"""WITH RECURSIVE {_COMPONENTS}, p AS (SELECT doc_id AS a, doc_id // 2 AS b FROM documents WHERE doc_id % 11 <> 0), d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM p UNION ALL SELECT b FROM p) GROUP BY 1),
k AS (SELECT r.root, r.node, row_number() OVER (PARTITION BY r.root ORDER BY d.degree DESC, r.node) AS rank FROM roots r JOIN ends USING (node) JOIN d USING (node)) SELECT root, string_agg(CAST(node AS VARCHAR), ' + ' ORDER BY rank) AS label FROM k WHERE rank <= 3 GROUP BY root""")
def cluster_labels(spark, sf):
    p = _pairs(spark, sf)
    return G.labels(G.components(p, _folder(spark)), p)


@_query("shortest_path", """WITH RECURSIVE p AS (SELECT doc_id AS a, doc_id // 2 AS b FROM documents WHERE doc_id % 11 <> 0), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT 1::BIGINT AS node, 0 AS hops UNION SELECT e.b, r.hops + 1 FROM r JOIN e ON e.a = r.node WHERE r.hops < 4) SELECT node, min(hops) AS hops FROM r GROUP BY 1""")
def shortest_path(spark, sf):
    return G.hops(_pairs(spark, sf), F.lit(1).cast("long"), _folder(spark), 4)


# --- sessions -------------------------------------------------------------------


@_query("session_chain", f"WITH {SESSIONS_SQL} SELECT id, project, {TIME.format('started_at')} AS started, turns FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY started_at DESC) AS rn FROM sessions) WHERE rn <= 3")
def session_chain(spark, sf):
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("started_at")))
    return sessions(spark, sf).withColumn("rn", rank).where("rn <= 3").select("id", "project", _time("started_at").alias("started"), "turns")


@_query("last_turns", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS rn FROM conversations) SELECT conv_id, role, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS n FROM r WHERE (role = 'user' AND rn <= 10) OR (role = 'assistant' AND rn <= 5) GROUP BY 1, 2")
def last_turns(spark, sf):
    return R.last_turns(table(spark, sf, "conversations"), {"user": 10, "assistant": 5})


@_query("pool_b_latest", "SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' AND text <> '' GROUP BY 1")
def pool_b_latest(spark, sf):
    return table(spark, sf, "conversations").where("role = 'assistant' and text <> ''").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


def _pool_sql(role):
    words = f"SELECT conv_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT conv_id, list_transform(regexp_extract_all(lower(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role = '{role}')), '[a-z][a-z_\\-'']{{2,}}'), lambda x: trim(x, '''-_')) AS w FROM conversations GROUP BY 1)"
    return f"(SELECT conv_id, list(term ORDER BY first)[1:40] AS {role} FROM (SELECT conv_id, term, min(pos) AS first FROM ({words}) WHERE term <> '' AND NOT list_contains({_KEYWORD_STOPS}, term) GROUP BY ALL) GROUP BY 1)"


@_query("keyword_merge", f"SELECT c.conv_id, array_to_string(list_filter(coalesce(\"user\", []), lambda x: list_contains(coalesce(assistant, []), x)) || list_filter(coalesce(\"user\", []), lambda x: NOT list_contains(coalesce(assistant, []), x)) || list_filter(coalesce(assistant, []), lambda x: NOT list_contains(coalesce(\"user\", []), x)), ',') AS keywords FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN {_pool_sql('user').replace('AS user ', 'AS \"user\" ')} u USING (conv_id) LEFT JOIN {_pool_sql('assistant')} a USING (conv_id)")
def keyword_merge(spark, sf):
    said = lambda r: F.array_join(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("turn", "text")))).getField("text"), " ").alias(r)
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(*[said(r) for r in ("user", "assistant")])
    return c.select("conv_id", F.array_join(R.merged_pools(X.keywords(F.col("user"), 40), X.keywords(F.col("assistant"), 40)), ",").alias("keywords"))


def _matches(spark, sf):
    c = table(spark, sf, "conversations").where("role <> 'system'")
    return c.select(F.col("conv_id").alias("session"), "turn", F.when(F.col("role") == "user", "A").otherwise("B").alias("pool"), F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("node"))


_MATCHES = """m AS (SELECT DISTINCT conv_id AS session, turn, CASE role WHEN 'user' THEN 'A' ELSE 'B' END AS pool, unnest(regexp_extract_all(lower(text), 'WORD')) AS node FROM conversations WHERE role <> 'system')"""


@_query("ground_state", f"WITH {_MATCHES}, p AS (SELECT session, node, turn, count(*) FILTER (WHERE pool = 'A') AS a, count(*) FILTER (WHERE pool = 'B') AS b FROM m GROUP BY 1, 2, 3) SELECT session, node, turn, CAST(sum(a) OVER w AS BIGINT) AS a_count, CAST(sum(b) OVER w AS BIGINT) AS b_count FROM p WINDOW w AS (PARTITION BY session, node ORDER BY turn)")
def ground_state(spark, sf):
    return R.match_state(_matches(spark, sf))


@_query("ground_scores", f"""WITH {_MATCHES}, s AS (SELECT session, node, count(*) FILTER (WHERE pool = 'A') AS a, count(*) FILTER (WHERE pool = 'B') AS b, max(turn) AS last FROM m GROUP BY 1, 2), n AS (SELECT session, max(turn) AS now FROM m GROUP BY 1),
x AS (SELECT session, node, now, round(CASE WHEN a > 0 AND b > 0 THEN 3 WHEN a > 0 THEN 2 ELSE 1 END * (a + b) / CAST(greatest(now - last + 1, 1) AS DOUBLE), 6) AS score FROM s JOIN n USING (session)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY session ORDER BY score DESC, node) AS INTEGER) AS rank FROM x WHERE score >= 0.4 * (1 - 1 / CAST(greatest(now, 1) AS DOUBLE))) SELECT session, node, score, rank FROM r WHERE rank <= 8""")
def ground_scores(spark, sf):
    return R.ranked(_matches(spark, sf))


@_query("ground_delta", f"""WITH {_MATCHES}, s AS (SELECT session, node, count(*) FILTER (WHERE pool = 'A') AS a, count(*) FILTER (WHERE pool = 'B') AS b, count(*) FILTER (WHERE pool = 'A' AND turn <= 2) AS pa, count(*) FILTER (WHERE pool = 'B' AND turn <= 2) AS pb, max(turn) AS last FROM m WHERE turn <= 4 GROUP BY 1, 2),
k AS (SELECT session, node, CASE WHEN a > 0 AND b > 0 AND pa = 0 AND pb = 0 THEN 'new_ab' WHEN a > 0 AND b > 0 AND pa > 0 AND pb = 0 THEN 'promoted' WHEN a = 0 AND b > 1 THEN 'b_persistent' WHEN (pa > 0 OR pb > 0) AND last < 4 - 2 THEN 'faded' END AS kind FROM s) SELECT * FROM k WHERE kind IS NOT NULL""")
def ground_delta(spark, sf):
    return R.delta(_matches(spark, sf), 4, 2)


# --- scalar functions -------------------------------------------------------------


@_query("path_functions", f"WITH {FILES_SQL} SELECT file_path, regexp_extract(file_path, '[^/]*$') AS name, regexp_replace(file_path, '/[^/]+$', '') AS directory, file_type AS suffix, replace(file_path, '/', '-') AS flat FROM files")
def path_functions(spark, sf):
    p = F.col("file_path")
    return files(spark, sf).select(p, X.basename(p).alias("name"), X.dirname(p).alias("directory"), X.suffix(p).alias("suffix"), F.replace(p, F.lit("/"), F.lit("-")).alias("flat"))


@_query("hashes", "SELECT doc_id, sha256(text) AS sha, left(sha256(lang || '|' || source), 16) AS short, md5(text) AS md5, left(md5(text), 8) AS context FROM documents")
def hashes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), X.short_hash(F.col("lang"), F.col("source")).alias("short"), F.md5("text").alias("md5"), F.left(F.md5("text"), F.lit(8)).alias("context"))


@_query("text_counts", "SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS INTEGER) AS words, length(text) AS chars, CAST(len(string_split(text, chr(10))) AS INTEGER) AS lines, left(text, 50) AS head, right(text, 50) AS tail FROM documents")
def text_counts(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", X.word_count(t).alias("words"), F.length(t).alias("chars"), X.line_count(t).alias("lines"), F.left(t, F.lit(50)).alias("head"), F.right(t, F.lit(50)).alias("tail"))


@_query("slugify", "SELECT page_id, CASE WHEN s = '' THEN 'unknown' ELSE s END AS slug FROM (SELECT page_id, trim(left(regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g'), 40), '_') AS s FROM pages)")
def slugify(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.slug(F.col("url")).alias("slug"))


@_query("clean_text", "SELECT doc_id, trim(lower(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '[^\\p{L}\\p{N}_ .!?,;:()-]', '', 'g'))) AS cleaned FROM documents")
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.clean(F.col("text")).alias("cleaned"))


@_query("json_access", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(props) AS ok FROM events")
def json_access(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.try_parse_json("props").isNotNull().alias("ok"))


@_query("ts_parse", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y-%m-%d') AS day FROM events")
def ts_parse(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf, "events").select("event_id", F.date_format(X.parse_time(iso), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


@_query("ansi_strip", "SELECT doc_id, text AS plain FROM documents")
def ansi_strip(spark, sf):
    t = F.concat(F.lit("\x1b[31m"), F.col("text"), F.lit("\x1b]0;title\x07\x1b[0m\x1bc"))
    return table(spark, sf, "documents").select("doc_id", X.strip_escapes(t).alias("plain"))


@_query("daily_counts", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def daily_counts(spark, sf):
    return table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


@_query("pii_detect", "SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(text, '{p}')) AS INTEGER) AS {k}" for k, p in X.DETECTORS.items()) + " FROM documents")
def pii_detect(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *[c.alias(k) for k, c in X.detected(F.col("text")).items()])


def _masked_sql():
    text = "text"
    for kind, p in X.DETECTORS.items():
        text = f"regexp_replace({text}, '{p}', '[{kind.upper()}]', 'g')"
    return f"SELECT doc_id, {text} AS text FROM documents"


@_query("pii_mask", _masked_sql())
def pii_mask(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.masked(F.col("text")).alias("text"))


# --- streams --------------------------------------------------------------------


def _stream(spark, sf):
    return spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")


def _drained(spark, stream, mode="complete"):
    from ..streaming.events import drained

    return drained(stream, _folder(spark), mode)


@_query("stream_tumbling", "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf):
    from ..streaming.events import tumbling

    out = _drained(spark, tumbling(_stream(spark, sf), "ts", "1 hour"))
    return out.select(_time("start").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


@_query("stream_sessionize", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessionize(spark, sf):
    from ..streaming.events import sessionized

    return _drained(spark, sessionized(_stream(spark, sf), "ts", "30 minutes", "user_id")).select("user_id", _time("start").alias("start"), "n")


@_query("stream_dedup_signals", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup_signals(spark, sf):
    from ..streaming.events import first_sightings

    return _drained(spark, first_sightings(_stream(spark, sf).select("user_id", "event_type"), ["user_id", "event_type"]), "append")
