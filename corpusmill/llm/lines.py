"""Line dedup: drop lines that several documents share, except in the document with the smallest id.

Only DataFrame functions run here. Lines are exploded with a hash of their
normalised form, never with their text, and written once. A hash's documents are counted by a
minimum and a maximum, which combine before the shuffle, so a line that every
document holds costs one row a task there. To find the lines to drop, hashes that very many lines have
are broadcast, so such lines never meet in one task; how many these hashes are is bounded by how they are chosen. Documents are
put together again by their own line array, so no line text is shuffled a second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, documents, hash_pair, stored

#: Lines that share a hash from which on the hash is broadcast, at least; hashes broadcast at most (any more would need more lines than there are).
HOT_LINES, MOST_HOT = 2000, 200_000
_ID, _TEXT_HASH, _DROPPED, _LINES = "__line_id", "__line_text", "__line_dropped", "__line_all"


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """docs with text_col rewritten, and n_lines, n_dropped (long) added (they replace columns of those names).

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys
    of at least min_chars code points that two documents hold stay only in the smallest id.

    Null text counts as empty: one empty line, which stays. A null id counts as one
    document with an id below all others. Repeated rows (same id) are one document;
    each row is returned. A document that loses all its lines has an empty text.
    An empty table gives an empty result; other columns pass through.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.withColumns({_ID: F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))), _TEXT_HASH: F.xxhash64(text)})
    lines = F.split(text, "\n", -1)
    key = ascii_lower(F.btrim(F.col("__line"), F.lit(ASCII_SPACE)))
    h1, h2 = hash_pair(F.col("__key"))
    keyed = (
        own.select(_ID, _TEXT_HASH, F.posexplode(lines).alias("__pos", "__line"))
        .select(_ID, _TEXT_HASH, "__pos", key.alias("__key"))
        .where(F.length("__key") >= min_chars)
        .select(_ID, _TEXT_HASH, "__pos", h1.alias("__h1"), h2.alias("__h2"))
    )
    keyed = stored(keyed)
    hot = max(HOT_LINES, keyed.count() // MOST_HOT)
    hash_ = ["__h1", "__h2"]
    shared = keyed.groupBy(*hash_).agg(F.min(_ID).alias("__first"), F.max(_ID).alias("__last"), F.count("*").alias("__n")).where("__first < __last")
    shared = stored(shared.select(*hash_, "__first", "__n"))
    common = F.broadcast(shared.where(F.col("__n") > hot).select(*hash_, "__first"))  # at most MOST_HOT rows
    met = keyed.join(common, hash_).unionByName(keyed.join(common.select(*hash_), hash_, "left_anti").join(shared.where(F.col("__n") <= hot).select(*hash_, "__first"), hash_))
    dropped = met.where(F.col(_ID) > F.col("__first")).groupBy(_ID, _TEXT_HASH).agg(F.collect_set("__pos").alias(_DROPPED))
    # the lines are a column of their own, or the lambda would split the text anew for every line; it is read twice, so it stays one
    out = own.join(dropped, [_ID, _TEXT_HASH], "left").withColumn(_LINES, lines)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(_LINES) - 1), F.col(_DROPPED)), lambda i: F.get(F.col(_LINES), i))
    return out.withColumns(
        {
            "n_lines": F.size(_LINES).cast("long"),
            "n_dropped": F.coalesce(F.size(_DROPPED), F.lit(0)).cast("long"),
            text_col: F.when(F.col(_DROPPED).isNull(), text).otherwise(F.array_join(kept, "\n")),
        }
    ).drop(_ID, _TEXT_HASH, _DROPPED, _LINES)


def op8_line_dedup(spark, sf_dir):
    out = drop_shared_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
judged AS (
  SELECT k.doc_id, k.pos, k.line, s.first IS NOT NULL AND k.doc_id > s.first AS gone
  FROM keyed k LEFT JOIN shared s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
