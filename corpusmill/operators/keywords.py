"""Keywords: term frequencies, TF-IDF of a file over its chunks, global IDF, group rollups, keyword search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import groups as B
from ..functions.text import STOP_WORDS


#: Ends of terms that are file names.
NOISE_SUFFIXES = (".md", ".py", ".txt", ".json", ".csv")


def top_terms(files: DataFrame, words: Column, n: int = 10, also: tuple[str, ...] = ()) -> DataFrame:
    """The n most frequent words of each file; of equals the one that comes first. also: columns that are kept, and whose values count apart.

    The texts are dealt out by file once, and each file's words are counted where they are.
    """
    own = B.gathered(files, ["file_path"]).select("file_path", *also, words.alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, of in B.whole(batches, ["file_path"]):
            row, place, code, terms = B.coded(t["w"])
            kind = np.zeros(len(t), np.int64)
            for name in also:
                d = pa.concat_arrays(t[name].chunks).dictionary_encode(null_encoding="encode")
                kind = kind * (len(d.dictionary) + 1) + d.indices.to_numpy()
            order, starts = B.runs(of[row], kind[row], code)
            if not len(order):
                continue
            tf, first = B.lengths(starts, len(order)), np.minimum.reduceat(place[order], starts)
            at = order[starts]
            best = np.lexsort((first, -tf, of[row[at]]))
            rank = B.leading(of[row[at]][best])
            best, rank = best[rank < n], rank[rank < n]
            held = t.select(["file_path", *also]).take(pa.array(row[at[best]])).combine_chunks()
            columns = [*held.columns, terms.take(pa.array(code[at[best]])), pa.array(tf[best]), pa.array(rank + 1, pa.int32())]
            yield from pa.table(columns, names=["file_path", *also, "term", "tf", "rank"]).to_batches()

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != "w")
    return own.mapInArrow(run, f"{kept}, term string, tf long, rank int")


def _rounded(x: np.ndarray, places: int = 6) -> np.ndarray:
    """Halves go up, as in SQL."""
    x = x * 10**places
    whole = np.floor(x)
    return (whole + (x - whole >= 0.5)) / 10**places


def file_tfidf(chunks: DataFrame, n: int = 20, most_df: float = 0.95, most_terms: int = 1000, stop_words=STOP_WORDS) -> DataFrame:
    """For files of two chunks or more, the n terms (words and pairs of neighbours) of highest mean TF-IDF over the chunks.

    idf = ln((1 + chunks) / (1 + df)) + 1 within the file; terms in more than most_df of its chunks are out, and of the rest
    the most_terms most frequent stay (of equals the first in order); each chunk's vector has length one. The chunks' texts are dealt out by file once;
    all of a file's terms are weighed in one task, in Arrow batches.
    """
    words = F.regexp_extract_all(F.lower("content"), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    own = B.gathered(chunks.select("file_path", "chunk_index", "content"), ["file_path"], ["chunk_index"]).select("file_path", "chunk_index", words.alias("w"))
    stops = pa.array(list(stop_words), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, of in B.whole(batches, ["file_path"]):
            chunk = B.changes(t, ["file_path", "chunk_index"]).cumsum() - 1
            row, _, code, known = B.coded(t["w"])
            stays = ~pc.is_in(known, value_set=stops).to_numpy(zero_copy_only=False)
            row, code = row[stays[code]], code[stays[code]]
            # no letter of a word sorts before a space, so a number of (first word, second word or none) sorts as the term does
            size, near = len(known) + 1, row[1:] == row[:-1]
            term = np.concatenate([(code + 1) * size, ((code[:-1] + 1) * size + code[1:] + 1)[near]])
            row = np.concatenate([row, row[:-1][near]])
            if not len(term):
                continue
            order, starts = B.runs(chunk[row], term)
            tf, at = B.lengths(starts, len(order)), order[starts]
            term, file, chunk = term[at], of[row[at]], chunk[row[at]]
            files = np.bincount(of)

            order, starts = B.runs(file, term)
            which = np.empty(len(order), np.int64)
            which[order] = np.repeat(np.arange(len(starts)), B.lengths(starts, len(order)))
            own_file, own_term, df = file[order[starts]], term[order[starts]], B.lengths(starts, len(order))
            total, chunks_ = np.bincount(which, tf), files[own_file]
            fine = np.flatnonzero((chunks_ > 1) & (df <= most_df * chunks_))
            fine = fine[np.lexsort((own_term[fine], -total[fine], own_file[fine]))]
            fine = fine[B.leading(own_file[fine]) < most_terms]
            stays = np.zeros(len(df), bool)
            stays[fine] = True

            held = stays[which]
            which, chunk = which[held], chunk[held]
            x = tf[held] * (np.log((1 + chunks_) / (1 + df)) + 1)[which]
            x = x / np.sqrt(np.bincount(chunk, x * x))[chunk]
            score = _rounded(np.bincount(which, x, len(df)) / chunks_)
            best = fine[np.lexsort((own_term[fine], -score[fine], own_file[fine]))]
            rank = B.leading(own_file[best])
            best, rank = best[rank < n], rank[rank < n]
            first, second = known.take(pa.array(own_term[best] // size - 1)), own_term[best] % size - 1
            second = known.take(pa.array(second, mask=second < 0))
            text = pc.coalesce(pc.binary_join_element_wise(first, second, " "), first)
            path = t["file_path"].take(pa.array(np.searchsorted(of, own_file[best])))
            yield from pa.table([path, text, pa.array(score[best]), pa.array(rank + 1, pa.int32())], names=["file_path", "term", "score", "rank"]).combine_chunks().to_batches()

    return own.mapInArrow(run, "file_path string, term string, score double, rank int")


def global_idf(terms: DataFrame, files: DataFrame) -> DataFrame:
    """ln(files / (df + 1)) for each term; terms: (file_path, term); files: a row for each that counts."""
    n = files.agg(F.count("*").alias("n"))  # one row
    df = terms.select("file_path", "term").distinct().groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(F.ln(F.col("n") / (F.col("df") + 1)), 6).alias("idf"))


def noise(term: Column) -> Column:
    """Terms that are no words: long ones, paths, file names, mostly other characters than letters."""
    letters = F.length(F.regexp_replace(term, r"[^\p{L}]", ""))
    named = F.lit(False)
    for end in NOISE_SUFFIXES:
        named = named | term.endswith(end)
    return (F.length(term) > 40) | named | F.contains(term, F.lit("/")) | (letters < F.greatest(F.length(term), F.lit(1)) * 0.5)


def group_keywords(scored: DataFrame, idf: DataFrame, group: str, n: int = 25, floor: float = 0.001) -> DataFrame:
    """The n best terms of each group: sums over files of score times global IDF, small products left out."""
    x = scored.where(~noise(F.col("term"))).join(idf.select("term", "idf"), "term").withColumn("x", F.col("score") * F.col("idf")).where(F.col("x") > floor)
    sums = x.groupBy(group, "term").agg(F.round(F.sum("x"), 6).alias("weight"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("weight"), "term"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= n)


def search(analysis: DataFrame, words: list[str], limit: int | None = 20) -> DataFrame:
    """Files any of whose keywords equals any of the words, newest first. analysis: file_path, last_modified, keywords."""
    out = analysis.where(F.arrays_overlap("keywords", F.lit(words))).select("file_path", "last_modified").orderBy(F.desc_nulls_last("last_modified"), "file_path")
    return out if limit is None else out.limit(limit)
