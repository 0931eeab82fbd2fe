"""A positional inverted index that is maintained by segments, and cover-density ranks over it.

Each batch of changes is a segment: the postings (term, document's number, positions) of its documents, and a list of the documents it holds or
deletes. A document's newest segment counts, so an update or a deletion makes older postings void without touching them. A segment counts only once
its commit record is written, which comes last, so an interrupted write changes nothing; a batch that is run again replaces its own segment. merge()
writes what is live as one segment whose record replaces the others.

Postings outweigh the texts, so they are written by the task that cuts the texts and are never shuffled. A file holds the documents of a task, each slice of
them sorted by term (after a merge the whole file): a search opens every file, and Parquet's page statistics let it skip pages of other terms. Documents are
rows without a term in the same files, so one pass over the texts gives both. A document's number is its batch and a number given by its task, and stays its own through merges.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import groups as B
from ..functions import text as X
from .fulltext import Query, plain_words

#: Documents that are changed more than once in a batch, and groups of 64 numbers of documents with void ones among them, up to which they are broadcast.
FEW = 1_000_000
#: Rows of a page, the least that a search reads of a file with its term.
PAGE = 4_000
#: Bytes of a column's different values up to which Parquet writes their codes: the terms and documents of one file.
DICTIONARY = 16 << 20
#: Fixed value: the weight of a plain word in a cover-density rank.
WEIGHT = 0.1
_ROWS = "term string, doc string, length int, id bigint, positions array<int>"
_COMMITS = "number int, replaces array<int>, seg int"


@dataclass
class TextIndex:
    """An index in a folder that all machines share. tokens gives a text's words in order (null: a place without a word); words_of cuts queries alike.

    The default takes Unicode words as they are; functions.english has `tokens` and `query_words` for stems without stop words.
    """

    spark: SparkSession
    path: str
    tokens: Callable[[Column], Column] = X.tokens
    words_of: Callable[[str], list[str]] = plain_words

    def put(self, changes: DataFrame, number: int) -> None:
        """changes: doc, at, content; of several rows of a document the latest counts, a null content deletes it. number: a batch's own, higher for later ones."""
        rows = changes.select(F.col("doc").cast("string").alias("doc"), "at", F.col("content").isNotNull().alias("kept"), "content").where("doc is not null")
        words = self._settled(rows).select("doc", "kept", self.tokens(F.col("content")).alias("t"))
        self._write(words.mapInArrow(_placed, _ROWS).withColumn("origin", F.lit(number)), number)
        self._commit(number, [])

    def _settled(self, rows: DataFrame) -> DataFrame:
        """rows, those of one document in one task and in order. Texts of documents with a row each stay where they are, unless fewer tasks than there are cores hold them."""
        seen = rows.select("doc", F.spark_partition_id().alias("task")).groupBy("doc").agg(F.count("*").alias("n"), F.min("task").alias("task"))
        at = seen.agg(F.count_if(F.col("n") > 1).alias("again"), F.count_distinct("task").alias("tasks")).first()
        gathered = lambda r: B.gathered(r, ["doc"], ["at", "kept", "content"])
        if at["again"] > FEW or at["tasks"] < self.spark.sparkContext.defaultParallelism:
            return gathered(rows)
        if not at["again"]:
            return rows
        again = F.broadcast(seen.where("n > 1").select("doc"))
        return rows.join(again, "doc", "left_anti").unionByName(gathered(rows.join(again, "doc", "left_semi")))

    def _write(self, rows: DataFrame, number: int) -> None:
        out = rows.select("term", "doc", "length", "origin", "id", "positions").write.mode("overwrite").option("compression", "zstd")
        out.options(**{"parquet.page.row.count.limit": PAGE, "parquet.dictionary.page.size": DICTIONARY}).parquet(f"{self.path}/rows/seg={number}")

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(f"{_ROWS}, origin int, seg int").parquet(f"{self.path}/rows").where(F.col("seg").isin(self.segments()))

    def _docs(self) -> DataFrame:
        return self._rows().where("term is null").select("doc", "length", "origin", "id", "seg")

    def _commit(self, number: int, replaces: list[int]) -> None:
        self.spark.createDataFrame([(number, replaces)], "number int, replaces array<int>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/seg={number}")

    def segments(self) -> list[int]:
        """Committed segments that no other replaces: one for each batch since the last merge, and that merge's."""
        try:
            rows = self.spark.read.schema(_COMMITS).parquet(f"{self.path}/commits").collect()
        except Exception as error:  # nothing is committed yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return []
        gone = {n for r in rows for n in r["replaces"]}
        return sorted(r["number"] for r in rows if r["number"] not in gone)

    def live(self) -> DataFrame:
        """doc, seg, length, and the document's number (origin, id): the newest segment of each document that is not deleted there."""
        if not self.segments():
            return self.spark.createDataFrame([], "doc string, seg int, length int, origin int, id bigint")
        newest = self._docs().groupBy("doc").agg(F.max(F.struct("seg", "length", "origin", "id")).alias("n"))
        return newest.select("doc", "n.*").where("length is not null")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """term, doc, positions, length of live documents, of the terms only if they are given."""
        return self._live_postings(terms).join(self.live().select("doc", "length", "origin", "id"), ["origin", "id"]).select("term", "doc", "positions", "length")

    def _live_postings(self, terms: list[str] | None = None) -> DataFrame:
        """term, origin, id, positions. Where several segments count, postings of documents with a newer one are left out: a bit for each is broadcast, so postings stay where they are."""
        own = self.segments()
        if not own:
            return self.spark.createDataFrame([], "term string, origin int, id bigint, positions array<int>")
        rows = self._rows().where("term is not null" if terms is None else F.col("term").isin(terms))
        if len(own) > 1:
            held = F.struct("seg", "origin", "id")
            old = self._docs().groupBy("doc").agg(F.collect_list(held).alias("all"), F.max(held).alias("newest")).where(F.size("all") > 1)
            void = old.select(F.explode(F.filter("all", lambda d: d != F.col("newest"))).alias("d")).select("d.origin", F.expr("d.id div 64").alias("word"), F.expr("cast(d.id % 64 as int)").alias("bit"))
            void = void.groupBy("origin", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("gone"))
            few = void.limit(FEW + 1).count() <= FEW
            rows = rows.withColumn("word", F.expr("id div 64")).join(F.broadcast(void) if few else void, ["origin", "word"], "left").where("gone is null or getbit(gone, id % 64) = 0")
        return rows.select("term", "origin", "id", "positions")

    def merge(self, number: int) -> None:
        """All live postings as one segment of that number, which replaces those there are."""
        own = self.segments()
        if not own or max(own) >= number:
            raise ValueError(f"a merge needs a number over {own}")
        rows = self._live_postings().unionByName(self.live().drop("seg"), allowMissingColumns=True)
        self._write(rows.sortWithinPartitions("term", "origin", "id"), number)
        self._commit(number, own)

    def follow(self, stream: DataFrame, checkpoint: str, merge_every: int = 0) -> None:
        """Takes in all that a stream of changes holds now. Batch n is segment 2n; after every merge_every batches the segments are merged as 2n + 1."""

        def take(batch: DataFrame, n: int) -> None:
            self.put(batch, 2 * n)
            if merge_every and (n + 1) % merge_every == 0:
                self.merge(2 * n + 1)

        query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()

    def search(self, query: str, limit: int | None = 10) -> DataFrame:
        """doc, rank, covers: documents that satisfy a web-style query, by cover density: each minimal stretch of words that satisfies it adds
        0.1 / (1 + words in it that are no words of the query). Ties go by doc. Excluded words and phrases only leave documents out."""
        q = Query.parse(query, self.words_of)
        terms = sorted({w for g in [*q.groups, q.excluded] for unit in g for w in unit if w is not None})
        if not q.groups:
            return self.spark.createDataFrame([], "doc string, rank double, covers int")
        found = self._live_postings(terms).groupBy("origin", "id").agg(F.collect_list(F.struct("term", "positions")).alias("found"))
        ranked = found.mapInArrow(_ranks(q), "origin int, id bigint, rank double, covers int")
        out = ranked.join(self.live(), ["origin", "id"]).select("doc", "rank", "covers").orderBy(F.desc("rank"), "doc")
        return out if limit is None else out.limit(limit)


def _latest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Of each document the row that comes last."""
    for t, of in B.whole(batches, ["doc"]):
        yield t.take(pa.array(np.flatnonzero(np.diff(of, append=of[-1] + 1)))).combine_chunks()


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document a row with its number and length (null, if it is deleted), and a row for each of its terms, those of a slice in order of terms."""
    names, given = _ROWS.replace(",", "").split()[::2], TaskContext.get().partitionId() << 32

    def out(n: int, **columns: pa.Array) -> list[pa.RecordBatch]:
        kinds = {"term": pa.string(), "doc": pa.string(), "length": pa.int32(), "id": pa.int64(), "positions": pa.list_(pa.int32())}
        return pa.table([columns.get(k, pa.nulls(n, kinds[k])) for k in names], names=names).combine_chunks().to_batches()

    for t in _latest(batches):
        ids = np.arange(given, given + len(t))
        given += len(t)
        length = pc.if_else(t["kept"], pc.list_value_length(t["t"]), pa.scalar(None, pa.int32()))
        yield from out(len(t), doc=t["doc"], length=length, id=pa.array(ids))
        kept = t["kept"].to_numpy()
        row, place, code, terms = B.coded(t.filter(t["kept"])["t"])
        word = code >= 0
        row, place, code = row[word], place[word], code[word]
        order, starts = B.runs(code, row)
        at, ends = order[starts], pa.array(np.append(starts, len(order)), pa.int32())
        positions = pa.ListArray.from_arrays(ends, pa.array(place[order], pa.int32()))
        yield from out(len(at), term=terms.take(pa.array(code[at])), id=pa.array(ids[kept][row[at]]), positions=positions)


def _ranks(query: Query):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, found in enumerate(b.column(2).to_pylist()):
                places = {f["term"]: f["positions"] for f in found}
                if not any(occurrences(unit, places) for unit in query.excluded):
                    held = covers(query.groups, places)
                    if held:
                        out.append((k, density(held, query.groups, places), len(held)))
            rows, ranks, n = zip(*out, strict=True) if out else ((), (), ())
            own = b.select(["origin", "id"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(ranks, pa.float64()), pa.array(n, pa.int32())], ["origin", "id", "rank", "covers"])

    return run


def occurrences(unit: list[str], places: dict[str, list[int]]) -> list[int]:
    """First positions of a word, or of words that stand one after another; any word stands for None."""
    starts = places.get(unit[0], [])
    for k, word in enumerate(unit[1:], 1):
        if word is None:
            continue
        at = set(places.get(word, []))
        starts = [s for s in starts if s + k in at]
    return starts


def covers(groups: list[list[list[str]]], places: dict[str, list[int]]) -> list[tuple[int, int]]:
    """The minimal stretches (first and last position) in which a group's words and phrases all stand, in order; none holds another."""
    held: set[tuple[int, int]] = set()
    for group in groups:
        found = [(occurrences(unit, places), len(unit)) for unit in group]
        if not all(starts for starts, _ in found):
            continue
        for first in sorted({s for starts, _ in found for s in starts}):
            at = [bisect_left(starts, first) for starts, _ in found]
            if any(i == len(starts) for i, (starts, _) in zip(at, found, strict=True)):
                break
            held.add((first, max(starts[i] + n - 1 for i, (starts, n) in zip(at, found, strict=True))))
    out: list[tuple[int, int]] = []
    for first, last in sorted(held, key=lambda c: (-c[0], c[1])):
        if not out or last < out[-1][1]:
            out.append((first, last))
    return out[::-1]


def density(held: list[tuple[int, int]], groups: list[list[list[str]]], places: dict[str, list[int]]) -> float:
    words = sorted({p for g in groups for unit in g for w in unit for p in places.get(w, [])})
    inside = lambda a, b: bisect_left(words, b + 1) - bisect_left(words, a)
    return sum(WEIGHT / (1 + (b - a + 1) - inside(a, b)) for a, b in held)


def fragment(text: Column, words: list[str], start: str = ">>>", stop: str = "<<<", most: int = 20) -> Column:
    """The best stretch of `most` words of a text (all, if it has fewer): most different query words, then most of them, then the earliest; query words marked.

    What stands between the words stays; null where the text has no word.
    """
    pattern, wanted = r"[\p{L}\p{N}]+", F.lit([w.lower() for w in words])
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))

    def places(found: Column) -> Column:
        """Places and words of the query's words, in order."""
        lower = F.transform(found, lambda w, i: F.struct(i.alias("at"), F.lower(w).alias("w")))
        return F.filter(lower, lambda p: F.array_contains(wanted, p["w"]))

    def first(hits: Column) -> Column:
        """The best stretch ends with a hit or begins the text; at most `most` hits stand in it, so each hit looks at that many before it."""

        def scored(hit: Column, k: Column) -> Column:
            start = F.greatest(hit["at"] - most + 1, F.lit(0))
            held = F.filter(F.slice(hits, F.greatest(k - most + 2, F.lit(1)), F.least(k + 1, F.lit(most))), lambda p: p["at"] >= start)
            return F.struct(F.size(F.array_distinct(F.transform(held, lambda p: p["w"]))).alias("kinds"), F.size(held).alias("hits"), (-start).alias("at"))

        return F.coalesce(-F.array_max(F.transform(hits, scored))["at"], F.lit(0))

    def cut(t: Column) -> Column:
        def shown(start_at: Column) -> Column:
            chosen, gaps = F.slice(t["found"], start_at + 1, F.lit(most)), F.slice(t["parts"], start_at + 2, F.lit(most))
            marked = F.transform(chosen, lambda w: F.when(F.array_contains(wanted, F.lower(w)), F.concat(F.lit(start), w, F.lit(stop))).otherwise(w))
            pieces = F.zip_with(marked, gaps, lambda w, gap: F.concat(w, gap))
            return bound(marked, lambda m: F.concat(F.array_join(F.slice(pieces, F.lit(1), F.size(m) - 1), ""), F.element_at(m, -1)))

        return F.when(F.size(t["found"]) > 0, bound(bound(places(t["found"]), first), shown))

    # each array is bound once: within a lambda an expression over the text would be computed anew for every element
    return bound(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("parts")), cut)


def documents_of(index: TextIndex) -> DataFrame:
    """One row a live term: documents that hold it and its occurrences."""
    return index._live_postings().groupBy("term").agg(F.count("*").alias("docs"), F.sum(F.size("positions")).alias("occurrences"))
