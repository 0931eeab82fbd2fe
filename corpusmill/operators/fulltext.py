"""Full-text search: predicates over token arrays, first match per file, postings and BM25, fusion of ranks."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

#: BM25's constants, and that of reciprocal ranks.
K1, B, RRF = 1.2, 0.75, 60


def plain_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


@dataclass
class Query:
    """A web-style query: any of the groups, each with all its terms and phrases and none of the excluded."""

    groups: list[list[list[str]]] = field(default_factory=list)
    excluded: list[list[str]] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str, words_of: Callable[[str], list[str]] = plain_words) -> Query:
        """`words_of` cuts and stems the words as the token arrays were."""
        out, group = cls(), []
        for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
            if word.lower() == "or" and not minus:
                out.groups.append(group)
                group = []
                continue
            words = words_of(phrase or word)
            if words:
                (out.excluded if minus else group).append(words)
        out.groups = [g for g in [*out.groups, group] if g]
        return out

    def matches(self, tokens: Column) -> Column:
        """Whether a token array satisfies the query; a query without terms matches nothing."""
        spaced = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
        holds = lambda words: F.contains(spaced, F.lit(" " + " ".join(words) + " "))
        any_ = F.lit(False)
        for g in self.groups:
            every = F.lit(True)
            for words in g:
                every = every & holds(words)
            any_ = any_ | every
        for words in self.excluded:
            any_ = any_ & ~holds(words)
        return any_


def search_files(chunks: DataFrame, files: DataFrame, query: str, limit: int | None = 20) -> DataFrame:
    """Files with a matching chunk, the first such chunk of each, newest file first."""
    hits = chunks.where(Query.parse(query).matches(X.tokens(F.col("content"))))
    first = Window.partitionBy("file_path").orderBy("chunk_index")
    out = hits.withColumn("rn", F.row_number().over(first)).where("rn = 1").join(files.select("file_path", "file_size", "last_modified"), "file_path")
    out = out.select("file_path", "file_size", "last_modified", "chunk_index", F.left("content", F.lit(200)).alias("preview")).orderBy(F.desc_nulls_last("last_modified"), "file_path")
    return out if limit is None else out.limit(limit)


def headline(text: Column, words: list[str], start: str = ">>>", stop: str = "<<<", around: int = 60) -> Column:
    """The text about the first of the words found, with all of them marked."""
    pattern = r"(?i)\b(" + "|".join(map(re.escape, words)) + r")\b"
    found = F.regexp_extract(text, rf"(?is).{{0,{around}}}" + pattern[4:] + rf".{{0,{around}}}", 0)
    return F.regexp_replace(found, pattern, f"{start}$1{stop}")


def postings(chunks: DataFrame, key: list[str]) -> DataFrame:
    """key, term, tf, length."""
    t = chunks.select(*key, X.tokens(F.col("content")).alias("t")).where(F.size("t") > 0)
    return t.select(*key, F.size("t").alias("length"), F.explode("t").alias("term")).groupBy(*key, "length", "term").agg(F.count("*").alias("tf"))


def bm25(
    chunks: DataFrame, key: list[str], words: list[str], limit: int | None = 10, tokens: Callable[[Column], Column] = X.tokens, words_of: Callable[[str], list[str]] | None = None
) -> DataFrame:
    """key and score; only the words' postings are built, corpus totals come from one aggregate. Stemmed with `tokens` and `words_of` of a kind."""
    terms = list(dict.fromkeys(t for w in words for t in (words_of(w) if words_of else [w.lower()])))
    t = chunks.select(*key, tokens(F.col("content")).alias("t")).where(F.size("t") > 0).select(*key, "t", F.size("t").alias("length"))
    totals = t.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    found = t.where(F.arrays_overlap("t", F.lit(terms))).select(*key, "length", F.explode(F.filter("t", lambda x: x.isin(terms))).alias("term")).groupBy(*key, "length", "term").agg(F.count("*").alias("tf"))
    df = found.groupBy("term").agg(F.count("*").alias("df"))  # a row for each word
    tf, ratio = F.col("tf"), F.col("length") / F.col("mean")
    part = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * ratio))
    out = found.join(F.broadcast(df), "term").crossJoin(F.broadcast(totals)).groupBy(*key).agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), *key)  # totals: one row
    return out if limit is None else out.limit(limit)


def fuse_ranks(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Reciprocal rank fusion of two short ranked lists (key, score), each the result of a top-k."""
    rank = lambda df, name: df.select(*key, F.row_number().over(Window.orderBy(F.desc("score"), *key)).alias(name))
    one = lambda c: F.coalesce(1 / (RRF + F.col(c)), F.lit(0.0))
    return rank(left, "r1").join(rank(right, "r2"), key, "full").select(*key, F.round(one("r1") + one("r2"), 9).alias("score"))


def fuse_weighted(left: DataFrame, right: DataFrame, key: list[str], w1: float = 0.4, w2: float = 0.6) -> DataFrame:
    both = left.withColumnRenamed("score", "s1").join(right.withColumnRenamed("score", "s2"), key, "full")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select(*key, F.round(w1 * zero("s1") + w2 * zero("s2"), 6).alias("score"))
