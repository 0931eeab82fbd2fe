"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over Hamming blocks, exact verification.

Words are runs of letters and digits, lower-cased; a text's shingles are its k-word runs. A
window that is similar enough to an item shares most of its shingles, so documents are first
joined with the items' shingles. A window is tried wherever it holds enough common places, in
whatever order they stand; a (document, item) pair without one is dropped. Each such window, as
long as the item, gets a 64-bit SimHash. Fingerprints are cut into radius + 1 blocks: two that differ
in at most radius bits agree in some block, so a join on blocks among windows and the items whose gate
they passed finds them all. What lies within the radius is decided by the exact
similarity of the two multisets of shingles.

Blocks of so few bits part little by themselves: it is the gate that keeps a window from meeting all items. A shingle
that very many texts hold is one key only if the items are too many to broadcast; then adaptive execution splits it.

The items are broadcast only if they are few, and so are the documents found; else both are shuffled. Only
DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, stored

#: Rows up to which a table of longs is broadcast, and entries of an array column; beyond, joins shuffle.
BROADCAST_ROWS = 500_000
HITS = "doc_id, item_id, start, n_words, similarity, distance"


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")


def _shingles(hashes: Column, k: int) -> Column:
    """Hashes of runs of k words; of all words as one if there are fewer; none without words."""
    n = F.size(hashes)
    runs = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))
    short = F.array(F.aggregate(hashes, F.lit(k).cast("long"), lambda acc, h: F.xxhash64(acc, h)))
    return F.when(n >= k, runs).when(n > 0, short).otherwise(F.array().cast("array<long>"))


def _simhash(shingles: Column) -> Column:
    """64 bits: each the majority of that bit over the shingles."""
    one = lambda b: F.aggregate(shingles, F.lit(0), lambda s, h: s + F.getbit(h, b).cast("int"))
    bit = lambda b: F.when(one(b) * 2 > F.size(shingles), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(bit(b)))


def _blocks(fingerprint: Column, radius: int) -> Column:
    """The radius + 1 blocks of a fingerprint, as (block, value)."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])


def _tagged(ordered: Column) -> Column:
    """A sorted multiset as a set: each shingle hashed with how many equal ones come before it. ordered must be a column of its own."""
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(24))])  # a binary search for the first equal one
    first = lambda x: F.aggregate(halves, F.lit(0), lambda at, half: at + F.when(F.get(ordered, at + half - 1) < x, half).otherwise(0))
    few = F.transform(ordered, lambda x, i: F.xxhash64(x, i.cast("long") - F.array_position(ordered, x) + 1))
    many = F.transform(ordered, lambda x, i: F.xxhash64(x, (i - first(x)).cast("long")))
    return F.when(F.size(ordered) < 512, few).otherwise(many)


def _starts(common: Column, n: Column, m: Column, need: Column) -> Column:
    """Starts of all windows of m of a document's n shingles (of all, if fewer) that hold `need` of the sorted places `common` or more.

    Such a window holds `need` places in a row, from the i-th on, and starts at or before it; each start is named once, by the first i.
    """
    place = lambda i: F.get(common, i)
    last = F.greatest(n - m, F.lit(0))
    lo = lambda i: F.greatest(F.lit(0), place(i + need - 1) - m + 1, F.coalesce(place(i - 1), F.lit(-1)) + 1)
    hi = lambda i: F.least(place(i), last)
    runs = F.transform(F.sequence(F.lit(0), F.size(common) - need), lambda i: F.when(lo(i) <= hi(i), F.sequence(lo(i), hi(i))).otherwise(F.array().cast("array<int>")))
    return F.flatten(runs)


def find_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, radius: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """HITS: for each document and benchmark item with a window of similarity threshold or more, the best and then first such window.

    Similarity is |intersection| / |union| of the multisets of k-word shingles of item and window, the window being as
    many words as the item (or the whole document, if that is shorter). A text or item of fewer
    than k words is one shingle, so such an item matches only a text of just its words; null and empty ones match nothing. distance is the Hamming distance of the SimHashes.
    Rows of one id with one text give one hit; a null id gives a hit with a null id. Empty tables give an
    empty result. benchmark has item_id and text; other columns of both are ignored.
    """
    share = threshold / (1 + threshold)  # of window's and item's shingles together, that are common at the threshold
    hashes = lambda text: F.transform(_words(text), lambda w: F.xxhash64(w))
    items = (
        benchmark.select("item_id", hashes(F.col("text")).alias("wh"))
        .where(F.size("wh") > 0)
        .select("item_id", F.size("wh").alias("length"), F.array_sort(_shingles(F.col("wh"), k)).alias("ordered"), _shingles(F.col("wh"), k).alias("item_sh"))
        .withColumns({"m": F.size("item_sh"), "item_fp": _simhash(F.col("item_sh")), "item_set": _tagged(F.col("ordered"))})
    )
    items = stored(items)
    index = items.select("item_id", "length", "m", F.explode(F.array_distinct("item_sh")).alias("h"))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    own = own.withColumns({"did": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "th": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})

    # a column that lambdas read must stand in a projection of its own, or it is computed anew for every element;
    # and explode would send a filter through that projection, so it is the outer one that runs
    places = own.select("did", "th", hashes(F.col("text")).alias("wh")).select("did", "th", _shingles(F.col("wh"), k).alias("sh")).select("did", "th", F.size("sh").alias("n_sh"), F.posexplode_outer("sh").alias("pos", "h"))
    found = (
        places.join(_small(index), "h")
        .groupBy("did", "th", "item_id")
        .agg(*[F.first(c).alias(c) for c in ("n_sh", "length", "m")], F.array_sort(F.collect_set("pos")).alias("common"))
        .withColumn("need", F.ceil((F.col("m") + F.least("m", "n_sh")) * share - 1e-9).cast("int"))  # a shorter document is its own window
        .where(F.size("common") >= F.col("need"))
    )
    found = found.select("did", "th", "item_id", "length", _starts(F.col("common"), F.col("n_sh"), F.col("m"), F.col("need")).alias("starts"))
    found = stored(found.where(F.size("starts") > 0))
    few = (found.agg(F.sum(F.size("starts") + 8)).first()[0] or 0) <= 2 * BROADCAST_ROWS
    texts = own.join(F.broadcast(found) if few else found, ["did", "th"]).select("did", "th", "doc_id", "item_id", "length", "starts", hashes(F.col("text")).alias("wh"))
    texts = texts.withColumns({"sh": _shingles(F.col("wh"), k), "n": F.size("wh")})
    clipped = F.array_distinct(F.transform("starts", lambda s: F.greatest(F.lit(0), F.least(s, F.col("n") - F.col("length")))))
    windows = texts.select("did", "th", "doc_id", "item_id", "length", "sh", F.explode(clipped).alias("start"), F.least("length", "n").alias("n_words"))
    windows = windows.select("did", "th", "doc_id", "item_id", "start", "n_words", F.slice("sh", F.col("start") + 1, F.greatest(F.col("n_words") - k + 1, F.lit(1))).alias("sh")).dropDuplicates(["did", "th", "item_id", "start"])
    windows = stored(windows.withColumn("fp", _simhash(F.col("sh"))))

    # the blocks of a window meet those of the items whose gate it passed: what it may be compared with is bounded by the gate
    blocks = items.select("item_id", "item_fp", F.explode(_blocks(F.col("item_fp"), radius)).alias("b"))
    near = (
        windows.select("did", "th", "item_id", "start", "fp", F.explode(_blocks(F.col("fp"), radius)).alias("b"))
        .join(_small(blocks), ["item_id", "b"])
        .withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))))
        .where(F.col("distance") <= radius)
        .select("did", "th", "item_id", "start", "distance")
        .distinct()
    )
    both = near.join(windows.withColumn("ordered", F.array_sort("sh")), ["did", "th", "item_id", "start"]).join(items.select("item_id", "item_sh", "item_set"), "item_id")
    shared = F.size(F.array_intersect(_tagged(F.col("ordered")), F.col("item_set")))
    judged = both.select("did", "th", "doc_id", "item_id", "start", "n_words", "distance", (shared / (F.size("sh") + F.size("item_sh") - shared)).alias("similarity")).where(F.col("similarity") >= threshold)
    best = F.min_by(F.struct("doc_id", "start", "n_words", "similarity", "distance"), F.struct(-F.col("similarity"), "start"))
    return judged.groupBy("did", "th", "item_id").agg(best.alias("best")).select("best.doc_id", "item_id", "best.start", "best.n_words", "best.similarity", "best.distance")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the documents that hold a benchmark item; a null id is compared like any other value."""
    hits = find_leaks(docs, benchmark, id_col=id_col, text_col=text_col, **how).select(F.col("doc_id").alias("__leak")).distinct()
    return docs.join(hits, F.col(id_col).eqNullSafe(F.col("__leak")), "left_anti")


def op4_decontamination(spark, sf_dir):
    return find_leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
