"""Sharding by sampled splitters: shards of near-equal bytes over a range-partitioned key.

The key is (hash of the text, id): equal texts lie side by side, yet a group of
copies as large as a third of the rows still divides by id. A size-weighted sample of
keys gives quantile boundaries; records are range-partitioned by them; ranges that come
out overfull are subdivided. Exact byte and row counts of each range then give every
record its place in one global order, which is cut into shards of equal bytes.

The sample has a bounded expected size (64 keys a range), and only counts of ranges
reach the driver. Texts are never shuffled. Only DataFrame functions run here.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import documents, stored

#: Rows that a range should hold, ranges at least and at most, parts of overfull ranges at most (about), and sampled keys a range.
ROWS_A_RANGE, LEAST_RANGES, MOST_RANGES, MOST_PARTS, KEYS_A_RANGE = 50_000, 64, 8192, 200_000, 64


def _range_of(key, bounds: list[tuple[int, int]]):
    """Index of the range that key (a struct) lies in: how many of the sorted bounds are at most key; a binary search."""
    steps = max(1, len(bounds).bit_length())
    padded = bounds + [(2**63 - 1, 2**63 - 1)] * (2**steps - 1 - len(bounds))
    table = F.from_json(F.lit("[" + ",".join(f'{{"g":{g},"d":{d}}}' for g, d in padded) + "]"), "array<struct<g:bigint,d:bigint>>")
    halves = F.array(*[F.lit(2**i) for i in reversed(range(steps))])
    return F.aggregate(halves, F.lit(0), lambda at, half: at + F.when(F.get(table, at + half - 1) <= key, half).otherwise(0))


def assign_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """One row a document: id, size (UTF-8 bytes of its text plus 1), text_crc32, shard, slot; sizes of shards near equal.

    A shard's bytes differ from the mean by less than the largest record. A group of equal texts lies side by side, unless
    its range is overfull and divided by ids; where a shard ends within it, the rest goes on in the next shard. Null text has
    size 1 and the checksum of no bytes. A null id sorts before all others. Repeated rows
    each get a slot. Shards may be empty if there are fewer records than shards; an
    empty table gives an empty result. Other columns are not returned: join by id.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.struct(F.xxhash64(text).alias("g"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("d")).alias("key"),
        )
    )
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(LEAST_RANGES, min(MOST_RANGES, -(-n // ROWS_A_RANGE)))
    want = ranges * KEYS_A_RANGE
    chance = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(2**40)) / F.lit(2.0**40)
    drawn = sorted((r[0], r[1], max(r[2], total / want)) for r in rows.where(chance < F.col("size") * (want / max(1, total))).select("key.g", "key.d", "size").collect())
    reach = list(accumulate(w for _, _, w in drawn))
    bounds = sorted({drawn[bisect_left(reach, reach[-1] * i / ranges)][:2] for i in range(1, ranges)}) if drawn else []

    ranged = rows.withColumn("range", _range_of(F.col("key"), bounds))
    target, most = max(1, total / ranges), max(ROWS_A_RANGE, n // MOST_PARTS)
    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    # a range overfull by bytes or by rows (tiny texts share a key and weigh little) is subdivided by ids, whatever its keys are
    full = {r["range"]: max(-(-r["bytes"] // int(target + 1)), -(-r["n"] // most)) for r in sums if r["bytes"] > 2 * target or r["n"] > 2 * most}
    parts = F.from_json(F.lit("{" + ",".join(f'"{k}":{v}' for k, v in full.items()) + "}"), T.MapType(T.StringType(), T.IntegerType()))
    ranged = ranged.withColumn("part", F.coalesce(F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.try_element_at(parts, F.col("range").cast("string"))), F.lit(0)).cast("int"))

    counts = sorted((r["range"], r["part"], r["bytes"], r["n"]) for r in ranged.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect())
    before, b0, n0 = [], 0, 0
    for k, p, b, c in counts:
        before.append((k, p, b0, n0))
        b0, n0 = b0 + b, n0 + c
    offsets = spark.createDataFrame(before, "range int, part int, bytes_before long, rows_before long")
    within = Window.partitionBy("range", "part").orderBy("key", "size", "text_crc32")
    placed = ranged.join(F.broadcast(offsets), ["range", "part"]).select(
        "doc_id", "size", "text_crc32",
        (F.col("rows_before") + F.row_number().over(within) - 1).alias("place"),
        (F.col("bytes_before") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"),
    )
    middle = 2 * F.col("start") + F.col("size")
    placed = stored(placed.withColumn("shard", F.least(F.floor(middle * n_shards / (2.0 * max(1, total))), F.lit(n_shards - 1)).cast("int")).drop("start"))
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))  # n_shards rows
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))


def op9_sharding(spark, sf_dir):
    out = assign_shards(documents(spark, sf_dir), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
