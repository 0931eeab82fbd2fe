"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset and all runs on one machine (tests), a temporary folder is set first."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="corpusmill-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df written as a table in the shared folder and read back: it cuts lineage and outlives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; lower() is the same, and faster, where a text is all ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def hash_pair(value: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes; equal pairs are taken for equal values."""
    return F.xxhash64(value), F.xxhash64(F.lit(7), value)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Entries of an array that a fold appends to; full ones are set aside, so that a fold over many items takes no quadratic time.
FOLD_BLOCK = 256


def collected(items: Column, state: dict[str, Column], step, kind: str) -> Column:
    """What step puts out for each of the items, run one after another: step(state, item) gives the next state and a value of type kind."""
    zero = F.struct(*[v.alias(k) for k, v in state.items()], F.array().cast(f"array<{kind}>").alias("block"), F.array().cast(f"array<array<{kind}>>").alias("blocks"))

    def run(acc: Column, x: Column) -> Column:
        after, out = step(acc, x)
        full = F.size(acc["block"]) >= FOLD_BLOCK
        block = F.when(full, F.array(out)).otherwise(F.array_append(acc["block"], out))
        blocks = F.when(full, F.array_append(acc["blocks"], acc["block"])).otherwise(acc["blocks"])
        return F.struct(*[after[k].alias(k) for k in state], block.alias("block"), blocks.alias("blocks"))

    return F.aggregate(items, zero, run, lambda acc: F.flatten(F.array_append(acc["blocks"], acc["block"])))


PLACE = "array<struct<start:int,stop:int,text:string>>"


def places(text: Column, pattern: Column | str) -> Column:
    """All matches of a pattern that matches no empty string, leftmost first, as PLACE in code points.

    Spark has no function for the positions of matches; the lengths of the pieces
    between them give these.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    pairs = F.zip_with(found, gaps, lambda m, gap: F.struct(F.length(gap).alias("gap"), m.alias("m")))

    def step(acc: Column, x: Column):
        start = acc["at"] + x["gap"]
        stop = start + F.length(x["m"])
        return {"at": stop}, F.struct(start.alias("start"), stop.alias("stop"), x["m"].alias("text"))

    return collected(pairs, {"at": F.lit(0)}, step, PLACE[6:-1])


def outermost(spans: Column, kind: str, rank) -> Column:
    """The spans (structs of type kind with start and stop) that lie within no span of lower rank(span).

    A span that holds another comes before it by start and falling stop, so one run along this order, which
    remembers the spans still open, is enough.
    """
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["stop"]).alias("back"), rank(x).alias("rank"), x.alias("x"))))

    def step(acc: Column, s: Column):
        x = s["x"]
        open_ = F.filter(acc["open"], lambda o: o["stop"] > x["start"])
        held = F.exists(open_, lambda o: (o["stop"] >= x["stop"]) & (rank(o) < s["rank"]))
        return {"open": F.array_append(open_, x)}, F.struct(held.alias("held"), x.alias("x"))

    judged = collected(ordered, {"open": F.array().cast(f"array<{kind}>")}, step, f"struct<held:boolean,x:{kind}>")
    return F.transform(F.filter(judged, lambda j: ~j["held"]), lambda j: j["x"])


def no_places() -> Column:
    return F.array().cast(PLACE)


#: Rows and bytes of a batch that Spark hands to Python, where the session sets none; texts are long, and the default of 10,000 rows takes much memory on both sides.
ARROW_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def _give_back() -> None:
    """Freed memory goes back to the system: an idle worker stays beside the executor, which later stages need."""
    import contextlib
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, f, schema) -> DataFrame:
    """df.mapInArrow(f, schema); the worker gives freed memory back at the end.

    Plans read the limits of a batch when they run, so a session that has none of its own gets ARROW_LIMITS for good.
    """

    def run(batches):
        try:
            yield from f(batches)
        finally:
            _give_back()

    conf = df.sparkSession.conf
    for key, limit in ARROW_LIMITS.items():
        if key not in conf.getAll:
            conf.set(key, limit)
    return df.mapInArrow(run, schema)
