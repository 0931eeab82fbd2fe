"""N-gram Jaccard join: exact links between shingle sets, and their components.

Sets of equal content are one class, represented by its smallest id. The elements of every set are put in
one common order, rare ones first: by how often their slot of a hashed table was counted, then by hash. Two sets that
link must then share an element among the first few of each (a prefix), and only sets of like size can link. So
a tile is the classes whose prefix holds one element; within a tile, size bands keep apart what can't
link by size, and each member carries the largest size of a partner that its place in the order still allows.
No link is missed whatever the order is; the counts only keep frequent shingles from making large tiles.

A tile's members are first compared with its smallest and its largest id only.
The links found give components. In tiles that still hold more than one, every member then meets the one of another
component that its bitmap is closest to, round after round while that finds links; a member that the bitmaps leave no
partner in its tile is out. What is left is compared in full with bitmaps four times as wide, in blocks of bounded size, but
only across components; the largest component of a large tile is never compared with itself. Before any sets are compared, hashed bitmaps bound their overlap from above: every
bit that one has and the other lacks stands for an element not shared. What the bound
leaves is decided on the sorted arrays of 64-bit shingle hashes.

Hot groups: of a key that stands more than twice in a slice of texts, only the smallest and largest id go on to the
key's bucket; the slice's other members are compared with these two. A document that very many others are compared
with has its text and bitmap copied to several tasks, each with a bounded share of the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import Words, mix, spans_of, texts_of
from .common import documents, map_arrow, stored
from .components import components

#: Bytes of text hashed together, and dealt out together; members of a block of a large tile; rounds in which each member meets the closest.
BATCH_BYTES, DEAL_BYTES, BLOCK, ROUNDS = 1_500_000, 2_000_000, 1024, 4
#: Bits of a bitmap for each element (rounded up to a power of two), and at most: of the usual bitmaps, and of the wide ones.
BITS, WIDE = (2, 4096), (8, 65536)
#: Bytes of text for each bucket of tiles; rows of ids up to which a table is broadcast; partners of a document compared in one task.
BUCKET_BYTES, BROADCAST_ROWS, PARTNERS = 8_000_000, 500_000, 2000
#: The table of counts has between 2 ** LEAST_SLOTS and 2 ** MOST_SLOTS entries of a byte; a count stands out from LEAST_COUNT and HEAVY times a task's mean on; tasks' counts are added up in ranges of 2 ** RANGE slots.
LEAST_SLOTS, MOST_SLOTS, LEAST_COUNT, HEAVY, RANGE = 18, 23, 3, 4, 16
SKETCH = "id long, th long, n long, s1 long, s2 long, bits array<long>"


def _slot(u: np.ndarray, width: int) -> np.ndarray:
    return (u >> np.uint64(64 - width)).astype(np.int64)


class Order:
    """The common order of elements, and the prefix that a set's links must meet in."""

    def __init__(self, num: int, den: int, weights: np.ndarray | None = None):
        self.num, self.den, self.weights = num, den, weights
        self.width = int(len(weights)).bit_length() - 1 if weights is not None else 0

    def prefix(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(elements of the prefix of a sorted set, for each the largest size of a set that may link and share no earlier one)."""
        n, num, den = len(u), self.num, self.den
        most = n + 1 - -(-num * n // den)
        first = u[:most]
        if self.weights is not None:
            w = self.weights[_slot(u, self.width)]
            if w.any():
                first = u[np.argsort(w, kind="stable")[:most]]
        return first, (n - np.arange(most)) * (num + den) // num - n


class Band:
    """Bands of sizes, a tenth wide; sets that link lie in bands at most `reach` apart."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    @lru_cache(maxsize=None)  # noqa: B019
    def edges(self, most: int) -> np.ndarray:
        out = [1]
        while out[-1] <= most:
            out.append(max(out[-1] + 1, out[-1] * 11 // 10))
        return np.array(out)

    def of(self, n: np.ndarray) -> np.ndarray:
        top = int(n.max(initial=1))
        return np.searchsorted(self.edges(1 << top.bit_length()), n, side="right") - 1


def _bits(u: np.ndarray, each: int, most: int) -> np.ndarray:
    size = min(most, max(64, 1 << int(each * len(u) - 1).bit_length()))
    bits = np.zeros(size, np.uint8)
    bits[(u % np.uint64(size)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    at = np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int32)
    flat = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat))


def _sketch(k: int, width: int):
    """A row a text, of SKETCH; and rows with n = -1, the id of a range, and as bits (slot, count) of the elements in it that stand out in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << width, np.uint32)
        for batch in batches:
            for lo, hi in spans_of(batch.column(2), BATCH_BYTES):
                n, s1, s2, bits = [], [], [], []
                for u in Words(texts_of(batch.column(2).slice(lo, hi - lo))).sets(k):
                    n.append(len(u))
                    s1.append(mix(u).sum(dtype=np.uint64))
                    s2.append(mix(u + np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64))
                    bits.append(_bits(u, *BITS) if len(u) else np.empty(0, np.int64))
                    np.add.at(counts, _slot(u, width), 1)
                sums = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (s1, s2)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in (0, 1)), pa.array(n, pa.int64()), *sums, _lists(bits)], names=["id", "th", "n", "s1", "s2", "bits"])
        heavy = np.flatnonzero(counts >= max(LEAST_COUNT, HEAVY * counts.mean()))
        first, held = _runs(heavy >> RANGE)
        for a, b in zip(first, first + held, strict=True):
            part, none = heavy[a:b], pa.nulls(1, pa.int64())
            bits = _lists([(part & (1 << RANGE) - 1) << 32 | counts[part]])
            yield pa.RecordBatch.from_arrays([pa.array([part[0] >> RANGE], pa.int64()), none, pa.array([-1], pa.int64()), none, none, bits], names=["id", "th", "n", "s1", "s2", "bits"])

    return run


def _wide(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in spans_of(batch.column(1), BATCH_BYTES):
                bits = [_bits(u, *WIDE) for u in Words(texts_of(batch.column(1).slice(lo, hi - lo))).sets(k)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _lists(bits)], names=["rid", "bits"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weights of each range, compressed, of rows ordered by range."""
    now, counts = None, np.zeros(1 << RANGE, np.int64)

    def done() -> pa.RecordBatch:
        weights = np.where(counts > 0, np.minimum(4 * np.log2(np.maximum(counts, 1)), 255), 0).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([_press(weights)], pa.binary())], names=["id", "z"])

    for batch in batches:
        for at, bits in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if now not in (None, at):
                yield done()
                counts[:] = 0
            now, x = at, bits.values.to_numpy()
            counts[x >> 32] += x & 0xFFFFFFFF
    if now is not None:
        yield done()


def _weights(sketch: DataFrame, width: int) -> np.ndarray | None:
    """A byte for each slot: 0, or four times the binary logarithm of its count where it stood out."""
    rows = sketch.where("n = -1").select("id", "bits").repartition("id").sortWithinPartitions("id")
    found = map_arrow(rows, _added, "id long, z binary").collect()  # at most 2 ** (width - RANGE) rows, of 2 ** width bytes in all
    out = np.zeros(1 << width, np.uint8)
    for r in found:
        out[r["id"] << RANGE :][: 1 << RANGE] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["z"]), np.uint8)
    return out if found else None


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of runs of equal keys, and their lengths."""
    first = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.empty(0, np.int64)
    return first, np.diff(np.append(first, len(sorted_keys)))


def _stars(key: np.ndarray, rid: np.ndarray, n: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of entries sorted by key: run lengths, whether each is its tile's smallest or largest id, and these two ids, or -1 with a mask where sizes rule the pair out."""
    first, count = _runs(key)
    run = np.repeat(np.arange(len(first)), count)
    ends = []
    for f in (np.minimum, np.maximum):
        best = f.reduceat(rid, first) if len(first) else rid
        at = np.full(len(first), len(rid))
        np.minimum.at(at, run, np.where(rid == best[run], np.arange(len(rid)), len(rid)))
        ends.append(at[run])
    pivots = [(rid[e], (n <= top[e]) & (n[e] <= top) & (rid != rid[e])) for e in ends]
    place = np.arange(len(rid))
    return np.repeat(count, count), (place == ends[0]) | (place == ends[1]), pivots


def _press(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in arrays))


def _deal(k: int, order: Order, buckets: int):
    """Prefix elements of each text, dealt out to buckets: (bucket, salt, blob); salt 0 meets in the bucket, others are members already compared within the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in spans_of(batch.column(1), DEAL_BYTES):
                ids = batch.column(0).slice(lo, hi - lo).to_numpy()
                keys, tops, sizes, text = [], [], [], []
                for i, u in enumerate(Words(texts_of(batch.column(1).slice(lo, hi - lo))).sets(k)):
                    if len(u):
                        first, top = order.prefix(u)
                        keys.append(first)
                        tops.append(top)
                        sizes.append(np.full(len(first), len(u)))
                        text.append(np.full(len(first), i))
                if not keys:
                    continue
                key, top, n, text = (np.concatenate(x) for x in (keys, tops, sizes, text))
                by = np.argsort(key, kind="stable")
                key, top, n, text = key[by], top[by], n[by], text[by]
                rid = ids[text]
                count, end, ((low, with_low), (high, with_high)) = _stars(key, rid, n, top)
                bucket, low32 = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype("<u4")
                inner = (count > 2) & ~end
                out = []
                if inner.any():
                    whole = (bucket[inner] << 32) | low32[inner]
                    cols = (whole, rid[inner], n[inner], top[inner], low[inner], high[inner], with_low[inner], with_high[inner])
                    salt = 1 + int(mix(rid[:1].view(np.uint64))[0] >> np.uint64(2))
                    out.append((0, salt, np.array([inner.sum()], "<i8").tobytes() + _press(*(c.astype("<i8") for c in cols))))
                rest = np.flatnonzero(~inner)
                rest = rest[np.lexsort((text[rest], bucket[rest]))]
                cuts, _ = _runs(bucket[rest])
                for a, b in zip(cuts, [*cuts[1:], len(rest)], strict=True):
                    own = rest[a:b]
                    heads, held = _runs(text[own])
                    head = _press(rid[own[heads]].astype("<i8"), n[own[heads]].astype("<u4"), held.astype("<u4"))
                    share = np.minimum(-(-top[own] * 1024 // n[own]), 65535).astype("<u2")  # rounded up: it stays a bound
                    out.append((int(bucket[own[0]]), 0, np.array([len(heads), len(head)], "<i8").tobytes() + head + low32[own].tobytes() + share.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "salt", "blob"])

    return run


MEMBERS = "key long, rid long, n long, top long, lo long, hi long"


def _meet(table: pa.Table) -> pa.Table:
    """The members of a bucket's tiles of two ids or more, each with the tile's smallest and largest id where sizes let it link with them."""
    blobs = table.column("blob").to_pylist()
    names = MEMBERS.replace(" long", "").split(", ")
    if table.column("salt")[0].as_py():
        cols = [np.frombuffer(zstandard.ZstdDecompressor().decompress(b[8:]), "<i8").reshape(8, -1) for b in blobs]
        key, rid, n, top, low, high, with_low, with_high = np.concatenate(cols, axis=1)
        return pa.table([*map(pa.array, (key, rid, n, top)), pa.array(low, mask=with_low == 0), pa.array(high, mask=with_high == 0)], names=names)
    keys, rids, sizes, tops = [], [], [], []
    for blob in blobs:
        runs, size = np.frombuffer(blob[:16], "<i8").tolist()
        head = zstandard.ZstdDecompressor().decompress(blob[16 : 16 + size])
        held = np.frombuffer(head[12 * runs :], "<u4")
        n = np.repeat(np.frombuffer(head[8 * runs : 12 * runs], "<u4").astype(np.int64), held)
        rids.append(np.repeat(np.frombuffer(head[: 8 * runs], "<i8"), held))
        keys.append(np.frombuffer(blob[16 + size : 16 + size + 4 * len(n)], "<u4"))
        share = np.frombuffer(blob[16 + size + 4 * len(n) :], "<u2").astype(np.int64)
        tops.append(np.where(share < 65535, n * share // 1024, 2**40))
        sizes.append(n)
    key, rid, n, top = (np.concatenate(x) for x in (keys, rids, sizes, tops))
    by = np.argsort(key, kind="stable")
    key, rid, n, top = key[by], rid[by], n[by], top[by]
    count, _, ((low, with_low), (high, with_high)) = _stars(key, rid, n, top)
    some = low < high
    whole = key.astype(np.int64) | (np.int64(table.column("bucket")[0].as_py()) << 32)
    cols = [pa.array(x[some]) for x in (whole, rid, n, top)]
    return pa.table([*cols, pa.array(low[some], mask=~with_low[some]), pa.array(high[some], mask=~with_high[some])], names=names)


def _verify(k: int, num: int, den: int):
    """(a, b) of the rows that link with their hub; rows come by (hub, salt), the hub's own texts first (null id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in batches:
            hub, salt, ids = (batch.column(c).to_pylist() for c in ("hub", "salt", "id"))
            found: list[tuple[int, int]] = []
            for lo, hi in spans_of(batch.column("text"), BATCH_BYTES):
                texts = texts_of(batch.column("text").slice(lo, hi - lo))
                order = {t: i for i, t in enumerate(dict.fromkeys(texts))}
                sets = list(Words(list(order)).sets(k))
                for i, t in enumerate(texts, lo):
                    if now != (hub[i], salt[i]):
                        now, own = (hub[i], salt[i]), []
                    y = sets[order[t]]
                    if ids[i] is None:
                        own.append(y)
                        continue
                    for x in own:
                        same = len(np.intersect1d(x, y, assume_unique=True))
                        if same and den * same >= num * (len(x) + len(y) - same):
                            found.append((min(hub[i], ids[i]), max(hub[i], ids[i])))
                            break
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _bounded(num: int, den: int) -> Column:
    """Whether sizes and bitmaps leave it possible that sets a and b link."""

    def folded(bits: Column, other: Column) -> Column:
        half = F.size(other)
        return F.when(F.size(bits) == 2 * half, F.zip_with(F.slice(bits, 1, half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseOR(y))).otherwise(bits)

    def left(n: str, bits: Column, other: Column) -> Column:
        lacks = F.zip_with(bits, other, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))).cast("long"))
        return F.col(n) - F.aggregate(lacks, F.lit(0).cast("long"), lambda s, x: s + x)

    a, b = F.col("a_bits"), F.col("b_bits")
    near = F.greatest(F.size(a), F.size(b)) <= 2 * F.least(F.size(a), F.size(b))
    most = F.when(near, F.least(left("a_n", folded(a, b), folded(b, a)), left("b_n", folded(b, a), folded(a, b)))).otherwise(F.least("a_n", "b_n"))
    return most * (den + num) >= (F.col("a_n") + F.col("b_n")) * num


def _block_pairs(num: int, den: int, closest: bool):
    """(key, a, b): pairs of ids across labels within blocks (rows of equal key and unit) that sizes, places and bitmaps leave possible; or each row's id and its closest.

    Rows come ordered by block and size; all blocks of a batch go side by side, by distance within the block, and the bitmap
    bound is applied to some hundred thousand pairs at a time. In a block marked cross, only pairs of both parts count.
    """
    bands, flush = Band(num, den), 200_000

    def pairs(t: pa.Table) -> pa.RecordBatch:
        key, unit, cross, part, rid, label, n, top = (t.column(c).to_numpy() for c in ("key", "unit", "cross", "part", "rid", "label", "n", "top"))
        bits = t.column("bits").combine_chunks()
        flat, at = bits.flatten().to_numpy().view(np.uint64), bits.offsets.to_numpy().astype(np.int64)
        at = at - at[0]
        width = np.diff(at)
        run = np.cumsum(np.append(True, (key[1:] != key[:-1]) | (unit[1:] != unit[:-1])))
        band = bands.of(n)
        reach = bands.of(-(-n * den // num))  # the last band that a partner may lie in
        found: set[tuple[int, int, int]] = set()
        best = np.zeros(len(run), np.int64)  # of each row: 31 bits of closeness, 32 of the partner's place

        def settle(a: np.ndarray, b: np.ndarray) -> None:
            most = np.minimum(n[a], n[b])
            for w in np.unique(np.minimum(width[a], width[b])).tolist():
                same = np.flatnonzero(np.minimum(width[a], width[b]) == w)
                for some in np.array_split(same, max(1, len(same) * w // 1_000_000)):
                    p, q = (folded(z[some], w) for z in (a, b))
                    left, right = (np.bitwise_count(u & ~v).sum(axis=1, dtype=np.int64) for u, v in ((p, q), (q, p)))
                    most[some] = np.minimum(n[a[some]] - left, n[b[some]] - right)
            good = most * (den + num) >= (n[a] + n[b]) * num
            a, b, most = a[good], b[good], most[good]
            if closest:
                near = (most * 2**30 // (n[a] + n[b])) << 32
                np.maximum.at(best, a, near | b)
                np.maximum.at(best, b, near | a)
                return
            found.update(zip([0] * len(a), np.minimum(rid[a], rid[b]).tolist(), np.maximum(rid[a], rid[b]).tolist(), strict=True))

        def folded(rows: np.ndarray, w: int) -> np.ndarray:
            out = flat[at[rows][:, None] + np.arange(w)]
            wide = np.flatnonzero(width[rows] > w)
            for j in range(1, int(width[rows].max(initial=w)) // w):
                more = wide[width[rows[wide]] > j * w]
                out[more] |= flat[at[rows[more]][:, None] + j * w + np.arange(w)]
            return out

        first, second, held = [], [], 0
        x = np.arange(len(run))
        for d in range(1, len(run)):
            x = x[x + d < len(run)]
            x = x[(run[x] == run[x + d]) & (band[x + d] <= reach[x])]  # once too far apart, they stay so
            if not len(x):
                break
            y = x + d
            ok = (label[x] != label[y]) & (n[y] <= top[x]) & (n[x] <= top[y]) & (~cross[x] | (part[x] != part[y]))
            first.append(x[ok])
            second.append(y[ok])
            held += int(ok.sum())
            if held > flush:
                settle(np.concatenate(first), np.concatenate(second))
                first, second, held = [], [], 0
        if held:
            settle(np.concatenate(first), np.concatenate(second))
        some = np.flatnonzero(best)
        found.update(zip(key[some].tolist(), rid[some].tolist(), rid[best[some] & 0xFFFFFFFF].tolist(), strict=True))
        cols = zip(*sorted(found), strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["key", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = lambda b, i: (b.column("key")[i].as_py(), b.column("unit")[i].as_py())
        for batch in batches:
            if not batch.num_rows:
                continue
            # the last block may go on in the next batch
            key, unit = (batch.column(c).to_numpy() for c in ("key", "unit"))
            before = np.flatnonzero((key != key[-1]) | (unit != unit[-1]))
            cut = int(before[-1]) + 1 if len(before) else 0
            if held and (cut or last(held[-1], -1) != last(batch, 0)):
                yield pairs(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield pairs(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield pairs(pa.Table.from_batches(held))

    return run


def _small(df: DataFrame) -> DataFrame:
    """df of a few longs a row, broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _side(df: DataFrame, name: str, key: str) -> DataFrame:
    return df.select(*[F.col(c).alias(key if c == "rid" else f"{name}_{c}") for c in df.columns])


def _linked(pairs: DataFrame, known: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (hub, other) that link, as (a, b)."""
    # a hub with many partners is copied to several tasks
    hot = pairs.groupBy("hub").count().where(F.col("count") > PARTNERS).select("hub", F.ceil(F.col("count") / PARTNERS).alias("parts"))
    salted = pairs.join(_small(stored(hot)), "hub", "left").select("hub", "other", F.coalesce(F.pmod(F.xxhash64("other"), F.col("parts")), F.lit(0)).alias("salt"))
    hubs = lambda df: df.select("hub", "salt").distinct()
    likely = salted.join(_side(known, "b", "other"), "other").join(hubs(salted).join(_side(known, "a", "hub"), "hub"), ["hub", "salt"]).where(_bounded(num, den))
    likely = _small(stored(likely.select("hub", "salt", "other").distinct()))
    heads = _small(stored(hubs(likely)))
    rows = likely.join(texts.withColumnRenamed("rid", "other"), "other").select("hub", "salt", F.col("other").alias("id"), "text")
    rows = rows.unionByName(heads.join(texts.withColumnRenamed("rid", "hub"), "hub").select("hub", "salt", F.lit(None).cast("long").alias("id"), "text"))
    rows = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.asc_nulls_first("id"))
    return map_arrow(rows, _verify(k, num, den), "a long, b long")


def _in_mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of tiles that hold more than one component: key, rid, n, top, label, and the tile's size."""
    labelled = members.select("key", "rid", "n", "top").join(_small(labels.withColumnRenamed("node", "rid")), "rid", "left").withColumn("label", F.coalesce("root", "rid")).drop("root")
    labelled = stored(labelled)
    tiles = labelled.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("size")).where("l0 < l1 and size > 2")
    tiles = stored(tiles.select("key", "size"))
    return labelled.join(_small(tiles), "key")


def _across(within: DataFrame, known: DataFrame, num: int, den: int, closest: bool) -> DataFrame:
    """(key, a, b) of _block_pairs for members of mixed tiles; known: rid, bits. Not distinct."""
    large = within.where(F.col("size") > BLOCK)
    # a large tile: its main component in blocks against blocks of the others, and these among themselves
    most = large.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", "count").alias("main"), F.max("count").alias("n_main"))
    blocks = lambda c: F.ceil(c / F.lit(BLOCK))
    large = large.join(most, "key").withColumns({"is_main": F.col("label") == F.col("main"), "of_main": blocks(F.col("n_main")), "of_rest": blocks(F.col("size") - F.col("n_main"))})
    large = large.withColumn("block", F.pmod(F.xxhash64("rid"), F.when(F.col("is_main"), F.col("of_main")).otherwise(F.col("of_rest"))))
    one = lambda unit, cross, part: F.struct(unit.cast("long").alias("unit"), cross.alias("cross"), part.cast("int").alias("part"))
    against = lambda main, rest: 1 + main * F.col("of_rest") + rest
    among = lambda i, j: -1 - (F.least(i, j) * F.col("of_rest") + F.greatest(i, j))
    rest = F.sequence(F.lit(0).cast("long"), F.col("of_rest") - 1)
    of_main = F.transform(rest, lambda j: one(against(F.col("block"), j), F.lit(True), F.lit(0)))
    of_rest = F.concat(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("of_main") - 1), lambda i: one(against(i, F.col("block")), F.lit(True), F.lit(1))),
        F.transform(rest, lambda j: one(among(F.col("block"), j), F.col("block") != j, (F.col("block") > j).cast("int"))),
    )
    shown = ["key", "rid", "label", "n", "top"]
    large = large.select(*shown, F.explode(F.when(F.col("is_main"), of_main).otherwise(of_rest)).alias("u")).select(*shown, "u.*")
    small = within.where(F.col("size") <= BLOCK).select(*shown, F.lit(0).cast("long").alias("unit"), F.lit(False).alias("cross"), F.lit(0).alias("part"))
    if within.where(F.col("size") > BLOCK).limit(1).count():
        small = small.unionByName(large)
    rows = small.join(known.select("rid", "bits"), "rid").repartition("key", "unit").sortWithinPartitions("key", "unit", "n", "rid")
    return map_arrow(rows, _block_pairs(num, den, closest), "key long, a long, b long")


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest id that links reach).

    Texts are A-Z lower-cased and cut into words at ASCII white space; a document's set holds its distinct k-word
    shingles; with fewer words, all of them as one; a text without words (or null) has no set and
    no link. Two documents link when den * intersection >= num * union.

    Rows with one id are one document that links as any of its rows does; each row is returned.
    A null id counts as one document with an id below all others, and is its component's id as null.
    An empty table gives an empty result; other columns are dropped.
    """
    low = F.lit(-(2**63))
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), low).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = min(MOST_SLOTS, max(LEAST_SLOTS, int(size // 64).bit_length()))
    found = stored(map_arrow(own, _sketch(k, width), SKETCH))
    sketch = found.where("n >= 0")
    classes = stored(sketch.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("id").alias("rid")))
    rows = stored(sketch.where("n > 0").drop("bits").join(classes, ["s1", "s2", "n"]).select("id", "th", "rid"))
    # tiles are of representatives: copies are left out, by a broadcast if they are few
    reps = own.join(_small(rows.where("id <> rid").select("id", "th").distinct()), ["id", "th"], "left_anti").select("id", "text")
    order = Order(num, den, _weights(found, width))
    members = stored(map_arrow(reps, _deal(k, order, max(8, -(-size // BUCKET_BYTES))), "bucket int, salt long, blob binary").groupBy("bucket", "salt").applyInArrow(_meet, MEMBERS))

    known = sketch.where("n > 0").select(F.col("id").alias("rid"), "n", "bits")
    texts = own.select(F.col("id").alias("rid"), "text")
    near = members.select("rid", F.explode(F.array("lo", "hi")).alias("hub")).where("hub is not null")
    near = near.groupBy(F.least("rid", "hub").alias("a"), F.greatest("rid", "hub").alias("b")).agg(F.min("hub").alias("hub"))
    near = stored(near)
    as_star = lambda df, hub: df.select(hub.alias("hub"), F.when(hub == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other"))
    # an id with rows in several classes ties these together
    repeated = rows.groupBy("id").agg(F.min("rid").alias("a"), F.max("rid").alias("z")).where("a < z").drop("z")
    tied = rows.join(repeated, "id").where("a < rid").select("a", F.col("rid").alias("b"))
    labels = stored(components(stored(_linked(as_star(near, F.col("hub")), known, texts, k, num, den).union(tied))))
    tested = near.select("a", "b")

    def joined(pairs: DataFrame) -> DataFrame | None:
        """The components that links among the pairs make of the labels; none if there are no links."""
        links = stored(_linked(as_star(pairs, F.col("a")), known, texts, k, num, den))
        return stored(components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))) if links.limit(1).count() else None

    untested = lambda found: stored(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"))
    alive = members
    for _ in range(ROUNDS):
        found = stored(_across(_in_mixed(alive, labels), known, num, den, True))
        alive = stored(alive.join(found.select("key", F.col("a").alias("rid")).distinct(), ["key", "rid"], "left_semi"))
        pairs = untested(found)
        fewer = joined(pairs) if pairs.limit(1).count() else None
        if fewer is None:
            break
        labels, tested = fewer, tested.union(pairs)
    within = stored(_in_mixed(alive, labels))
    wide = map_arrow(texts.join(_small(stored(within.select("rid").distinct())), "rid"), _wide(k), "rid long, bits array<long>")
    pairs = untested(_across(within, wide, num, den, False))
    final = (joined(pairs) if pairs.limit(1).count() else None) or labels

    merged = classes.join(final.withColumnRenamed("node", "rid"), "rid", "left").select("s1", "s2", "n", F.coalesce("root", "rid").alias("component_id"))
    out = sketch.select("id", "n", "s1", "s2").join(merged, ["s1", "s2", "n"], "left")
    back = lambda c: F.when(c != low, c)
    return out.select(back(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), back(F.coalesce("component_id", "id")).alias("component_id"))


def op2_jaccard_join(spark, sf_dir):
    return jaccard_components(documents(spark, sf_dir), k=3, num=90, den=100)
