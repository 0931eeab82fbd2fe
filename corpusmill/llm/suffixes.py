"""Suffix-array dedup: bytes of strings of a fixed length that also start in a document with a smaller id.

Suffix arrays of the whole corpus would have to be merged shard by shard, all with all. Instead
every string of `length` bytes chooses, by its content alone, anchors within itself: its `gram`-byte
substrings of smallest hash. Equal strings choose equal anchors, so suffixes are sharded by their anchor
and no shard needs another. The steps:

1. Each task hashes its texts, finds the anchors and, for each, a hash of its context (the bytes of all strings that
   could choose it). Of equal contexts it sends on the smallest id's only. Shards get 32 bits of the anchor's hash and all 64 of the context's.
2. A shard settles equal contexts (all but the smallest id's are removed whole), and names
   the contexts that differ though their anchors agree and a smaller id is among them.
3. The texts of these contexts are sorted by suffix: ranks by Larsson-Sadakane refinement in numpy, common
   prefixes by Kasai's method run along all contexts at once. A run of suffixes with common prefixes of `length` is one
   string. Shards larger than a chunk are sorted chunk by chunk, and the chunks' sorted
   strings are merged by binary search.
4. What is removed goes back to the documents, which are cut and hashed.

Texts travel compressed. No list of documents or strings reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import mix, prefix_hash, span_hash, spans_of
from .common import documents, map_arrow, stored

#: Bytes of an anchor; bytes of text hashed together; bytes of text for each shard; bytes of a chunk of contexts.
GRAM, BATCH_BYTES, SHARD_BYTES, CHUNK_BYTES = 24, 2_000_000, 8_000_000, 1_500_000


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every window of width consecutive entries, by doubling."""
    n = 1
    while 2 * n <= width:
        x = op(x[: len(x) - n], x[n:])
        n *= 2
    return op(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def find_anchors(texts: list[bytes], length: int, gram: int):
    """Anchors of all texts: (place in the joined texts, text, start and stop of the context, hash of anchor, hash of context)."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(size)
    begin = end - size
    buf = np.frombuffer(b"".join(texts), np.uint8)
    none = np.empty(0, np.int64)
    if len(buf) < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = prefix_hash(buf)
    width = length - gram + 1
    at = np.arange(len(buf) - gram + 1)
    h = span_hash(prefix, at, at + gram) | np.uint64(1)
    least = _sliding(h, width, np.minimum)
    inside = np.zeros(len(buf) + 1, np.int32)
    np.add.at(inside, begin[size >= length], 1)
    np.add.at(inside, end[size >= length] - length + 1, -1)
    least[np.cumsum(inside)[: len(least)] == 0] = 0
    pad = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), width, np.maximum) == h)
    text = np.searchsorted(end, chosen, side="right")
    lo, hi = np.maximum(begin[text], chosen - (length - gram)), np.minimum(end[text], chosen + length)
    context = span_hash(prefix, lo, hi) + mix((chosen - lo).astype(np.uint64))
    return chosen, text, lo, hi, h[chosen], mix(context)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of integers, most alike together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplaned(raw: bytes, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).ravel()


def _pack(doc: np.ndarray, ids: np.ndarray, tags: np.ndarray, pos: np.ndarray, anchor: np.ndarray, context: np.ndarray) -> bytes:
    """Anchors of one shard, ordered by document."""
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    runs = np.diff(np.append(first, len(doc))).astype("<u4")
    step = np.diff(pos, prepend=0)
    step[first] = pos[first]
    head = ids[doc[first]].astype("<i8").tobytes() + tags[doc[first]].astype("<u4").tobytes() + _planes(runs) + _planes(step.astype("<u4"))
    packed = zstandard.ZstdCompressor(level=1).compress(head)
    return np.array([len(first), len(doc), len(packed)], "<i8").tobytes() + packed + anchor.astype("<u4").tobytes() + context.astype("<u8").tobytes()


def _unpack(blob: bytes):
    runs, n, size = np.frombuffer(blob[:24], "<i8").tolist()
    head = zstandard.ZstdDecompressor().decompress(blob[24 : 24 + size])
    count = _unplaned(head[12 * runs : 16 * runs], runs, "<u4").astype(np.int64)
    step = _unplaned(head[16 * runs :], n, "<u4").astype(np.int64)
    total = np.cumsum(step)
    first = np.cumsum(count) - count
    pos = total - np.repeat(total[first] - step[first], count)
    ids, tags = np.repeat(np.frombuffer(head[: 8 * runs], "<i8"), count), np.repeat(np.frombuffer(head[8 * runs : 12 * runs], "<u4"), count)
    at = 24 + size
    return ids, tags, pos, np.frombuffer(blob[at : at + 4 * n], "<u4"), np.frombuffer(blob[at + 4 * n :], "<u8")


def _first_in_group(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each entry, the least value of its group; entries are ordered by group."""
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    return np.repeat(np.minimum.reduceat(value, start), np.diff(np.append(start, len(group))))


FOUND = "shard int, id long, tag long, pos int, anchor long, blob binary"
_FOUND_NAMES = ["shard", "id", "tag", "pos", "anchor", "blob"]


def _rows(shard=None, ids=None, tags=None, pos=None, anchor=None, blob=None) -> pa.RecordBatch:
    n = max(len(x) for x in (shard, ids, blob) if x is not None)
    given = [(shard, pa.int32()), (ids, pa.int64()), (tags, pa.int64()), (pos, pa.int32()), (anchor, pa.int64()), (blob, pa.binary())]
    return pa.RecordBatch.from_arrays([pa.nulls(n, k) if x is None else pa.array(x, k) for x, k in given], names=_FOUND_NAMES)


def _gather(ids: np.ndarray, tags: np.ndarray, pos: np.ndarray) -> pa.RecordBatch | None:
    """Places that are removed whole: one row a document, its places packed."""
    if not len(ids):
        return None
    order = np.lexsort((pos, tags, ids))
    ids, tags, pos = ids[order], tags[order], pos[order]
    first = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])))
    parts = np.split(pos.astype("<u4"), first[1:])
    return _rows(ids=ids[first], tags=tags[first].astype(np.int64), blob=[p.tobytes() for p in parts])


def _scan(length: int, gram: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in spans_of(batch.column(2), BATCH_BYTES):
                ids, tags = (batch.column(i).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for i in (0, 1))
                texts = _bytes(batch.column(2).slice(lo, hi - lo))
                by_id = np.argsort(ids, kind="stable")
                ids, tags, texts = ids[by_id], tags[by_id], [texts[i] for i in by_id]
                begin = np.cumsum([0, *map(len, texts[:-1])])
                at, text, _, _, anchor, context = find_anchors(texts, length, gram)
                if not len(at):
                    continue
                pos = at - begin[text]
                group = mix(anchor + context * np.uint64(3))
                order = np.argsort(group, kind="stable")
                least = np.empty(len(order), np.int64)
                least[order] = _first_in_group(group[order], ids[text[order]])
                whole = ids[text] > least
                if (rows := _gather(ids[text[whole]], tags[text[whole]], pos[whole])) is not None:
                    yield rows
                kept = np.flatnonzero(~whole)
                shard = (anchor[kept] >> np.uint64(32)).astype(np.int64) % shards
                kept = kept[np.argsort(shard, kind="stable")]
                shard = np.sort(shard)
                first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
                blobs = [_pack(text[p], ids, tags, pos[p], anchor[p] & np.uint64(0xFFFFFFFF), context[p]) for p in np.split(kept, first[1:])]
                yield _rows(shard=shard[first], blob=blobs)

    return run


def _settle(shard_of: int):
    def run(table: pa.Table) -> pa.Table:
        got = [_unpack(b) for b in table.column("blob").to_pylist()]
        ids, tags, pos, anchor, context = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((ids, context, anchor))
        ids, tags, pos, anchor, context = (x[order] for x in (ids, tags, pos, anchor, context))
        pair = np.cumsum(np.append(False, (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])))
        whole = ids > _first_in_group(pair, ids)
        out = [_gather(ids[whole], tags[whole], pos[whole])]
        # of the others: contexts of an anchor that more than one document has
        ids, tags, pos, anchor = (x[~whole] for x in (ids, tags, pos, anchor))
        low, high = _first_in_group(anchor, ids), -_first_in_group(anchor, -ids.astype(np.float64))
        open_ = low < high
        if open_.any():
            shard = (mix(anchor[open_].astype(np.uint64)) % np.uint64(shard_of)).astype(np.int32)
            out.append(_rows(shard=shard, ids=ids[open_], tags=tags[open_].astype(np.int64), pos=pos[open_], anchor=(ids[open_] > low[open_]).astype(np.int64)))
        out = [x for x in out if x is not None]
        return pa.Table.from_batches(out) if out else _rows(ids=np.empty(0, np.int64)).schema.empty_table()

    return run


def suffix_array(buf: np.ndarray) -> np.ndarray:
    """All suffixes of buf in order: by 8 bytes at first, then by doubling, only groups that are not yet single being refined."""
    n = len(buf)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | padded[j : n + j]
    order = np.argsort(key, kind="stable")
    new = np.append(True, key[order][1:] != key[order][:-1])
    rank = np.empty(n, np.int64)  # one more than the first place of the group; beyond the end it is 0
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1] + 1
    places = np.flatnonzero(~(new & np.append(new[1:], True)))
    h = 8
    if len(places):  # NUL bytes pad the first keys: order the suffixes shorter than these by length
        tail = np.arange(max(0, n - 8), n)
        short = np.isin(order[places], tail)
        if short.any():
            items = order[places]
            pair = np.lexsort((np.where(items >= n - 8, n - items, 9), rank[items]))
            items = items[pair]
            order[places] = items
            width, group = np.where(items >= n - 8, n - items, 9), rank[items]
            new[places] = np.append(True, (group[1:] != group[:-1]) | (width[1:] != width[:-1]))
            rank[items] = places[np.flatnonzero(new[places])[np.cumsum(new[places]) - 1]] + 1
            places = places[~(new & np.append(new[1:], True))[places]]
    while len(places):
        items = order[places]
        after = items + h
        pair = (rank[items].astype(np.uint64) << np.uint64(32)) | np.where(after < n, rank[np.minimum(after, n - 1)], 0).astype(np.uint64)
        by = np.argsort(pair, kind="stable")
        items, pair = items[by], pair[by]
        order[places] = items
        fresh = np.append(True, pair[1:] != pair[:-1])
        new[places] = fresh
        rank[items] = places[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] + 1
        places = places[~(fresh & np.append(fresh[1:], True))]
        h *= 2
    return order


def common_prefixes(buf: np.ndarray, order: np.ndarray, begin: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """For each suffix, how many bytes (at most `most`, and within its piece) it shares with the one before it in order.

    Kasai: going on by one byte loses at most one byte of the common prefix; the pieces go side by side.
    """
    n = len(buf)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    end = np.repeat(begin + size, size)
    out = np.zeros(n, np.int64)
    h = np.zeros(len(begin), np.int64)
    by_size = np.argsort(-size, kind="stable")
    for j in range(int(size.max(initial=0))):
        live = by_size[: np.searchsorted(-size[by_size], -j, side="left")]
        at = begin[live] + j
        other = before[at]
        room = np.minimum(np.minimum(end[at] - at, end[other] - other), most)
        room[other < 0] = 0
        got = np.minimum(np.maximum(h[live] - 1, 0), room)
        going = np.flatnonzero(got < room)
        while len(going):
            same = buf[at[going] + got[going]] == buf[other[going] + got[going]]
            going = going[same]
            got[going] += 1
            going = going[got[going] < room[going]]
        out[at] = h[live] = got
    return out


def _strings(contexts: list[bytes], owner: np.ndarray, length: int):
    """The distinct strings of `length` bytes in the contexts, sorted, with their least owner; and of every place in the joined contexts the string there, or -1."""
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    begin = np.cumsum(size) - size
    buf = np.frombuffer(b"".join(contexts), np.uint8)
    order = suffix_array(buf)
    prefix = common_prefixes(buf, order, begin, size, length)
    end = np.repeat(begin + size, size)
    valid = order[end[order] - order >= length]
    # a suffix that is too short may stand between two equal strings: compare along the valid ones by running minima
    short = np.flatnonzero(end[order] - order < length)
    lcp = prefix[order]
    runs = np.ones(len(order), bool)
    runs[short] = False
    group_break = lcp < length
    # a break holds for the next valid suffix unless all that lies between is short and the neighbours are equal
    joined = np.lib.stride_tricks.sliding_window_view(np.concatenate([buf, np.zeros(length, np.uint8)]), length)
    new = group_break[runs].copy()
    if len(valid):
        new[0] = True
        gaps = np.flatnonzero(np.diff(np.flatnonzero(runs)) > 1) + 1
        new[gaps] = (joined[valid[gaps]] != joined[valid[gaps - 1]]).any(axis=1)
    group = np.cumsum(new) - 1
    place_owner = np.repeat(owner, size)
    starts = np.flatnonzero(new)
    least = np.minimum.reduceat(place_owner[valid], starts) if len(valid) else np.empty(0, np.int64)
    text = np.ascontiguousarray(joined[valid[starts]]).view(f"S{length}").ravel() if len(valid) else np.empty(0, f"S{length}")
    of = np.full(len(buf), -1)
    of[valid] = group
    return text, least, of, begin, size


def _sort(length: int, gram: int):
    def run(table: pa.Table) -> pa.Table:
        ids, pos = (table.column(k).to_numpy() for k in ("id", "pos"))
        tags, check = table.column("tag").to_numpy(), table.column("anchor").to_numpy()
        contexts = table.column("blob").to_pylist()
        cuts, held = [0], 0
        for i, c in enumerate(contexts):
            if held and held + len(c) > CHUNK_BYTES:
                cuts.append(i)
                held = 0
            held += len(c)
        cuts.append(len(contexts))
        chunks = [_strings(contexts[a:b], ids[a:b], length) for a, b in zip(cuts, cuts[1:], strict=False)]
        # merge: every chunk's sorted strings are looked up in every other chunk's
        for i, (mine, least, *_) in enumerate(chunks):
            for j, (theirs, other, *_) in enumerate(chunks):
                if i != j and len(theirs) and len(mine):
                    at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
                    same = theirs[at] == mine
                    np.minimum.at(least, np.flatnonzero(same), other[at[same]])
        out = []
        for (a, b), (_, least, of, begin, size) in zip(zip(cuts, cuts[1:], strict=False), chunks, strict=True):
            piece = np.repeat(np.arange(b - a), size)
            gone = np.flatnonzero(of >= 0)
            gone = gone[(least[of[gone]] < ids[a:b][piece[gone]]) & (check[a:b][piece[gone]] > 0)]
            p = piece[gone]
            left = np.minimum(pos[a:b][p], length - gram)
            start = pos[a:b][p] - left + gone - begin[p]
            out.append((ids[a:b][p], tags[a:b][p], start))
        ids, tags, start = (np.concatenate(x) for x in zip(*out, strict=True))
        rows = _gather(ids, tags.astype(np.uint32), start)
        return pa.Table.from_batches([rows]) if rows is not None else _rows(ids=np.empty(0, np.int64)).schema.empty_table()

    return run


def _pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for lo, hi in spans_of(batch.column(2), BATCH_BYTES):
            z = [press.compress(t) for t in _bytes(batch.column(2).slice(lo, hi - lo))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in (0, 1)), pa.array(z, pa.binary())], names=["id", "tag", "z"])


def _fetch(length: int, gram: int):
    """Contexts of the places named in `wanted` (shard, pos, anchor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                text = opened.decompress(batch.column(2)[i].as_py())
                wanted = batch.column(3)[i].values
                shard, pos, anchor = (wanted.field(k) for k in range(3))
                blobs = [text[max(0, p - (length - gram)) : p + length] for p in pos.to_pylist()]
                n = len(blobs)
                yield _rows(shard=shard, ids=np.full(n, batch.column(0)[i].as_py()), tags=np.full(n, batch.column(1)[i].as_py()), pos=pos, anchor=anchor, blob=blobs)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n > 20_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return merged


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _cut(length: int, gram: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            for doc, z, whole, strings in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                text = opened.decompress(z)
                n = len(text)
                kept, removed, spans = text, 0, 0
                if whole or strings:
                    change = np.zeros(n + 1, np.int32)
                    w = np.frombuffer(b"".join(whole or ()), "<u4").astype(np.int64)
                    s = np.frombuffer(b"".join(strings or ()), "<u4").astype(np.int64)
                    np.add.at(change, np.concatenate([np.maximum(0, w - (length - gram)), s]), 1)
                    np.add.at(change, np.minimum(n, np.concatenate([w + length, s + length])), -1)
                    gone = np.cumsum(change[:-1]) > 0
                    removed = int(gone.sum())
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((doc, n, removed, spans, hashlib.sha256(kept).hexdigest().encode() if digest else kept))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 50, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept (its bytes left; with digest, their SHA-256 in hex).

    A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id, judged on the input.
    Null and empty texts have no bytes; texts shorter than `length` stay whole. A null id is below all others. Rows with one id
    are one document, so they don't remove each other's bytes; each row is returned. An empty table gives an empty
    result; other columns are dropped.
    """
    tag = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).bitwiseAND(F.lit(0xFFFFFFFF))
    low = F.lit(-(2**63))
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), low).alias("id"), tag.alias("tag"), F.col(text_col).alias("text"))
    total = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(8, -(-total // SHARD_BYTES))

    scanned = stored(map_arrow(own, _scan(length, gram, shards), FOUND), "lz4")
    settled = stored(scanned.where("shard is not null").groupBy("shard").applyInArrow(_settle(shards), FOUND))
    named = settled.where("pos is not null").groupBy("id", "tag").agg(F.collect_list(F.struct("shard", "pos", "anchor")).alias("wanted"))
    pressed = map_arrow(own, _pressed, "id long, tag long, z binary")
    contexts = map_arrow(pressed.join(named, ["id", "tag"]), _fetch(length, gram), FOUND)
    strings = contexts.groupBy("shard").applyInArrow(_sort(length, gram), FOUND)

    whole = scanned.where("shard is null").select("id", "tag", "blob").union(settled.where("pos is null").select("id", "tag", "blob"))
    marks = whole.withColumn("kind", F.lit(0)).union(strings.select("id", "tag", "blob", F.lit(1).alias("kind")))
    marks = stored(marks)
    of_doc = marks.groupBy("id", "tag").agg(F.collect_list(F.when(F.col("kind") == 0, F.col("blob"))).alias("whole"), F.collect_list(F.when(F.col("kind") == 1, F.col("blob"))).alias("strings"))
    cut = map_arrow(pressed.join(of_doc, ["id", "tag"], "left").select("id", "z", "whole", "strings"), _cut(length, gram, digest), CUT)
    return cut.withColumn("doc_id", F.when(F.col("doc_id") != low, F.col("doc_id")))


def op3_suffix_dedup(spark, sf_dir):
    out = remove_repeats(documents(spark, sf_dir), digest=True)
    return out.withColumn("kept_sha256", F.col("kept").cast("string")).drop("kept")
