"""Rows of one key together in Arrow batches, and counts of words in them: one shuffle of the texts instead of one of their words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

#: Bytes of rows that are worked on at a time, so that a worker's memory does not depend on the length of texts.
SLICE = 4 << 20


def gathered(rows: DataFrame, key: list[str], order: list[str | Column] | None = None) -> DataFrame:
    """rows dealt out by key, those of one key in one task, one after another and in order."""
    return rows.repartition(*key).sortWithinPartitions(*key, *(order or []))


def changes(t: pa.Table, key: list[str]) -> np.ndarray:
    """Whether each row's key differs from that of the row before; nulls are equal."""
    out = np.ones(len(t), bool)
    if len(t) > 1:
        out[1:] = False
        for k in key:
            c = t[k].combine_chunks()
            a, b = c.slice(1), c.slice(0, len(t) - 1)
            same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
            out[1:] |= ~same.to_numpy(zero_copy_only=False)
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for b in batches:
        step = max(1, b.num_rows * SLICE // max(b.nbytes, SLICE))
        for lo in range(0, b.num_rows, step):
            yield pa.Table.from_batches([b.slice(lo, step)])


def whole(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of gathered() rows in which no key is cut, and the number of each row's key in its table."""
    held: list[pa.Table] = []
    for t in _slices(batches):
        last = held[-1].slice(len(held[-1]) - 1) if held else None
        new = changes(t if last is None else pa.concat_tables([last, t]), key)[0 if last is None else 1 :]
        starts = np.flatnonzero(new)
        if not len(starts):
            held.append(t)
            continue
        cut = starts[-1]  # the last key may go on in the next batch
        if held or cut:
            done = pa.concat_tables([*held, t.slice(0, cut)])
            yield done, changes(done, key).cumsum() - 1
        held = [t.slice(cut)]
    if held:
        done = pa.concat_tables(held)
        yield done, changes(done, key).cumsum() - 1


def coded(words: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """All words of lists: the row of each, its place in it, its code, and the words that codes stand for, in order of their bytes. A null word's code is -1."""
    lists = pa.concat_arrays(words.chunks) if words.num_chunks else pa.array([], words.type)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    place = np.arange(len(row)) - np.repeat(sizes.cumsum() - sizes, sizes)
    d = lists.flatten().dictionary_encode()
    order = pc.sort_indices(d.dictionary).to_numpy()
    rank = np.full(len(order) + 1, -1, np.int64)
    rank[order] = np.arange(len(order))
    code = rank[d.indices.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)]
    return row, place, code, d.dictionary.take(pa.array(order))


def runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the columns, the first foremost and equals as they were, and where runs of equals start in it."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for c in columns:
            new[1:] |= c[order[1:]] != c[order[:-1]]
    return order, np.flatnonzero(new)


def lengths(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def leading(group: np.ndarray) -> np.ndarray:
    """Of rows sorted by group, the place of each in its group."""
    return np.arange(len(group)) - np.searchsorted(group, group)
