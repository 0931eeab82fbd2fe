"""Whole batches of texts as flat numpy arrays: words, their hashes, shingles, duplicates within a text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def spans_of(texts: pa.Array, most_bytes: int) -> list[tuple[int, int]]:
    """Slices [lo, hi) of consecutive texts of about most_bytes each; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out, lo, held = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most_bytes:
            out.append((lo, i))
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        out.append((lo, len(sizes)))
    return out


#: ASCII white space: what parts words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_LETTER = np.random.default_rng(20240229).integers(0, 2**64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _reach(n: int) -> None:
    """Powers of the base, and of its inverse modulo 2**64, up to n."""
    global _powers, _inverses
    if len(_powers) <= n:
        size = max(n + 1, 1 << 20)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
        _inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse)]), dtype=np.uint64)


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """P with len(buf) + 1 entries; span_hash() of it hashes any span of buf."""
    _reach(len(buf))
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_LETTER[buf] * _powers[: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, wherever the span lies."""
    return mix((prefix[stop] - prefix[start]) * _inverses[start] + (stop - start).astype(np.uint64))


class Words:
    """The words of several texts: start, stop (in buf), hash; those of text i are from at[i] to at[i + 1]."""

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.text_at = np.append(0, ends)
        gap = SPACE[self.buf]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).view(np.int8)))
        self.start, self.stop = edge[0::2], edge[1::2]
        self.at = np.searchsorted(self.start, self.text_at)
        self.hash = span_hash(prefix_hash(self.buf), self.start, self.stop)

    def shingles(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; where a text has fewer left, the value means nothing."""
        n = len(self.hash)
        out = np.zeros(n, np.uint64)
        if n >= k:
            acc = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                acc += self.hash[j : n - k + 1 + j] * _ODD[j]
            out[: n - k + 1] = mix(acc)
        return out

    def sets(self, k: int):
        """For each text, the sorted distinct hashes of its k-word shingles; with fewer words, of all its words as one."""
        every = self.shingles(k)
        for a, b in zip(self.at[:-1].tolist(), self.at[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(every[a : b - k + 1])
            elif b > a:
                short = np.array([b - a], np.uint64)
                for i in range(a, b):
                    short = mix(short * _ODD[0] + self.hash[i : i + 1])
                yield short
            else:
                yield np.empty(0, np.uint64)


_ODD = np.random.default_rng(7).integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes, A-Z lower-cased; null is empty."""
    return [(t or b"").lower() for t in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]
