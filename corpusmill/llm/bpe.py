"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A text is cut into words by the vocabulary's pattern (a batch's distinct new words are
encoded together, then remembered). A word's bytes are its first tokens. The leaves of its
tree hold rank and place of each pair of neighbours, an inner node the least below it, so
the root is the leftmost of the lowest-ranked merges. A merge changes three leaves (the
pair itself, its left neighbour, and the one that goes) and the nodes above them, until the
root holds no mergeable pair. Words up to SHORT bytes go through their trees in step, one
numpy row a word; longer ones, one by one, in flat arrays.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import spans_of
from .common import documents, map_arrow

#: The pattern that byte-level vocabularies of this kind cut words by (fixed).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words of at most so many bytes are encoded in step with others.
SHORT = 64
#: When a worker remembers more words than this, it forgets all: for speed only.
REMEMBERED = 700_000
#: Bytes of text that are encoded together.
BATCH_BYTES = 4_000_000
#: Characters of a text that are cut into words together.
SLICE = 1 << 20
_NONE, _NONE32 = np.int64(1 << 62), np.int32((1 << 31) - 1)
_EDGE = regex.compile(r"\S\s")
_RUN = regex.compile(r"\s (?:\s|\Z)")
_PRINT = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_coders: dict[str, Coder] = {}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: bytes that print stand for themselves, others for U+0100 and on."""
    rest = (b for b in range(256) if b not in set(_PRINT))
    return {chr(b): b for b in _PRINT} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _unassigned() -> re.Pattern:
    """Characters that are letters or digits to regex, but unassigned in the Unicode version of the tokenizers library, which is asked for each in doubt."""
    from tokenizers.pre_tokenizers import ByteLevel

    known = regex.compile(r"[\p{L}\p{N}]")
    doubt = [c for c in map(chr, chain(range(0xD800), range(0xE000, 0x110000))) if unicodedata.category(c) == "Cn" and known.match(c)]
    cuts = ByteLevel(add_prefix_space=False).pre_tokenize_str("".join(f" -{c}" for c in doubt))
    odd = [ord(doubt[a // 3]) for _, (a, b) in cuts if b - a == 3] or [0xFDD0]
    starts = [c for c, before in zip(odd, [-1, *odd], strict=False) if c != before + 1]
    stops = [c for c, after in zip(odd, [*odd[1:], -1], strict=True) if c != after - 1]
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, stops, strict=True)) + "]")


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Coder:
    """Encodes and decodes by a vocabulary file of the tokenizers library (model BPE, byte-level, without normaliser)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _letters()
        if model["type"] != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"{path} holds no byte-level BPE vocabulary")
        ids = model["vocab"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        n = max([*ids.values(), *added.values()]) + 1
        spelled = [b""] * n
        for token, i in ids.items():
            spelled[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in added.items():
            spelled[i] = token.encode()
        self.spelled = [*spelled, b""]
        self.first = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.first[b] = ids[letter]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.rank_of = {int(k): r for r, k in enumerate(keys.tolist())}
        self.words = regex.compile(WORDS)
        self.unassigned = _unassigned()
        self.added = added
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def in_step(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words, one after another, and how many each has; all have 1 to SHORT bytes."""
        n = np.fromiter(map(len, words), np.int32, len(words))
        width = int(n.max())
        leaves = 1 << max(0, (width - 1).bit_length())
        bits, wide, nodes = leaves.bit_length() - 1, width + 1, 2 * leaves
        if len(self.made) >> (30 - bits):
            raise ValueError("too many merges for trees of 32-bit keys")
        inside = np.arange(wide) < n[:, None]
        token = np.zeros(inside.shape, np.int32)
        token[inside] = self.first[np.frombuffer(b"".join(words), np.uint8)]
        tree = np.full((len(words), nodes), _NONE32, np.int32)
        if width > 1:
            key = self._paired(token[:, : width - 1], token[:, 1:width], np.arange(width - 1, dtype=np.int32), bits)
            tree[:, leaves : leaves + width - 1] = np.where(inside[:, 1:width], key, _NONE32)
        low = leaves
        while low > 1:
            tree[:, low // 2 : low] = np.minimum(tree[:, low : 2 * low : 2], tree[:, low + 1 : 2 * low : 2])
            low //= 2
        after = np.tile(np.arange(1, wide + 1, dtype=np.int32), len(words))  # place of the next token; n: none
        before = after - 2
        gone = np.zeros(token.size, bool)
        token, tree = token.reshape(-1), tree.reshape(-1)
        todo = np.flatnonzero(tree[1::nodes] < _NONE32)
        while len(todo):
            own, top = todo * wide, todo * nodes
            least = tree.take(top + 1)
            at = least & ((1 << bits) - 1)
            made = self.made.take(least >> bits)
            here = own + at
            right = after.take(here)
            follow = after.take(own + right)
            has = follow < n.take(todo)
            token[here], after[here] = made, follow
            gone[own + right] = True
            before[own + follow] = at  # where none follows, nothing reads it
            left = before.take(here)
            some = np.flatnonzero(left >= 0)
            tree[top + leaves + right] = _NONE32
            tree[top + leaves + at] = np.where(has, self._paired(made, token.take(own + follow), at, bits), _NONE32)
            left, rest, first = left.take(some), own.take(some), top.take(some)
            tree[first + leaves + left] = self._paired(token.take(rest + left), made.take(some), left, bits)
            node, row = leaves + np.concatenate([at, right, left]), np.concatenate([top, top, first])
            for _ in range(bits):
                below = row + (node & ~1)
                node = node >> 1
                tree[row + node] = np.minimum(tree.take(below), tree.take(below + 1))
            todo = todo[tree.take(top + 1) < _NONE32]
        kept = inside & ~gone.reshape(inside.shape)
        return token.reshape(inside.shape)[kept], kept.sum(1)

    def _paired(self, left, right, at, bits) -> np.ndarray:
        """Rank and place of each pair as one key."""
        key = left.astype(np.int64) << 32 | right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys.take(i) == key, self.ranks.take(i) << bits | at, _NONE32)

    def alone(self, word: bytes) -> np.ndarray:
        """Token ids of one word of any length, in time that grows as n log n."""
        n, none, rank_of, made = len(word), int(_NONE), self.rank_of, self.made.tolist()
        leaves = 1 << max(1, (n - 1).bit_length())
        bits = leaves.bit_length()
        mask = (1 << bits) - 1
        start = self.first[np.frombuffer(word, np.uint8)].astype(np.int64)
        tree_of = np.full(2 * leaves, _NONE, np.int64)
        if n > 1:
            rank = self._paired(start[:-1], start[1:], 0, 0)
            tree_of[leaves : leaves + n - 1] = np.where(rank < _NONE32, rank.astype(np.int64) << bits | np.arange(n - 1), _NONE)
        low = leaves
        while low > 1:
            tree_of[low // 2 : low] = np.minimum(tree_of[low : 2 * low : 2], tree_of[low + 1 : 2 * low : 2])
            low //= 2
        tree, token = array("q", tree_of.tobytes()), array("q", start.tobytes())
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n))

        def put(at: int, value: int) -> None:
            node = leaves + at
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                value = a if a < b else b
                if tree[node] == value:
                    return
                tree[node] = value
                node >>= 1

        def paired(left: int, right: int) -> int:
            rank = rank_of.get(token[left] << 32 | token[right])
            return none if rank is None else rank << bits | left

        while tree[1] < none:
            at = tree[1] & mask
            right = after[at]
            follow = after[right]
            token[at], after[at], token[right] = made[tree[1] >> bits], follow, -1
            put(right, none)
            if follow < n:
                before[follow] = at
            put(at, paired(at, follow) if follow < n else none)
            if before[at] >= 0:
                put(before[at], paired(before[at], at))
        ids = np.frombuffer(token, np.int64)
        return ids[ids >= 0].astype(np.int32)

    def _learn(self, words: list[str]) -> None:
        """Words that are not remembered yet are encoded, those of about one length together."""
        coded = [w.encode("utf-8", "replace") for w in words]
        by: dict[int, list[int]] = {}
        for i, w in enumerate(coded):
            by.setdefault((len(w) - 1).bit_length() if len(w) <= SHORT else -1, []).append(i)
        for size, group in by.items():
            block = max(256, (1 << 20) >> size) if size >= 0 else 1  # rows that go together: a bound on the trees' bytes
            for lo in range(0, len(group), block):
                part = group[lo : lo + block]
                if size < 0:
                    self.known[words[part[0]]] = self.alone(coded[part[0]]).tobytes()
                    continue
                flat, n = self.in_step([coded[i] for i in part])
                ids, ends = flat.tobytes(), (4 * np.cumsum(n)).tolist()
                for i, a, b in zip(part, [0, *ends], ends, strict=False):
                    self.known[words[i]] = ids[a:b]

    def _cut(self, text: str) -> list[str]:
        """The words of a text that may hold unassigned characters; U+0378 stands for them, which is no letter in any version."""
        ends = np.cumsum([0, *map(len, self.words.findall(self.unassigned.sub("\u0378", text)))]).tolist()
        return [text[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _words(self, words: list[str]) -> None:
        """known gets all the words."""
        fresh = [w for w in dict.fromkeys(words) if w not in self.known]
        if fresh:
            self._learn(fresh)

    def _pieces(self, text: str) -> Iterator[str | bytes]:
        """Slices of a text, one after another, and the ids of added tokens, which are found first, wherever they stand.

        Words end before white space that follows another character, so slices do too.
        """
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield from self._slices(text[at : m.start()])
            yield np.array([self.added[m[0]]], np.int32).tobytes()
            at = m.end()
        yield from self._slices(text[at:] if at else text)

    def _slices(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SLICE and (found := _EDGE.search(text, at + SLICE)):
            yield text[at : found.start() + 1]
            at = found.start() + 1
        yield text[at:] if at else text

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Token ids of each piece as bytes of 32-bit integers.

        A piece is parted at its spaces, each part with the space before it, since parts repeat: words never span such a cut, unless the space
        stands within a longer run of white space. Pieces with such a run are cut by the pattern alone.
        """
        if len(self.known) + len(self.parts) > REMEMBERED:
            self.known, self.parts = {}, {}
        plain = [not _RUN.search(p) and (_latin(p) or not self.unassigned.search(p)) for p in pieces]
        split = pc.split_pattern(pa.array([p if ok else "" for p, ok in zip(pieces, plain, strict=True)], pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        index, at = coded.indices.to_numpy().astype(np.int64), split.offsets.to_numpy()
        parts = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        heads = [self.words.findall(parts[index[a]]) if ok else self._cut(p) for p, ok, a in zip(pieces, plain, at[:-1].tolist(), strict=True)]
        fresh = [p for p in parts if p not in self.parts]
        cut = [self.words.findall(" " + p) for p in fresh]
        self._words([*chain.from_iterable(heads), *chain.from_iterable(cut)])
        ids_of = self.known.__getitem__
        for p, c in zip(fresh, cut, strict=True):
            self.parts[p] = ids_of(c[0]) if len(c) == 1 else b"".join(map(ids_of, c))
        index[at[:-1]] = len(parts) + np.arange(len(pieces))
        pool = [*map(self.parts.__getitem__, parts), *(b"".join(map(ids_of, h)) for h in heads)]
        size = np.fromiter(map(len, pool), np.int64, len(pool)) // 4
        n = size[index]
        stop = np.append(0, np.cumsum(n))
        place = np.arange(int(stop[-1])) + np.repeat((np.cumsum(size) - size)[index] - stop[:-1], n)
        ids = np.frombuffer(b"".join(pool), np.int32)[place].tobytes()
        ends = (4 * stop[at]).tolist()
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as bytes of 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        group: list[tuple[int, int, str]] = []
        held = 0

        def flush() -> None:
            nonlocal group, held
            for (i, k, _), ids in zip(group, self._encode([p for _, _, p in group]), strict=True):
                out[i][k] = ids
            group, held = [], 0

        for i, text in enumerate(texts):
            for piece in self._pieces(text):
                if isinstance(piece, str):
                    group.append((i, len(out[i]), piece))
                    held += len(piece)
                    piece = b""
                out[i].append(piece)
                if held > BATCH_BYTES:
                    flush()
        flush()
        return [b"".join(o) for o in out]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The text of each run of ids (they end at ends): the tokens' bytes, invalid UTF-8 replaced; ids outside the vocabulary have none."""
        out, a = [], 0
        for b in ends.tolist():
            known = ids[a:b]
            known = np.where((known >= 0) & (known < len(self.spelled) - 1), known, len(self.spelled) - 1)
            out.append(b"".join(map(self.spelled.__getitem__, known.tolist())).decode("utf-8", "replace"))
            a = b
        return out


def _coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>), one row for each row of docs.

    Null and empty texts have no ids. Repeated rows are encoded one by one, null ids pass through, other columns are
    dropped, an empty table gives an empty result. A text is cut into words a slice of SLICE characters at a time; a single word
    (a run without white space) may be of any length and takes 40 bytes of memory a byte.
    vocabulary: a file of the tokenizers library on every worker (default: byte_bpe_50k.json).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary or vocabulary_path())
        for batch in batches:
            for lo, hi in spans_of(batch.column(1), BATCH_BYTES):
                coded = coder.encode([t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()])
                ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded))) // 4
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(np.frombuffer(b"".join(coded), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), ids], ["doc_id", "ids"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids, text), one row for each row of coded: the text of its ids, special tokens included.

    Null ids in a list, and ids outside the vocabulary, stand for nothing; a null or empty list is an empty text. Token bytes that are no valid UTF-8
    together become U+FFFD. Repeated rows and null doc_ids pass through, other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary or vocabulary_path())
        for batch in batches:
            lists = batch.column(1)
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(coder.decode(ids, np.cumsum(n)), pa.string())], ["doc_id", "ids", "text"])

    return map_arrow(coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")), run, "doc_id long, ids array<int>, text string")


def op13_bpe(spark, sf_dir):
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of all documents."""
    both = decode(encode(documents(spark, sf_dir)))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
