"""Best-fit packing of token sequences by linear grouping.

Documents become token ids and one end id; longer ones are cut into full pieces and a
rest. How many pieces there are of each length (at most the capacity's number of
lengths) is all that the plan needs, so it is made on the driver in memory and time that
do not grow with the corpus: lengths above a floor are split into groups of equal
cardinality and rounded up to the group's largest; mixtures of the few
rounded sizes are optimised by column generation; actual lengths take the rounded
places; and the smaller lengths go into what is left by best fit. The plan is a
list of runs of equal sequences, each with the ranks of the pieces it takes of each
length. Pieces are ranked within their length, in salted parts, and
look their sequence and offset up by that rank.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrays import spans_of
from .common import documents, map_arrow, stored

#: Chunks (texts between ASCII white space) whose ids a worker remembers, about; half of them are those met last.
REMEMBERED = 600_000
#: Bytes of text that are encoded together.
BATCH_BYTES = 8_000_000
#: Pieces of one length that are ranked together.
ROWS_A_PART = 50_000
_MARKS = b".,!#%&*$|;:?"
#: The tokenizer's letters for bytes: bytes that print stand for themselves, the others for U+0100 and on.
_PRINT = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in set(_PRINT))}
_encoders: dict[str, _Encoder] = {}


class _Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    White space separates tokens in this kind of tokenizer, so a text's ids are those of its
    chunks, one after another, and chunks repeat. Marks at the end of a chunk are cut off
    first, as the tokenizer itself parts them from letters. A text that holds a special
    token's string is encoded as a whole.
    """

    remembered = REMEMBERED

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.encode = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        self.model = self.tok.model
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _has(self, chunk: bytes) -> bool:
        """Whether chunk is known; what was known before the last turn of the memory is taken over."""
        if chunk in self.known:
            return True
        if (ids := self.older.get(chunk)) is None:
            return False
        self.known[chunk] = ids
        return True

    def _ids(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.encode([t.decode() for t in texts], add_special_tokens=False)]

    def _word(self, word: bytes) -> bytes | None:
        """Ids of a word of letters, straight from the model; None where the tokenizer's other steps could change the word."""
        if not word.isalpha():  # beyond ASCII
            w = word.decode()
            if not w.isalpha() or w != w.lower() or not unicodedata.is_normalized("NFC", w):
                return None
            return array("I", [x.id for x in self.model.tokenize(word.decode("latin-1").translate(_BYTE_LETTERS))]).tobytes()
        return array("I", [x.id for x in self.model.tokenize(word.decode())]).tobytes()

    def _learn(self, chunks: list[bytes]) -> None:
        """known gets the ids of all chunks."""
        known, parted, rest = self.known, [], {}
        for c in chunks:
            core = c.rstrip(_MARKS)
            if core and (core[-1:].isalpha() or core[-1] > 127 and core.decode()[-1].isalpha()):
                low, marks = core.lower(), c[len(core) :]
                if low not in rest and not self._has(low):
                    ids = self._word(low)
                    if ids is None:
                        rest[low] = None
                    else:
                        known[low] = ids
                if marks and not self._has(marks):
                    rest[marks] = None
                parted.append((c, low, marks))
            else:
                rest[c] = None
        known.update(zip(rest, self._ids(list(rest)), strict=True))
        known[b""] = b""
        for c, low, marks in parted:
            known[c] = known[low] + known[marks]

    def batch(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text."""
        whole = [i for i, t in enumerate(texts) if "<|" in t]
        chunks = pc.ascii_split_whitespace(pa.array(["" if "<|" in t else t for t in texts], pa.large_string()))
        coded = chunks.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary()).to_pylist()
        if len(self.known) > self.remembered // 2:
            self.older, self.known = self.known, {}
        missing = [w for w in words if not self._has(w)]
        if missing:
            self._learn(missing)
        ids = [self.known[w] for w in words]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool = np.frombuffer(b"".join(ids), "<u4")
        at = np.cumsum(size) - size
        index = coded.indices.to_numpy(zero_copy_only=False)
        each = size[index]
        after = np.cumsum(each)
        flat = pool[np.repeat(at[index] - (after - each), each) + np.arange(after[-1] if len(after) else 0)]
        cuts = np.append(0, after)[chunks.offsets.to_numpy()]
        out = [flat[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for i, b in zip(whole, self._ids([texts[i].encode() for i in whole]), strict=True):
            out[i] = b
        return out


def _encoder(path: str) -> _Encoder:
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


PIECES = "doc_id long, row long, piece int, start long, length int, ids_crc32 long"


def _cut(tokenizer: str | None, capacity: int, end_id: int, remembered: int = REMEMBERED, batch_bytes: int = BATCH_BYTES):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer or tokenizer_path())
        encoder.remembered = remembered
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            ids, texts = batch.column(0).to_pylist(), batch.column(2)
            marks = batch.column(1).to_pylist()
            for lo, hi in spans_of(texts, batch_bytes):
                got = encoder.batch([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])
                for i, b in enumerate(got, lo):
                    b += end
                    for piece, at in enumerate(range(0, len(b), 4 * capacity)):
                        part = b[at : at + 4 * capacity]
                        rows.append((ids[i], marks[i], piece, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    return pieces


# --- the plan -------------------------------------------------------------


def _mixtures(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[tuple[int, ...], float]]:
    """A basis of mixtures (how often each size, largest value for the least number of sequences) and their amounts; column generation."""
    k = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.array(demand, float)
    order = np.argsort(sizes)
    rising = np.array(sizes)[order]
    low = int(rising[0])
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        price = inverse.sum(axis=0)
        # unbounded knapsack over the capacity: the mixture that is worth most at these prices
        worth, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(low, capacity + 1):
            n = np.searchsorted(rising, c, side="right")
            w = worth[c - rising[:n]] + price[order[:n]]
            i = int(w.argmax())
            if w[i] > worth[c - 1] + 1e-12:
                worth[c], last[c] = w[i], order[i]
            else:
                worth[c] = worth[c - 1]
        if worth[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        while c > 0:
            if last[c] < 0:
                c -= 1
            else:
                column[last[c]] += 1
                c -= sizes[last[c]]
        amount, way = inverse @ need, inverse @ column
        ok = way > 1e-9
        ratio = np.full(k, np.inf)
        ratio[ok] = amount[ok] / way[ok]
        basis[:, int(np.argmin(ratio))] = column
    amount = np.linalg.inv(basis) @ need
    return [(tuple(int(x) for x in basis[:, j]), float(amount[j])) for j in range(k)]


class _Stock:
    """How many pieces of each length are left, and the rank of the next."""

    def __init__(self, counts: dict[int, int]):
        self.left = dict(counts)
        self.next = dict.fromkeys(counts, 0)
        self.lengths = sorted(counts)

    def largest(self, most: int) -> int:
        """The largest length left that is at most `most`; 0 if none."""
        i = bisect_left(self.lengths, most + 1)
        return self.lengths[i - 1] if i else 0

    def take(self, length: int, n: int) -> int:
        rank = self.next[length]
        self.next[length] += n
        self.left[length] -= n
        if not self.left[length]:
            self.lengths.remove(length)
        return rank


def plan(counts: dict[int, int], capacity: int, groups: int = 24, floors: tuple[int, ...] = (4, 3, 2)) -> list[list[tuple[int, int, int, int]]]:
    """Runs of equal sequences: for each, its places (length, first rank, sequences, offset).

    counts: pieces by length. Lengths above capacity / floor are grouped; of several floors the
    one that needs the fewest sequences is taken. All pieces of one run's place have
    consecutive ranks within their length.
    """
    plans = [_plan(counts, capacity, groups, floor) for floor in floors]
    return min(plans, key=lambda runs: sum(places[0][2] for places in runs))


def _plan(counts: dict[int, int], capacity: int, groups: int, floor: int) -> list[list[tuple[int, int, int, int]]]:
    stock = _Stock({k: v for k, v in counts.items() if k < capacity and v})
    runs: list[list] = []  # [free, number, [(length, first rank)]]
    if counts.get(capacity):
        runs.append([0, counts[capacity], [(capacity, 0)]])
    large = [k for k in stock.lengths if k > capacity / floor]
    total = sum(stock.left[k] for k in large)
    # groups of equal cardinality, each rounded up to its largest length
    tops: list[int] = []
    reached, members = 0, defaultdict(list)
    for k in reversed(large):
        if not tops or reached >= total * len(tops) / groups:
            tops.append(k)
        members[tops[-1]].append(k)
        reached += stock.left[k]
    open_runs: list[tuple[int, int]] = []  # (free, index in runs), sorted

    def place(parts: list[tuple[int, int]], number: int) -> None:
        free = capacity - sum(k for k, _ in parts)
        runs.append([free, number, parts])
        if free:
            insort(open_runs, (free, len(runs) - 1))

    if tops:
        demand = [sum(stock.left[k] for k in members[t]) for t in tops]
        queues = [list(members[t]) for t in tops]  # longest first
        for mixture, amount in sorted(_mixtures(tops, demand, capacity), key=lambda x: -x[1]):
            number = int(amount + 1e-6)
            number = min([number, *(demand[i] // m for i, m in enumerate(mixture) if m)])
            for i, m in enumerate(mixture):
                demand[i] -= m * number
            slots = [i for i, m in enumerate(mixture) for _ in range(m)]
            while number and slots:  # actual lengths for rounded ones: a run as long as the shortest supply
                want: dict[int, int] = defaultdict(int)
                for i in slots:
                    while not stock.left.get(queues[i][0]):
                        queues[i].pop(0)
                    want[queues[i][0]] += 1
                n = min([number, *(stock.left[k] // w for k, w in want.items())])
                if n == 0:  # fewer left of a length than a sequence has places for it: one sequence, length by length
                    parts = []
                    for i in slots:
                        while not stock.left.get(queues[i][0]):
                            queues[i].pop(0)
                        parts.append((queues[i][0], stock.take(queues[i][0], 1)))
                    place(parts, 1)
                    number -= 1
                    continue
                place([(queues[i][0], stock.take(queues[i][0], n)) for i in slots], n)
                number -= n
    # the rest, longest first: each into the fullest run that has room, else sequences of its own
    for k in sorted(stock.lengths, reverse=True):
        while n := stock.left.get(k, 0):
            i = bisect_left(open_runs, (k, -1))
            if i == len(open_runs):
                each = capacity // k
                number = max(1, n // each)
                parts = [(k, stock.take(k, number)) for _ in range(min(each, n))]
                place(parts, number)
                continue
            free, r = open_runs.pop(i)
            _, number, parts = runs[r]
            each = min(free // k, max(1, n // number))
            if n >= number:
                runs[r] = [free - each * k, number, parts + [(k, stock.take(k, number)) for _ in range(each)]]
                if runs[r][0]:
                    insort(open_runs, (runs[r][0], r))
                continue
            # fewer pieces than sequences: as few sequences as hold them, the others stay a run
            each = min(free // k, n)
            used = n // each
            ranks = [(k, stock.take(k, used)) for _ in range(each)]
            runs[r] = [free, number - used, [(a, b + used) for a, b in parts]]
            insort(open_runs, (free, r))
            runs.append([free - each * k, used, parts + ranks])
            if runs[-1][0]:
                insort(open_runs, (runs[-1][0], len(runs) - 1))
    out = []
    for _, number, parts in runs:
        if not parts or not number:
            continue
        offset, places = 0, []
        for k, rank in parts:
            places.append((k, rank, number, offset))
            offset += k
        out.append(places)
    return out


def pack(
    docs: DataFrame,
    capacity: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 0,
    remembered: int = REMEMBERED,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece that holds only the end id. Repeated rows (same id) are
    packed one by one; null ids pass through. An empty table gives an empty result. Other
    columns are dropped. tokenizer: a file of the tokenizers library (default: word_bpe_49k.json)
    whose tokens never span white space. remembered, batch_bytes: what a worker keeps in memory, for speed only.
    Pieces of one length are alike: which of them lies where is settled by a hash of their row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    pieces = stored(map_arrow(rows, _cut(tokenizer, capacity, end_id, remembered, batch_bytes), PIECES))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    table, sequence = [], 0
    for places in plan(counts, capacity):
        for length, rank, number, offset in places:
            table.append((length, rank, number, sequence, offset))
        sequence += places[0][2]
    # ranks within a length: in parts of hashed rows, so that no length is a single task's
    parts = F.lit([1 + counts.get(k, 0) // ROWS_A_PART for k in range(capacity + 1)])
    salted = pieces.withColumn("part", F.pmod(F.xxhash64("row", "piece"), F.get(parts, F.col("length"))).cast("int"))
    own = Window.partitionBy("length", "part")
    sizes = salted.groupBy("length", "part").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")
    ranked = (
        salted.withColumn("at", F.row_number().over(own.orderBy("row", "piece")) - 1)
        .join(sizes.select("length", "part", before.alias("before")), ["length", "part"])
        .withColumn("rank", F.col("at") + F.col("before"))
    )
    # the run that holds a rank: a sorted array for each length, searched from row to row
    schema = "length int, rank long, number long, sequence long, offset int"
    lookup = spark.createDataFrame(pd.DataFrame(table, columns=["length", "rank", "number", "sequence", "offset"]), schema) if table else spark.createDataFrame([], schema)
    by_length = lookup.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("rank", "sequence", "offset"))).alias("runs"))
    most = max(Counter(row[0] for row in table).values(), default=1)
    run = F.get("runs", _last_at_most(most))
    return ranked.join(F.broadcast(by_length), "length").select(
        "doc_id",
        "piece",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        (run["sequence"] + F.col("rank") - run["rank"]).alias("sequence_id"),
        run["offset"].cast("long").alias("offset"),
    )


def _last_at_most(most: int):
    """Index of the last of the sorted `runs`, at most so many, whose rank is at most the row's: a binary search."""
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(most.bit_length()))])
    return F.aggregate(halves, F.lit(0), lambda at, half: at + F.when(F.get(F.col("runs"), at + half)["rank"] <= F.col("rank"), half).otherwise(0))


def op1_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir))
