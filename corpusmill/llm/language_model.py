"""Language-model scoring: a gated recurrent network with a class-factored output, and corpus counts.

A token's probability factors into that of its class, given all tokens before it, and its own within the
class. Both come from the state of a gated recurrent unit: a softmax over classes, and within the class a softmax over its
LEAD most frequent words and the rest of the class, whose logits start from the corpus counts. A word of the rest has its share
of the rest's counts, which cover the whole training part. The network is trained by truncated
backpropagation in numpy; its state is carried from window to window through the whole document, in training and in
scoring.

Counts are complete and never leave the executors, but for the frequent words: at most FREQUENT of
them, which every worker holds. The rest of a document's words meet their counts in a join. For training, every
training document travels as two bytes a token to a shard that its content chooses; a shard trains on all of its
documents, block by block, in an order that their content gives, from common first weights, and the weights are
averaged. So what is learned from grows with the corpus, what is gathered is one set of weights a shard, and scores do not depend
on how the input is cut into tasks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import spans_of, texts_of
from .common import documents, map_arrow, stored

#: Frequent words at most; classes of them; classes of rare words (by UTF-8 length); hidden units; words of a class with logits of their own.
FREQUENT, CLASSES, RARE_CLASSES, HIDDEN, LEAD = 150_000, 31, 16, 16, 24
#: Streams and steps of a window; tokens that a shard repeats its documents for, and passes at most; tokens of a block, and of a shard.
STREAMS, STEPS, LEAST_TOKENS, MOST_PASSES, BLOCK_TOKENS, SHARD_TOKENS = 256, 24, 600_000, 12, 1_000_000, 2_000_000
BATCH_BYTES, SCORE_TOKENS, FLUSH_ROWS, ABREAST, STATES = 4_000_000, 8_000_000, 1_000_000, 1024, 200_000
#: The end token's key; no word has white space.
END = "\n"


def held_out(doc_id) -> bool:
    """Whether crc32 of the id as text is 1 modulo 5; a null id counts as the text 'null'."""
    return zlib.crc32(str("null" if doc_id is None else doc_id).encode()) % 5 == 1


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased (A-Z) words of the texts, and the index of each word's text."""
    low = pa.array(texts_of(texts), pa.large_binary()).view(pa.large_string())  # ascii_lower goes wrong on slices
    lists = pc.ascii_split_whitespace(low)
    of = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    words = lists.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    return words.filter(real), of[real.to_numpy(zero_copy_only=False)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: list[pa.Array] = []
    counts: list[np.ndarray] = []

    def merged() -> pa.RecordBatch:
        coded = pa.concat_arrays(words).dictionary_encode()
        n = np.bincount(coded.indices.to_numpy(), np.concatenate(counts), len(coded.dictionary)).astype(np.int64)
        return pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(n)], names=["word", "n"])

    for batch in batches:
        train = pa.array([not held_out(i) for i in batch.column(0).to_pylist()], pa.bool_())
        texts = batch.column(1).filter(train)
        if not len(texts):
            continue
        words.append(pa.array([END], pa.large_string()))
        counts.append(np.array([len(texts)]))
        for lo, hi in spans_of(texts, BATCH_BYTES):
            coded = _tokens(texts.slice(lo, hi - lo))[0].dictionary_encode()
            words.append(coded.dictionary)
            counts.append(np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)))
        if sum(map(len, words)) > FLUSH_ROWS:
            yield merged()
            words, counts = [], []
    if words:
        yield merged()


class Vocabulary:
    """Frequent words with their codes, log10 shares in the rest of their class and in the corpus; the prior logits within classes; totals of rare classes.

    Classes: 0 is the end; then CLASSES of frequent words, alike in their endings and of like mass; then rare ones by length.
    A code is class * CODES + place among the class's leading words, or LEAD for the rest.
    """

    def __init__(self, words: list[str], counts: list[int], rare: dict[int, float], total: int, distinct: int, lead: int = LEAD):
        order = sorted(range(len(words)), key=lambda i: words[i].encode()[::-1])
        self.words = pa.array([words[i] for i in order], pa.large_string())
        c = np.array([counts[i] for i in order], float)
        mass = np.cumsum(c)
        ends = np.array([words[i] == END for i in order], bool)
        bins = 1 + np.minimum(CLASSES - 1, (mass - c) * CLASSES // max(1.0, mass[-1] if len(c) else 1.0)).astype(int)
        cls = np.where(ends, 0, bins)
        place = np.full(len(c), LEAD)
        by = np.lexsort((np.arange(len(c)), -c, cls))
        first = np.searchsorted(cls[by], np.arange(CLASSES + 1))
        rank = np.arange(len(c)) - first[cls[by]] if len(c) else np.empty(0, int)
        place[by[rank < lead]] = rank[rank < lead]
        self.code = (cls * CODES + place).astype(np.uint16)
        self.floor = total + 0.5 * (distinct + 1)
        self.base = np.log10((c + 0.5) / self.floor)
        sums = np.bincount(self.code, c + 0.5, minlength=SYMBOLS * CODES)
        rest = place == LEAD
        self.within = np.where(rest, np.log10((c + 0.5) / np.where(rest, sums[self.code], 1)), 0.0)
        self.rare = np.array([rare.get(k, 0.0) + 0.5 for k in range(RARE_CLASSES + 1)])
        shares = sums.reshape(SYMBOLS, CODES)
        shares[CLASSES + 1 :, LEAD] = self.rare[1:]  # a rare class is all rest
        mass = shares.sum(axis=1, keepdims=True)
        self.class_prior = np.log((mass[:, 0] + 0.5) / (mass + 0.5).sum()).astype(np.float32)
        self.prior = np.log(np.maximum(shares / np.maximum(mass, 1e-9), 1e-9)).astype(np.float32)
        self.end = int(np.flatnonzero(ends)[0]) if ends.any() else -1
        self.total = total

    def codes(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(index of each word among the frequent, or -1; its code)."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False)
        length = np.minimum(pc.binary_length(words).to_numpy(zero_copy_only=False), RARE_CLASSES)
        return at, np.where(at >= 0, self.code[at] if len(self.code) else 0, (CLASSES + length) * CODES + LEAD).astype(np.uint16)


SYMBOLS, CODES = 1 + CLASSES + RARE_CLASSES, LEAD + 1
SHAPES = {"U": (HIDDEN, 3 * HIDDEN), "W": (SYMBOLS, 3 * HIDDEN), "V": (HIDDEN, SYMBOLS), "b": (SYMBOLS,), "A": (SYMBOLS, HIDDEN, CODES), "B": (SYMBOLS, CODES)}


def first_weights(class_prior: np.ndarray | None = None, seed: int = 9) -> dict[str, np.ndarray]:
    """Small random weights; the output starts from the classes' shares."""
    r = np.random.default_rng(seed)
    w = {k: (r.normal(0, 0.0 if k in "bAB" else 0.25, s)).astype(np.float32) for k, s in SHAPES.items()}
    if class_prior is not None:
        w["b"] = class_prior.copy()
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def step(w: dict[str, np.ndarray], h: np.ndarray, x: np.ndarray):
    """The state after symbol x, and what backpropagation needs."""
    a, g, n = h @ w["U"], w["W"][x], HIDDEN
    gates = _sigmoid(a[:, : 2 * n] + g[:, : 2 * n])
    new = np.tanh(g[:, 2 * n :] + gates[:, n:] * a[:, 2 * n :])
    return new + gates[:, :n] * (h - new), (gates, new, a[:, 2 * n :])


def _by_class(cls: np.ndarray):
    """(class, places of its tokens) for the classes whose words differ in their logits."""
    order = np.argsort(cls, kind="stable")
    cuts = np.searchsorted(cls[order], np.arange(1, CLASSES + 2))
    for c in range(1, CLASSES + 1):
        if cuts[c - 1] < cuts[c]:
            yield c, order[cuts[c - 1] : cuts[c]]


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(np.minimum(z, 80))
    return p / p.sum(axis=1, keepdims=True)


def window_gradient(w: dict[str, np.ndarray], prior: np.ndarray, h: np.ndarray, x: np.ndarray, y: np.ndarray, sub: np.ndarray, fresh: np.ndarray):
    """(gradient of the mean loss over a window, state after it, mean loss).

    x, y (classes before and at each step), sub (places within the class), fresh: steps by streams; y < 0 counts nothing; fresh resets the state.
    """
    n, (steps, streams) = HIDDEN, x.shape
    kept, states = [], np.empty((steps, streams, n), w["U"].dtype)
    for t in range(steps):
        before = np.where(fresh[t][:, None], np.float32(0), h)
        h, state = step(w, before, x[t])
        states[t] = h
        kept.append((before, state))
    # the softmax of all steps at once, and sums over the steps at the end: only the recurrence goes step by step
    flat_states = states.reshape(-1, n)
    p = _softmax(flat_states @ w["V"] + w["b"])
    flat, flat_sub = y.ravel(), sub.ravel()
    real = np.flatnonzero(flat >= 0)
    count = max(1, len(real))
    loss = -float(np.log(p[real, flat[real]] + 1e-20).sum())
    p[real, flat[real]] -= 1
    p[flat < 0] = 0
    p /= count
    out = p @ w["V"].T
    g = {"A": np.zeros_like(w["A"]), "B": np.zeros_like(w["B"])}
    for c, own in _by_class(flat[real]):
        rows = real[own]
        hs, at = flat_states[rows], (np.arange(len(rows)), flat_sub[rows])
        q = _softmax(prior[c] + hs @ w["A"][c] + w["B"][c])
        loss -= float(np.log(q[at] + 1e-20).sum())
        q[at] -= 1
        q /= count
        g["A"][c], g["B"][c] = hs.T @ q, q.sum(axis=0)
        out[rows] += q @ w["A"][c].T
    out = out.reshape(steps, streams, n)
    back = np.zeros_like(h)
    dgates, dstate = np.empty((2, steps, streams, 3 * n), w["U"].dtype)
    for t in range(steps - 1, -1, -1):
        before, (gates, new, inner) = kept[t]
        dh = out[t] + back
        up, reset = gates[:, :n], gates[:, n:]
        dnew = dh * (1 - up) * (1 - new * new)
        dgates[t, :, :n] = dh * (before - new) * up * (1 - up)
        dgates[t, :, n : 2 * n] = dnew * inner * reset * (1 - reset)
        dgates[t, :, 2 * n :] = dnew
        dstate[t] = dgates[t]
        dstate[t, :, 2 * n :] *= reset
        back = np.where(fresh[t][:, None], np.float32(0), dh * up + dstate[t] @ w["U"].T)
    befores = np.concatenate([k[0] for k in kept])
    seen = np.zeros((steps * streams, SYMBOLS), w["U"].dtype)
    seen[np.arange(steps * streams), x.ravel()] = 1
    g |= {"U": befores.T @ dstate.reshape(-1, 3 * n), "W": seen.T @ dgates.reshape(-1, 3 * n), "V": flat_states.T @ p, "b": p.sum(axis=0)}
    return g, h, loss / count


class Trainer:
    """Weights trained by Adam on windows of STREAMS documents' parts side by side, block by block."""

    def __init__(self, w: dict[str, np.ndarray], prior: np.ndarray, rate: float = 0.005):
        self.w, self.prior = {k: v.copy() for k, v in w.items()}, prior
        self.m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
        self.rate, self.n, self.falls = rate, 0, 0

    def block(self, docs: list[np.ndarray], passes: int = 1) -> None:
        """Passes over code sequences (each ends with class 0). The rate falls to a tenth over the first block and stays there."""
        # one after another, cut into lanes of equal length: a document that a cut divides goes on from a fresh state
        flat = np.concatenate(docs).astype(np.int64)
        streams = max(1, min(STREAMS, len(flat) // (32 * STEPS)))  # some dozens of windows at least
        steps = -(-len(flat) // (streams * STEPS)) * STEPS
        codes = np.full(steps * streams, -CODES, np.int64)
        each = -(-len(flat) // streams)
        lane = np.arange(len(flat)) // each
        codes[lane * steps + np.arange(len(flat)) - lane * each] = flat
        codes = np.ascontiguousarray(codes.reshape(streams, steps).T)
        y, sub = codes // CODES, codes % CODES
        x = np.zeros_like(y)
        x[1:] = np.maximum(y[:-1], 0)
        fresh = x == 0
        self.falls = self.falls or passes * (steps // STEPS)
        for _ in range(passes):
            h = np.zeros((streams, HIDDEN), np.float32)
            for lo in range(0, steps, STEPS):
                window = (z[lo : lo + STEPS] for z in (x, y, sub, fresh))
                g, h, _ = window_gradient(self.w, self.prior, h, *window)
                self.n += 1
                rate = self.rate * (1 - 0.9 * min(1.0, self.n / (self.falls + 1)))
                for k, w in self.w.items():
                    a, b = self.m[k]
                    a += 0.1 * (g[k] - a)
                    b += 0.001 * (g[k] * g[k] - b)
                    w -= rate * (a / (1 - 0.9**self.n)) / (np.sqrt(b / (1 - 0.999**self.n)) + 1e-8)


def sequence_scores(w: dict[str, np.ndarray], prior: np.ndarray, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """log10 probability of each document's code sequence; flat holds the documents one after another.

    Documents of like length advance together, ABREAST at a time (arrays that stay in cache); the state is carried to each one's end.
    The softmaxes of many steps are taken at once.
    """
    order = np.argsort(-size, kind="stable")
    begin = np.cumsum(size) - size
    out = np.zeros(len(size))
    for a in range(0, len(order), ABREAST):
        block = order[a : a + ABREAST]
        at, length, got = begin[block], size[block], np.zeros(len(block))
        h, x = np.zeros((len(block), HIDDEN), np.float32), np.zeros(len(block), np.int64)
        active = np.searchsorted(-length, -np.arange(length[0]), side="left").tolist()
        states, targets, held = [], [], 0
        for t, n in enumerate(active):
            h, _ = step(w, h[:n], x[:n])
            code = flat[at[:n] + t].astype(np.int64)
            x = code // CODES
            states.append(h)
            targets.append(code)
            held += n
            if held >= STATES or t + 1 == len(active):
                _add_scores(w, prior, np.concatenate(states), np.concatenate(targets), np.concatenate([np.arange(len(c)) for c in targets]), got)
                states, targets, held = [], [], 0
        out[block] = got
    return out / math.log(10)


def _add_scores(w: dict[str, np.ndarray], prior: np.ndarray, states: np.ndarray, codes: np.ndarray, doc: np.ndarray, got: np.ndarray) -> None:
    cls, sub = codes // CODES, codes % CODES
    z = states @ w["V"] + w["b"]
    score = z[np.arange(len(z)), cls] - np.log(np.exp(z).sum(axis=1))
    for c, own in _by_class(cls):
        z = prior[c] + states[own] @ w["A"][c] + w["B"][c]
        score[own] += z[np.arange(len(own)), sub[own]] - np.log(np.exp(z).sum(axis=1))
    got += np.bincount(doc, score, minlength=len(got))


def _sequences(v: Vocabulary, texts: pa.Array):
    """Words, the text of each, indices among the frequent, and code sequences with ends: flat, and the size of each."""
    words, of = _tokens(texts)
    at, code = v.codes(words)
    n = np.bincount(of, minlength=len(texts))
    size = n + 1
    flat = np.zeros(int(size.sum()), np.uint16)
    flat[np.arange(len(of)) + of] = code
    return words, of, at, flat, size


def _coder(v: Vocabulary):
    """Of each training document the number of tokens and the codes, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).filter(pa.array([not held_out(i) for i in batch.column(0).to_pylist()], pa.bool_()))
            for lo, hi in spans_of(texts, BATCH_BYTES):
                _, _, _, flat, size = _sequences(v, texts.slice(lo, hi - lo))
                press = zstandard.ZstdCompressor(level=1)
                z = [press.compress(x.tobytes()) for x in np.split(flat, np.cumsum(size)[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(size, pa.int64()), pa.array(z, pa.binary())], names=["tokens", "z"])

    return run


def _trainer(prior: np.ndarray, w: dict[str, np.ndarray]):
    """Weights trained on a shard: all its documents, in an order that only their content gives."""

    def run(table: pa.Table) -> pa.Table:
        trainer, docs, held = Trainer(w, prior), [], 0
        blobs = sorted(table.column("z").to_pylist(), key=lambda b: (zlib.crc32(b), b))
        tokens = sum(table.column("tokens").to_pylist())
        for blob in blobs:
            docs.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint16))
            held += len(docs[-1])
            if held >= BLOCK_TOKENS:
                trainer.block(docs)
                docs, held = [], 0
        if docs:
            trainer.block(docs, min(MOST_PASSES, max(1, -(-LEAST_TOKENS // tokens))))
        flat = np.concatenate([trainer.w[k].ravel() for k in SHAPES])
        return pa.table({"tokens": pa.array([tokens], pa.int64()), "weights": pa.array([flat], pa.list_(pa.float32()))})

    return run


SCORED = "row long, doc_id long, word string, n_tokens long, n_known long, base double, score double"


def _scorer(v: Vocabulary, w: dict[str, np.ndarray]):
    def done(held: list[tuple]) -> pa.RecordBatch:
        row, ids, known, base, score, flat, size = zip(*held, strict=True)
        size, score = np.concatenate(size), np.concatenate(score)
        score += sequence_scores(w, v.prior, np.concatenate(flat), size)
        cols = [pa.concat_arrays(row), pa.concat_arrays(ids), pa.nulls(len(size), pa.string()), pa.array(size), pa.array(np.concatenate(known)), pa.array(np.concatenate(base)), pa.array(score)]
        return pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "word", "n_tokens", "n_known", "base", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # texts are cut in small slices; documents of many slices go through the network together, as two bytes a token
        held: list[tuple] = []
        tokens = 0
        end_base, end_within = (v.base[v.end], v.within[v.end]) if v.end >= 0 else (math.log10(0.5 / v.floor), 0.0)
        for batch in batches:
            for lo, hi in spans_of(batch.column(2), BATCH_BYTES):
                row, ids = (batch.column(i).slice(lo, hi - lo) for i in (0, 1))
                words, of, at, flat, size = _sequences(v, batch.column(2).slice(lo, hi - lo))
                seen, n = at >= 0, len(size)
                mine, text = at[seen], of[seen]
                known = np.bincount(text, minlength=n) + (v.end >= 0)
                held.append((row, ids, known, np.bincount(text, v.base[mine], n) + end_base, np.bincount(text, v.within[mine], n) + end_within, flat, size))
                tokens += len(flat)
                rare = np.flatnonzero(~seen)
                none = [pa.nulls(len(rare), k) for k in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays(
                    [row.take(pa.array(of[rare])), pa.nulls(len(rare), pa.int64()), words.take(pa.array(rare)).cast(pa.string()), *none], names=["row", "doc_id", "word", "n_tokens", "n_known", "base", "score"]
                )
                if tokens > SCORE_TOKENS:
                    yield done(held)
                    held, tokens = [], 0
        if held:
            yield done(held)

    return run


def _rare_class(word):
    return F.least(F.octet_length(word), F.lit(RARE_CLASSES))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are only the end. Rows are scored one by one; rows in any order and partitioning give equal scores; repeated rows train as often as they
    stand there. A null id is in the training part if the text 'null' is. With an empty table the result is empty; without
    training documents all words are unknown. Other columns are dropped.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = stored(map_arrow(own, _count, "word string, n long").groupBy("word").agg(F.sum("n").alias("c")))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the lowest count, 2 at least, that at most `frequent` words reach
    cut, held = 1 << 62, 0
    levels = counts.groupBy((F.floor(F.log2("c") * 8)).alias("level")).agg(F.count("*").alias("words"), F.min("c").alias("c")).collect()  # 8 levels a doubling
    for r in sorted(levels, key=lambda r: -r["level"]):
        held += r["words"]
        if held > frequent or r["c"] < 2:  # words seen once stand for those never seen
            break
        cut = r["c"]
    common = F.col("c") >= cut
    top = counts.where(common).orderBy("word").collect()  # at most `frequent` words
    if not any(r["word"] == END for r in top):
        top += counts.where(F.col("word") == END).collect()
    is_rare = ~common & (F.col("word") != END)
    rare = {r["k"]: r["mass"] for r in counts.where(is_rare).groupBy(_rare_class(F.col("word")).alias("k")).agg(F.sum(F.col("c") + 0.5).alias("mass")).collect()}  # RARE_CLASSES rows
    v = Vocabulary([r["word"] for r in top], [r["c"] for r in top], rare, total, distinct)

    w = first_weights(v.class_prior)
    shards = max(1, -(-total // SHARD_TOKENS))
    coded = map_arrow(own, _coder(v), "tokens long, z binary").withColumn("shard", F.pmod(F.xxhash64("z"), F.lit(shards)))
    got = coded.groupBy("shard").applyInArrow(_trainer(v.prior, w), "tokens long, weights array<float>")
    # averaged where they are: one row for each place in the weights
    mean = got.select("tokens", F.posexplode("weights").alias("at", "x")).groupBy("at").agg((F.sum(F.col("x") * F.col("tokens")) / F.sum("tokens")).alias("x")).orderBy("at").collect()
    if mean:
        flat, lo = np.array([r["x"] for r in mean], np.float32), 0
        for k, s in SHAPES.items():
            w[k] = flat[lo : lo + math.prod(s)].reshape(s)
            lo += math.prod(s)

    rows = own.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    scored = stored(map_arrow(rows, _scorer(v, w), SCORED))
    c = F.coalesce("c", F.lit(0))
    masses = F.lit([float(x) for x in v.rare])
    others = scored.where("word is not null").select("row", "word").join(counts.where(is_rare), "word", "left").groupBy("row").agg(
        F.sum((c > 0).cast("long")).alias("rare_known"),
        F.sum(F.log10((c + 0.5) / F.lit(v.floor))).alias("rare_base"),
        F.sum(F.log10((c + 0.5) / F.get(masses, _rare_class(F.col("word"))))).alias("rare_score"),
    )
    out = scored.where("word is null").join(others, "row", "left")
    zero = lambda k: F.coalesce(k, F.lit(0))
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    return out.select(
        "doc_id",
        (crc % 5 == 1).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + zero("rare_known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_base")).alias("base_score"),
        (F.col("score") + zero("rare_score")).alias("score"),
    )


def op7_language_model(spark, sf_dir):
    return score_documents(documents(spark, sf_dir))
