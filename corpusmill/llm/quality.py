"""Quality rules: statistics of whole texts, fixed rules, and an isolation forest on the statistics.

The forest is grown on a bounded sample of rows labelled good; random splits part it,
and a document that such splits isolate after a short path is anomalous. Splits are drawn
from the range of a node's rows widened on both sides, so that values beyond all good
rows are cut off too. The threshold is calibrated on a held-out part of the labelled rows. Statistics,
scores and verdicts are computed row by row over all documents in one pass; nothing but
the labelled sample is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import SPACE, Words, spans_of
from .common import documents, map_arrow

#: Labelled rows that the forest and its threshold are fitted on, at most; trees; rows a tree.
SAMPLE, TREES, ROWS_A_TREE = 6_000, 200, 512
#: Of good held-out rows, the share that the threshold must keep; words added to even out short texts.
KEEP_GOOD, EVEN = 0.998, 20
BATCH_BYTES = 1_500_000
#: Fixed values of the rules.
SYMBOLS, WINDOW, LEAST_WORDS, MOST_REPEATED = b"#*$%&|<>", 8, 20, 30

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_marks", "n_initials")


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_KINDS = {
    "n_symbols": _table(SYMBOLS),
    "n_upper": _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "n_marks": _table(b"!?"),
}
_CHARS = np.array([not SPACE[b] and b & 0xC0 != 0x80 for b in range(256)])


def statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """COUNTS and MORE of each text."""
    w = Words(texts)
    n, at = len(texts), w.text_at
    sums = lambda flags, cuts: np.diff(np.concatenate([[0], np.cumsum(flags)])[cuts])
    out = {"n_words": np.diff(w.at), "word_chars": sums(_CHARS[w.buf], at)}
    out |= {k: sums(t[w.buf], at) for k, t in _KINDS.items()}
    out["n_initials"] = sums(_KINDS["n_upper"][w.buf[w.start]] if len(w.start) else np.empty(0, bool), w.at)

    text_of = np.repeat(np.arange(n), out["n_words"])
    left = w.at[1:][text_of] - np.arange(len(text_of))
    whole = np.flatnonzero(left >= WINDOW)
    keys = w.shingles(WINDOW)[whole] + text_of[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(text_of) + 1, np.int64)
    np.add.at(cover, whole[twice], 1)
    np.add.at(cover, whole[twice] + WINDOW, -1)
    out["n_repeat_words"] = sums(np.cumsum(cover)[:-1] > 0, w.at)

    dups = []
    for t in texts:
        held = [x for x in t.split(b"\n") if x and not x.isspace()]
        dups.append(len(held) - len(set(held)))
    return out | {"n_dup_lines": np.array(dups, np.int64)}


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < LEAST_WORDS) | (100 * s["n_repeat_words"] > MOST_REPEATED * s["n_words"])


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Rates, each as if EVEN usual words stood beside the text's own, so that short texts don't stand out by chance."""
    n, c = s["n_words"] + EVEN, s["word_chars"] + 5 * EVEN
    cols = [c / n, np.minimum(s["n_symbols"] / n, 3), s["n_upper"] / c, np.minimum(s["n_marks"] / n, 3), s["n_initials"] / n]
    return np.stack(cols, axis=1).astype(np.float64)


class Forest:
    """An isolation forest in arrays; score is 2 ** (-mean path / expected path), higher for what is isolated sooner."""

    def __init__(self, x: np.ndarray, trees: int = TREES, rows: int = ROWS_A_TREE, widen: float = 2.0, seed: int = 5):
        r = np.random.default_rng(seed)
        rows = min(rows, len(x))
        depth = max(1, int(np.ceil(np.log2(max(2, rows)))))
        size = 2 ** (depth + 1)
        self.expected = self._average(rows)
        self.feature, self.cut, self.path = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size))
        for t in range(trees):
            self._grow(t, 1, x[r.choice(len(x), rows, replace=False)], 0, depth, widen, r)
        self.depth = depth

    @staticmethod
    def _average(n: int) -> float:
        return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def _grow(self, t: int, node: int, x: np.ndarray, level: int, depth: int, widen: float, r) -> None:
        low, high = (x.min(axis=0), x.max(axis=0)) if len(x) else (np.zeros(1), np.zeros(1))
        usable = np.flatnonzero(high > low)
        if level == depth or len(x) <= 1 or not len(usable):
            self.path[t, node] = level + self._average(len(x))
            return
        f = int(r.choice(usable))
        more = widen * (high[f] - low[f])
        cut = r.uniform(low[f] - more, high[f] + more)
        self.feature[t, node], self.cut[t, node] = f, cut
        self._grow(t, 2 * node, x[x[:, f] <= cut], level + 1, depth, widen, r)
        self._grow(t, 2 * node + 1, x[x[:, f] > cut], level + 1, depth, widen, r)

    def score(self, x: np.ndarray) -> np.ndarray:
        total, row = np.zeros(len(x)), np.arange(len(x))
        for t in range(len(self.path)):
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                f = self.feature[t, node]
                inner = f >= 0
                node = np.where(inner, 2 * node + (x[row, np.maximum(f, 0)] > self.cut[t, node]), node)
            total += self.path[t, node]
        return 2 ** (-(total / len(self.path)) / max(self.expected, 1e-9))


class Model:
    """A forest and its threshold; verdicts on texts."""

    def __init__(self, forest: Forest | None, threshold: float):
        self.forest, self.threshold = forest, threshold

    def judge(self, texts: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Statistics, scores, and whether the text is kept."""
        s = statistics(texts)
        score = self.forest.score(features(s)) if self.forest else np.zeros(len(texts))
        return s, score, ~base_failed(s) & (score <= self.threshold)


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def _statistics_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in spans_of(batch.column(2), BATCH_BYTES):
            s = statistics(_bytes(batch.column(2).slice(lo, hi - lo)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in (0, 1)), *(pa.array(s[k], pa.int64()) for k in COUNTS + MORE)], names=["id", "quality", *COUNTS, *MORE])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """A model from at most `sample` labelled rows (doc_id, quality), those with the smallest hash of the id.

    Half of the good rows grow the forest; the others and all bad rows set the threshold: the one that tells good from bad
    best among those that keep KEEP_GOOD of the good. With fewer than 40 good rows that pass the fixed rules there is no forest, and only these judge.
    """
    chosen = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__quality")).orderBy(F.xxhash64("__id"), "__quality").limit(sample)
    found = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("__id")).select("__id", "__quality", F.col(text_col).alias("text"))
    rows = map_arrow(found, _statistics_of, "id long, quality int, " + ", ".join(f"{k} long" for k in COUNTS + MORE)).orderBy("id", *COUNTS).limit(2 * sample).collect()
    s = {k: np.array([r[k] for r in rows], np.int64) for k in COUNTS + MORE}
    if not rows:
        return Model(None, 1.0)
    good, ids = np.array([r["quality"] for r in rows]) > 0, np.array([r["id"] for r in rows])
    passed, x = ~base_failed(s), features(s)
    even = (ids * 0x9E3779B1 >> 7) % 2 == 0
    if (good & passed & even).sum() < 40 or (good & passed & ~even).sum() < 5:
        return Model(None, 1.0)
    forest = Forest(x[good & passed & even])
    mine, bad = np.sort(forest.score(x[good & passed & ~even])), np.sort(forest.score(x[~good & passed]))
    # rank where good rows stand: the lowest threshold allowed keeps KEEP_GOOD of them
    lowest = mine[min(len(mine) - 1, int(np.ceil(KEEP_GOOD * len(mine))))]
    cuts = np.unique(np.concatenate([[lowest], mine[mine >= lowest], bad[bad >= lowest]]))
    cuts = np.append((cuts[1:] + cuts[:-1]) / 2, cuts[-1])
    told = np.searchsorted(mine, cuts, side="right") / len(mine) - (np.searchsorted(bad, cuts, side="right") / len(bad) if len(bad) else 0)
    return Model(forest, float(cuts[int(np.argmax(told))]))


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, COUNTS, score, base_failed, kept.

    Null and empty texts have no words and fail. Rows are judged one by one: repeated rows give equal results,
    null ids pass through; other columns are dropped; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in spans_of(batch.column(1), BATCH_BYTES):
                s, score, kept = model.judge(_bytes(batch.column(1).slice(lo, hi - lo)))
                cols = [batch.column(0).slice(lo, hi - lo), *(pa.array(s[k], pa.int64()) for k in COUNTS), pa.array(score), pa.array(base_failed(s)), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *COUNTS, "score", "base_failed", "kept"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS) + ", score double, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model keeps, with all their columns; no shuffle."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in spans_of(batch.column(place), BATCH_BYTES):
                part = batch.slice(lo, hi - lo)
                yield part.filter(pa.array(model.judge(_bytes(part.column(place)))[2]))

    return map_arrow(docs, run, docs.schema)


def op6_quality_rules(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return judge(docs, fit(docs, documents(spark, sf_dir, "labels")))
