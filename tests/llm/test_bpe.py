"""BPE by segment trees against the tokenizers library, and against plain merging."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from corpusmill.llm import bpe

from .test_operators import REPEATED, awkward, docs, frame, made_up, nothing, texts  # noqa: F401

LONG = {200: "z" * 30_000, 201: "ab" * 700 + "é" * 900, 202: " \n" * 3000 + "x  ", 203: "<|endoftext|>a <|endoftext|><|endoftext|>  b", 204: "\x1c\x1d a\x85b\xa0c  d", 205: "it's I'll they've 'S ''s", 206: "日本語のテキスト 中文 한국어 👩‍👩‍👧 ️"}


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary_path())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def want(library, rows):
    out = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        out.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=str)


def test_query(spark, library, tmp_path):
    rows = made_up() + REPEATED + list(LONG.items())
    frame(spark, rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted((tuple(r) for r in bpe.op13_bpe(spark, str(tmp_path)).collect()), key=str) == want(library, rows)


def test_query_on_the_small_tables(spark, library, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in bpe.op13_bpe(spark, sf).collect()), key=str) == want(library, rows)


def test_nothing(nothing):  # noqa: F811
    assert not bpe.decode(bpe.encode(nothing)).count()


def test_every_character(coder, library):
    r = random.Random(1)
    texts = ["".join(chr(x) + r.choice(("a", " ", "1", "'s", "-", "\n")) for x in range(lo, lo + 64) if not 0xD800 <= x < 0xE000) for lo in range(0, 0x20000, 64)]
    for t, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_spaces(coder, library, seed):
    r = random.Random(seed)
    t = "".join(r.choice((" ", " ", "\n", "\t", "a", "bc", ".", "7", " ")) for _ in range(r.randint(0, 60)))
    assert np.frombuffer(coder.encode([t])[0], np.int32).tolist() == library.encode(t, add_special_tokens=False).ids


def test_slices(coder, library, monkeypatch):
    text = " ".join(t for _, t in made_up() if t)
    ids = library.encode(text, add_special_tokens=False).ids
    for size in (1, 7, 100):
        monkeypatch.setattr(bpe, "SLICE", size)
        assert np.frombuffer(coder.encode([text])[0], np.int32).tolist() == ids


def plain_merges(coder, word):
    """Merging by trying all pairs, the lowest rank first and the leftmost of equals."""
    tokens = [int(coder.first[b]) for b in word]
    while True:
        ranked = [(coder.rank_of[k], i) for i in range(len(tokens) - 1) if (k := tokens[i] << 32 | tokens[i + 1]) in coder.rank_of]
        if not ranked:
            return tokens
        rank, i = min(ranked)
        tokens[i : i + 2] = [int(coder.made[rank])]


@pytest.mark.parametrize("seed", range(5))
def test_trees_merge_the_leftmost_lowest(coder, seed):
    r = random.Random(seed)
    words = [bytes(r.choice(b"aaabetho nisr\xc3\xa9") for _ in range(r.choice((1, 2, 3, 5, 9, 17, 33, 64)))) for _ in range(300)]
    flat, n = coder.in_step(words)
    at = np.append(0, np.cumsum(n))
    for i, w in enumerate(words):
        ids = plain_merges(coder, w)
        assert flat[at[i] : at[i + 1]].tolist() == ids == coder.alone(w).tolist()


def test_decode(spark, library):
    lists = [[0, 220, 5], [50256], [], None, [None, 64, 999_999, -3], [171, 120], [220, 447, 247, 447]]
    got = {r[0]: r[1] for r in bpe.decode(spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>")).select("doc_id", "text").collect()}
    for i, ids in enumerate(lists):
        assert got[i] == library.decode([x for x in ids or [] if x is not None and 0 <= x <= 50256], skip_special_tokens=False)


def test_forgetting_changes_nothing(coder, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    for _, t in made_up():
        assert np.frombuffer(coder.encode([t or ""])[0], np.int32).tolist() == library.encode(t or "", add_special_tokens=False).ids
