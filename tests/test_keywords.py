"""Counts of words where the files are: keys that batches cut, rows of one key, TF-IDF without a shuffle of words."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import groups as B
from corpusmill.functions import text as X
from corpusmill.operators import keywords as K


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_no_key_is_cut(size):
    keys = [None, None, "", "a", "a", "a", "a", "a", "b", "c", "c"]
    t = pa.table({"k": keys, "i": range(len(keys))})
    got = [(tuple(d["k"].to_pylist()), of.tolist()) for d, of in B.whole(iter(t.to_batches(size)), ["k"])]
    assert [k for ks, _ in got for k in ks] == keys
    for ks, of in got:
        assert of == (np.cumsum([i > 0 and ks[i] != ks[i - 1] for i in range(len(ks))])).tolist()
    ends = [(a[0][-1], b[0][0]) for a, b in zip(got, got[1:], strict=False)]
    assert all(a != b for a, b in ends)
    assert not list(B.whole(iter([]), ["k"]))


def shuffles(df):
    """What each exchange of the plan deals out by."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_top_terms(spark):
    rows = [("/a", "x", "b a a c"), ("/a", "x", "c a"), ("/b", "y", ""), ("/c", "y", None), ("/d", "x", "z y"), (None, "x", "q"), (None, "y", "q q r")]
    f = spark.createDataFrame(rows, "file_path string, lang string, content string").repartition(3)
    top = K.top_terms(f, X.tokens(F.col("content")), 2)
    assert shuffles(top) == 1
    assert sorted(map(str, [tuple(r) for r in top.collect()])) == sorted(map(str, [("/a", "a", 3, 1), ("/a", "c", 2, 2), ("/d", "z", 1, 1), ("/d", "y", 1, 2), (None, "q", 3, 1), (None, "r", 1, 2)]))
    by_lang = K.top_terms(f, X.tokens(F.col("content")), 1, ("lang",)).where("file_path is null").collect()
    assert [tuple(r) for r in by_lang] == [(None, "y", "q", 2, 1)]


def test_tfidf_by_hand(spark):
    texts = ["red tree red", "tree and blue_1 tree", "", "red blue_1 red blue_1"]
    rows = [("/a", i, t) for i, t in enumerate(texts)] + [("/one", 0, "red tree")]
    df = spark.createDataFrame(rows, "file_path string, chunk_index int, content string").repartition(3)
    tf = []
    for t in texts:
        w = [x for x in t.split() if x != "and"]
        tf.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]))
    all_, held = Counter(), Counter()
    for c in tf:
        all_.update(c)
        held.update(c.keys())
    stay = sorted(all_, key=lambda k: (-all_[k], k))[:5]
    score = Counter()
    for c in tf:
        x = {k: c[k] * (math.log(5 / (1 + held[k])) + 1) for k in c if k in stay}
        for k, v in x.items():
            score[k] += v / math.sqrt(sum(y * y for y in x.values())) / 4
    want = sorted(((k, round(v, 6)) for k, v in score.items()), key=lambda p: (-p[1], p[0]))[:4]
    got = K.file_tfidf(df, 4, most_terms=5)
    assert shuffles(got) == 1
    assert [(r["term"], pytest.approx(r["score"])) for r in sorted(got.collect(), key=lambda r: r["rank"])] == want
    assert {r["file_path"] for r in got.collect()} == {"/a"}
