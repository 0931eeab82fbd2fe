"""Each stage of the pipeline on what its predecessor kept, against brute force; and the whole of run()."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import packing, quality

from .test_operators import brute_components, brute_leaks, brute_lines


def rows(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """The documents, and after each stage what it wrote."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def base_failed(text):
    w = text.encode().split()
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    repeated = {i + j for places in at.values() if len(places) > 1 for i in places for j in range(8)}
    return len(w) < 20 or 100 * len(repeated) > 30 * len(w)


def test_columns_and_order(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_quality_rules(spark, sf, stages):
    docs, kept = rows(stages[0]), rows(stages[1])
    assert kept and kept.items() <= docs.items() and not any(base_failed(t) for t in kept.values())
    judged = quality.judge(stages[0], quality.fit(stages[0], spark.read.parquet(f"{sf}/labels.parquet"))).where("kept")
    assert {r["doc_id"] for r in judged.collect()} == set(kept)


def test_line_dedup(stages):
    before, after = rows(stages[1]), {r["doc_id"]: (r["text"], r["n_chars"]) for r in stages[2].collect()}
    want = brute_lines(before)
    assert after == {i: (t, len(t)) for i, (_, _, t) in want.items()} and any(dropped for _, dropped, _ in want.values())


def test_near_duplicates(spark, sf, stages):
    """On what line dedup kept, and on what came before it, which holds more copies."""
    for before, after in ((stages[2], stages[3]), (stages[0], corpus_pipeline.near_duplicates(spark, stages[0], sf))):
        texts = rows(before)
        want = brute_components(texts, 5, 80, 100)
        assert rows(after) == {i: t for i, t in texts.items() if want[i][1] == i}
    assert after.count() < before.count()


def test_decontamination(spark, sf, stages):
    before, after = rows(stages[3]), rows(stages[4])
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    near = {i: t for i, t in before.items() if len(t) < 2500}  # brute force over every window of long texts takes too long here
    leaked = {i for i, _ in brute_leaks(near, items)}
    assert leaked and after.items() <= before.items()
    assert {i for i in near if i not in after} == leaked


def test_packing(stages):
    docs, encoder = rows(stages[4]), packing._Encoder(packing.tokenizer_path())
    pieces, places, total = Counter(), defaultdict(list), Counter()
    for r in stages[5].collect():
        pieces[r["doc_id"]] += 1
        total[r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert total == {i: len(encoder.tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in docs.items()}
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= 1.03 * -(-sum(total.values()) // 2048) + 1


def test_quality_on_labels_that_it_was_not_fitted_on(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(d, labels.where("doc_id % 2 = 0"))
    judged = quality.judge(d, model).join(labels.where("doc_id % 2 = 1"), "doc_id").where(~F.col("base_failed"))
    kept = {r["quality"]: r["share"] for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    print("held out:", kept)
    assert kept[1] > 0.98 and kept[0] < 0.4
