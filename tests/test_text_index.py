"""The positional index: ranks against brute force over all stretches, maintenance against a rebuild, fragments against all windows."""

import random
import re

import pytest

from corpusmill.operators import text_index as T
from corpusmill.operators.fulltext import Query, plain_words

WORDS = ["red", "blue", "green", "tree", "house", "of", "stone", "water", "cold"]
QUERIES = ["red", "red blue", "red red", '"red blue" tree', "red or blue", 'cold "of stone" or "water water" red', "red -blue", 'tree -"of stone"', "red blue green of", "nowhere", "nowhere or red", "-red", ""]


def made_up(seed, n, longest=60):
    r = random.Random(seed)
    return {f"d{i}": r.choice((" ", ", ", "\n")).join(r.choice(WORDS).title() if r.random() < 0.2 else r.choice(WORDS) for _ in range(r.randint(0, longest))) for i in range(n)}


def satisfied(groups, words):
    holds = lambda unit: any(words[k : k + len(unit)] == unit for k in range(len(words)))
    return any(all(holds(u) for u in g) for g in groups)


def brute(query, text):
    q, words = Query.parse(query), plain_words(text)
    if any(satisfied([[u]], words) for u in q.excluded):
        return None
    n, own = len(words), {w for g in q.groups for u in g for w in u}
    good = [(a, b) for a in range(n) for b in range(a, n) if satisfied(q.groups, words[a : b + 1])]
    least = [(a, b) for a, b in good if not any((c, d) != (a, b) and a <= c and d <= b for c, d in good)]
    return (round(sum(0.1 / (1 + sum(w not in own for w in words[a : b + 1])) for a, b in least), 9), len(least)) if least else None


def changes(spark, rows):
    return spark.createDataFrame([(d, 0, t) for d, t in rows.items()], "doc string, at int, content string")


def ranks(index, query):
    return {r["doc"]: (round(r["rank"], 9), r["covers"]) for r in index.search(query, None).collect()}


@pytest.mark.parametrize("seed", range(30))
def test_covers_are_all_minimal_stretches(seed):
    r = random.Random(seed)
    for text in made_up(seed, 4, 25).values():
        words = plain_words(text)
        places = {}
        for k, w in enumerate(words):
            places.setdefault(w, []).append(k)
        query = r.choice([q for q in QUERIES if not q.startswith("-") and q])
        groups = Query.parse(query).groups
        got = T.covers(groups, places)
        want = brute(re.sub(r'-("[^"]*"|\S+)', "", query), text)
        assert ((round(T.density(got, groups, places), 9), len(got)) if got else None) == want


def test_search(spark, tmp_path):
    texts = made_up(1, 60)
    index = T.TextIndex(spark, str(tmp_path / "i"))
    index.put(changes(spark, texts).repartition(3), 0)
    for query in ["red blue", '"red blue" tree', 'cold "of stone" or "water water" red', 'tree -"of stone"', "-red", ""]:
        want = {d: b for d, t in texts.items() if (b := brute(query, t))}
        assert ranks(index, query) == want
    first = [(-brute("red blue", t)[0], d) for d, t in texts.items() if brute("red blue", t)]
    assert [r["doc"] for r in index.search("red blue", 5).collect()] == [d for _, d in sorted(first)[:5]]


def contents(index):
    return sorted((r["term"], r["doc"], tuple(r["positions"]), r["length"]) for r in index.postings().collect())


def rebuilt(texts):
    out = []
    for d, t in texts.items():
        words = plain_words(t)
        out += [(w, d, tuple(k for k, x in enumerate(words) if x == w), len(words)) for w in set(words)]
    return sorted(out)


def test_maintenance_equals_a_rebuild(spark, tmp_path):
    texts = made_up(2, 40)
    index = T.TextIndex(spark, str(tmp_path / "i"))
    assert not contents(index) and not ranks(index, "red")
    index.put(changes(spark, texts), 0)
    new = made_up(3, 30)
    step = {f"d{i}": new[f"d{i}"] for i in range(10)} | {f"d{i}": None for i in range(10, 20)} | {f"new{i}": new[f"d{i}"] for i in range(20, 30)} | {"gone": None}
    live = {d: t for d, t in (texts | step).items() if t is not None}
    index.put(changes(spark, step), 1)
    assert contents(index) == rebuilt(live)
    index.put(changes(spark, step), 1)  # the same batch once more
    assert contents(index) == rebuilt(live) and index.segments() == [0, 1]
    index.merge(2)
    assert contents(index) == rebuilt(live) and index.segments() == [2]
    index.put(changes(spark, {"d12": "Red again", "d0": None}), 3)
    live = {d: t for d, t in live.items() if d != "d0"} | {"d12": "Red again"}
    assert contents(index) == rebuilt(live)
    assert {r["term"]: (r["docs"], r["occurrences"]) for r in T.documents_of(index).collect()}["again"] == (1, 1)
    with pytest.raises(ValueError):
        index.merge(3)


def test_an_interrupted_batch_changes_nothing(spark, tmp_path, monkeypatch):
    texts = made_up(4, 12)
    index = T.TextIndex(spark, str(tmp_path / "i"))
    index.put(changes(spark, texts), 0)

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(T.TextIndex, "_commit", broken)
        for act in (lambda: index.put(changes(spark, {"d1": "other", "d2": None}), 1), lambda: index.merge(2)):
            with pytest.raises(RuntimeError):
                act()
    assert contents(index) == rebuilt(texts)
    index.put(changes(spark, {"d1": "other", "d2": None}), 1)
    assert contents(index) == rebuilt({d: t for d, t in texts.items() if d != "d2"} | {"d1": "other"})


def test_several_changes_of_a_document_and_a_stream(spark, tmp_path):
    schema = "doc string, at int, content string"
    batches = [[("a", 1, "one two"), ("a", 3, "three"), ("a", 2, None), ("b", 1, "one")], [("b", 2, None), ("c", 1, "four four")], [("c", 5, "five"), (None, 1, "x")]]
    index = T.TextIndex(spark, str(tmp_path / "i"))
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        index.follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "c"), merge_every=2)
        assert index.segments() == [[0], [3], [3, 4]][k]
    assert contents(index) == rebuilt({"a": "three", "c": "five"})


def test_fragments(spark):
    texts = list(made_up(5, 25, 50).values()) + ["", "... --", "Été of RED!", "red"]
    wanted = ["red", "Of"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "i int, t string")
    got = {r[0]: r[1] for r in rows.select("i", T.fragment(T.F.col("t"), wanted, "<", ">", 7)).collect()}
    assert got.pop(99) is None
    for i, t in enumerate(texts):
        found = list(re.finditer(r"[^\W_]+", t))
        if not found:
            assert got[i] is None
            continue
        hit = [m[0].lower() in ("red", "of") for m in found]
        n = min(7, len(found))
        options = [(-len({found[k][0].lower() for k in range(a, a + n) if hit[k]}), -sum(hit[a : a + n]), a) for a in range(len(found) - n + 1)]
        a = min(options)[2]
        text = t[found[a].start() : found[a + n - 1].end()]
        assert got[i] == re.sub(r"[^\W_]+", lambda m: f"<{m[0]}>" if m[0].lower() in ("red", "of") else m[0], text)


def test_fragments_of_long_texts_are_read_once(spark):
    """A text is cut into words once, not for every stretch: 20,000 words took minutes."""
    import time

    words = ["stone"] * 20_000
    words[15_000:15_030] = ["red"] * 30
    words[17_000], words[17_019] = "red", "of"
    rows = spark.createDataFrame([(1, " ".join(words)), (2, "red " * 20_000)], "i int, t string")
    began = time.monotonic()
    got = dict(rows.select("i", T.fragment(T.F.col("t"), ["red", "of"], "<", ">")).collect())
    assert time.monotonic() - began < 30
    assert got == {1: "<red> " + "stone " * 18 + "<of>", 2: " ".join(["<red>"] * 20)}


def test_postings_of_one_segment_are_not_joined(spark, tmp_path):
    """Nothing in a lone segment is void, so its postings are not shuffled by document; void ones of several segments are broadcast."""
    index = T.TextIndex(spark, str(tmp_path / "i"))
    plan = lambda: T.documents_of(index)._jdf.queryExecution().executedPlan().toString()
    index.put(changes(spark, {"a": "red", "b": "blue"}), 0)
    assert "Join" not in plan()
    index.put(changes(spark, {"a": None}), 1)
    assert "BroadcastHashJoin" in plan() and "SortMergeJoin" not in plan()
    assert [tuple(r) for r in T.documents_of(index).collect()] == [("blue", 1, 1)]


def shuffled(spark, act):
    """Bytes that an action's jobs shuffle."""
    context, group = spark.sparkContext, f"shuffled {random.random()}"
    context.setJobGroup(group, group)
    try:
        act()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {s for j in context.statusTracker().getJobIdsForGroup(group) for s in context.statusTracker().getJobInfo(j).stageIds}
    return sum(context._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteBytes() for s in stages)


def long_texts(n, size=3000):
    r = random.Random(n)
    return {f"d{i}": " ".join(f"w{r.randint(0, 400)}" for _ in range(size)) for i in range(n)}


def test_a_batch_is_cut_once_and_its_postings_stay_where_they_are(spark, tmp_path):
    """Texts were cut twice, shuffled twice, and their postings, which outweigh them, shuffled by term."""
    cuts, texts = spark.sparkContext.accumulator(0), long_texts(40)

    def counted(content):
        @T.F.udf("array<string>")
        def run(text):
            cuts.add(1)
            return plain_words(text)

        return run.asNondeterministic()(content)

    index = T.TextIndex(spark, str(tmp_path / "i"), counted)
    moved = shuffled(spark, lambda: index.put(changes(spark, texts), 0))
    assert cuts.value == len(texts)
    assert moved < sum(map(len, texts.values())) / 20
    assert contents(index) == rebuilt(texts)


@pytest.mark.parametrize("spread", [1, 4, 9])
def test_the_latest_row_counts_wherever_rows_lie(spark, tmp_path, spread):
    """Documents with one row stay in their tasks, those with several are brought together."""
    texts = made_up(7, 30)
    rows = [(d, 1, t) for d, t in texts.items()] + [("d3", 0, "old"), ("d4", 2, None), ("d5", 2, "new new"), ("d5", 1, "older"), ("d6", 0, None), (None, 1, "x")]
    texts = {d: "new new" if d == "d5" else t for d, t in texts.items() if d != "d4"}
    index = T.TextIndex(spark, str(tmp_path / "i"))
    index.put(spark.createDataFrame(spark.sparkContext.parallelize(rows, spread), "doc string, at int, content string"), 0)
    assert contents(index) == rebuilt(texts)
    assert {r["doc"]: r["length"] for r in index.live().collect()} == {d: len(plain_words(t)) for d, t in texts.items()}


def test_a_merge_leaves_postings_where_they_are(spark, tmp_path, monkeypatch):
    """A merge shuffled all postings by term, and by document too where many were void: a bit for each void document is broadcast."""
    monkeypatch.setattr(T, "FEW" if hasattr(T, "FEW") else "VOID", 60)
    texts = long_texts(400, 300)
    index = T.TextIndex(spark, str(tmp_path / "i"))
    index.put(changes(spark, texts), 0)
    step = {d: None if k % 3 else "moved" for k, d in enumerate(texts) if k % 2}
    index.put(changes(spark, step), 1)
    live = {d: t for d, t in (texts | step).items() if t is not None}
    assert contents(index) == rebuilt(live)
    moved = shuffled(spark, lambda: index.merge(2))
    assert index.segments() == [2] and contents(index) == rebuilt(live)
    assert moved < sum(map(len, live.values())) / 4
    index.put(changes(spark, {"d0": "again", "d1": "again"}), 3)  # documents keep their numbers through a merge
    assert contents(index) == rebuilt(live | {"d0": "again", "d1": "again"})
