"""Functions and operators on small inputs with known results."""

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.functions import vectors as V
from corpusmill.operators import chunking as C
from corpusmill.operators import fulltext as T
from corpusmill.operators import graph as G
from corpusmill.operators import grounding as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("function", "given", "want"),
    [
        (X.basename, "/a/b.py", "b.py"), (X.dirname, "/a/b.py", "/a"), (X.dirname, "b.py", "b.py"), (X.suffix, "/a/b.PY", ".py"), (X.suffix, "/a/.hidden", ""),
        (X.word_count, " a  b\nc ", 3), (X.line_count, "a\n", 2), (X.slug, "a b/c", "a_b_c"), (X.slug, "///", "unknown"),
        (X.query_safe, "'-foo* bar+", "foo bar"), (X.query_words, "a, b,,  c", ["a", "b", "c"]), (X.strip_escapes, "\x1b[1mx\x1b[0m\x07y\tz", "xy\tz"),
        (X.squeeze, "a\n\n\n\nb  c", "a\n\nb c"), (X.summary, "One. Two.", "One. Two."), (X.keywords, "The cat and the other-cat", ["cat", "other-cat"]),
    ],
)
def test_text(spark, function, given, want):
    assert one(spark, function(F.lit(given))) == want


def test_vectors(spark):
    a, b = V.literal([3, 4]), V.literal([4, 3])
    assert one(spark, V.cosine(a, b)) == pytest.approx(0.96)
    assert one(spark, V.squared_distance(a, b)) == 2
    assert one(spark, V.unit(a)) == pytest.approx([0.6, 0.8])
    assert one(spark, V.unit(V.literal([0, 0]))) == [0, 0]
    assert one(spark, V.cosine(a, V.literal([0, 0]))) is None


@pytest.mark.parametrize("text", ["", "x", "a\n" * 500, "y" * 900 + "\nz"])
def test_code_pieces_are_the_text_again(spark, text):
    pieces = one(spark, C.code_pieces(F.lit(text)))
    assert "\n".join(pieces) == text
    assert all(len(p) <= 350 or "\n" not in p for p in pieces)


@pytest.mark.parametrize(("query", "want"), [("cat", True), ("dog", False), ('"black cat"', True), ('"cat black"', False), ("cat -black", False), ("dog OR cat", True), ("cat dog", False), ("", False), ("-dog", False)])
def test_queries(spark, query, want):
    assert one(spark, T.Query.parse(query).matches(X.tokens(F.lit("A black cat.")))) is want


@pytest.mark.parametrize(("a", "b", "turn", "last", "shown", "want"), [(1, 1, 1, 1, 0, 6), (2, 0, 1, 1, 0, 4), (0, 2, 1, 1, 0, 2), (0, 0, 1, 1, 0, 0), (1, 1, 1, 1, 4, 3), (1, 0, 5, 1, 0, 0.4)])
def test_score(spark, a, b, turn, last, shown, want):
    assert one(spark, R.score(*[F.lit(x) for x in (a, b, turn, last, shown)])) == pytest.approx(want)


def test_threshold_rises_to_its_limit(spark):
    got = [one(spark, R.threshold(F.lit(t))) for t in (0, 1, 2, 10, 1000)]
    assert got[:2] == [0, 0] and got == sorted(got) and 0.399 < got[-1] < 0.4


def test_components_and_hops(spark, tmp_path):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (7, 7)], "a long, b long")
    assert sorted(map(tuple, G.components(pairs, str(tmp_path)).collect())) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)]
    assert sorted(map(tuple, G.hops(pairs, F.lit(1).cast("long"), str(tmp_path / "hops")).collect())) == [(1, 0), (2, 1), (3, 2)]


def test_formatted_rounds_the_exact_value(spark):
    """As C's printf: the doubles nearest to 0.123456785 and 0.000000015 lie below and above; no null, and inf and nan, are kept through parse()."""
    for values in ([0.123456785, 0.000000015, 0.5 + 2**-9, -1.000000005, 9e15 + 0.5, -1e-12, float(2**-9)], [float("inf"), float("nan"), 1.0], []):
        want = "[" + ",".join("%.8f" % x for x in values) + "]"
        assert one(spark, V.formatted(F.lit(values).cast("array<double>"))) == want
        assert one(spark, V.formatted(V.parse(V.formatted(F.lit(values).cast("array<double>"))))) == want
    assert one(spark, V.formatted(F.expr("array(1D, null, 2D)"))) == "[1.00000000,2.00000000]"
    assert one(spark, V.formatted(F.expr("cast(null as array<double>)"))) is None


def test_feedback_breaks_ties_by_event(spark):
    from corpusmill.operators import graph as G

    edges = spark.createDataFrame([(i, "c", "accepted", 1.0, None if i % 4 == 0 else "t") for i in range(40, 0, -1)], "event_id long, source_node string, edge_type string, weight double, target_node string").repartition(7)
    similar = spark.createDataFrame([("c", 0.5)], "source_node string, similarity double")
    assert [r["event_id"] for r in G.feedback(edges, similar, 31).collect()] == [*[i for i in range(1, 41) if i % 4], 4]
