import pytest
from pyspark.sql import functions as F

from corpusmill.functions.stems import porter, stem_words, stems
from corpusmill.operators import fulltext as T

# pairs printed in the published description of the algorithm
PAIRS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
relational relat conditional condit rational ration digitizer digit operator oper feudalism feudal decisiveness decis hopefulness hope formaliti formal
triplicate triplic formative form formalize formal electrical electr goodness good revival reviv allowance allow inference infer airliner airlin
adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ
effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil""".split()


@pytest.mark.parametrize(("word", "stem"), list(zip(PAIRS[::2], PAIRS[1::2], strict=True)))
def test_porter(word, stem):
    assert porter(word) == stem


def test_words():
    assert stem_words("Straße, CAFÉS: naïve_x 12") == ["straße", "cafe", "naiv", "x", "12"]


def test_stemmed_search(spark):
    rows = [("a", "Running the connections"), ("b", "a run of one connection; no more"), ("c", "walked"), ("d", None), ("e", "")]
    docs = spark.createDataFrame(rows, "file_path string, content string")
    found = lambda q: {r["file_path"] for r in docs.withColumn("t", stems(F.col("content"))).where(T.Query.parse(q, stem_words).matches(F.col("t"))).collect()}
    assert found("runs connected") == {"a", "b"} and found("walking or zzz") == {"c"} and found("run -more") == {"a"} and found('"one connections"') == {"b"}
    got = {r["file_path"]: r["score"] for r in T.bm25(docs, ["file_path"], ["walks"], None, stems, stem_words).collect()}
    assert set(got) == {"c"} and got["c"] > 0
