import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from markwise.llm import lookalike, queries

ALIKE = [
    ("Ｂ", "B"), ("théorème", unicodedata.normalize("NFD", "théorème")), ("market\u3000price", "market price"), ("33\ufe0e0 N", "330 N"), ("\ufeffD\u200c", "D"), ("squ\u0430r\u0435", "square"), ("25 \u03f2m²", "25 cm²"),
    ("\u2126", "\u03a9"), ("\u212a", "K"), ("\u212b", "\u00c5"), ("\u00b5m", "\u03bcm"), ("a\u2013b\u2212c\u2011d", "a-b-c-d"), ("1\u22152", "1/2"), ("\u2f54力", "水力"), ("\uf967", "不"),
    ("vận tốc", unicodedata.normalize("NFD", "vận tốc")), ("\u0435\u0301", "é"), ("soft\u00adhyphen", "softhyphen"),
]
UNLIKE = [("FLÄCHE", "Fläche"), ("Flache", "Fläche"), ("x2", "x²"), ("1", "l"), ("O", "0"), ("I", "l"), ("水力.", "水力"), ("a b", "ab"), ("a  b", "a b"), ("½", "1/2"), ("①", "1"), ("+", "-"), ("对", "錯"), ("'", "`")]
READER = lookalike.Reader({})


@pytest.mark.parametrize(("a", "b"), ALIKE)
def test_alike(a, b):
    assert a != b and lookalike.lattice(a) == lookalike.lattice(b) and READER.read(a) == READER.read(b)


@pytest.mark.parametrize(("a", "b"), UNLIKE)
def test_unlike(a, b):
    assert lookalike.lattice(a) != lookalike.lattice(b) and READER.read(a) != READER.read(b)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=30), st.text(max_size=30))
def test_readings_are_equal_exactly_where_lattices_are(a, b):
    assert (READER.read(a) == READER.read(b)) == (lookalike.lattice(a) == lookalike.lattice(b))
    assert READER.read(READER.read(a)) == READER.read(a)


def test_script_of_a_token_decides(spark):
    counts = {tuple(r)[:2]: r["n"] for r in lookalike.bigram_counts(spark.createDataFrame([("square root",), ("корень из числа",)], "t string"), "t").collect()}
    reader = lookalike.Reader(counts)
    assert reader.read("squ\u0430r\u0435") == "square"
    assert reader.read("\u043aop\u0435\u043d\u044c") == "\u043a\u043e\u0440\u0435\u043d\u044c"


def test_printable_ascii_stays(spark):
    text = "".join(map(chr, range(32, 127)))
    assert READER.read(text) == text and READER.read(None) is None and READER.read("") == ""


def test_rows(spark):
    schema = "id long, a string, b string, form string, word string"
    rows = [(1, "squ\u0430r\u0435", "square"), (1, "squ\u0430r\u0435", "square"), (2, "square", "square"), (3, None, "x"), (4, "\u200b", ""), (5, "é" * 50_000, "é" * 50_000), (6, "a", "b"), (None, "Ｂ", "B"), (7, "Ｂ", "B")]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], schema)
    counts = lookalike.bigram_counts(frame, "a")
    assert sorted(r[0] for r in lookalike.looking_alike(frame, "id", "a", "b", counts).collect()) == [1, 5, 7]
    assert lookalike.looking_alike(frame.limit(0), "id", "a", "b", lookalike.bigram_counts(frame.limit(0), "a")).count() == 0


def test_query_against_lattices(spark, data):
    pairs = queries.answer_pairs(spark, data).distinct().collect()
    want = {(r["origin"], r["row_id"]) for r in pairs if r["answer"] and r["reference"] and r["answer"] != r["reference"] and lookalike.lattice(r["answer"]) == lookalike.lattice(r["reference"])}
    got = sorted(map(tuple, queries.p4_found(spark, data).collect()))
    assert set(got) == want and len(got) == len(want) > 10
