import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from markwise.functions import hashing, labels, numeric, text, vectors
from markwise.operators.answers import compared


def one(spark, column, *values, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column(F.col("x"))).collect()]


def test_normalize_text(spark):
    values = [None, "", " A  B. ", "ＡＢＣ", "Straße", "abc .", "x　y。", "!?", "TRUE", "5.0", "İ", "ﬁ x", "a\tb\n"]
    got = one(spark, text.normalize_text, *values)
    assert got == ["" if v is None else text.normalized(v) for v in values]
    assert got[5] == "abc " and got[3] == "abc" and got[4] == "strasse" and got[6] == "x y"


def test_normalize_text_of_the_test_data(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("text", text.normalize_text(F.col("text")).alias("n")).collect()
    assert all(r["n"] == ("" if r["text"] is None else text.normalized(r["text"])) for r in rows)


def test_safe_id(spark):
    values = [None, "", "  q-1 ", "a b/c", "数学", "-._", "a" * 200, "é1", "1" * 128]
    assert one(spark, lambda c: text.safe_id(c, F.lit("none")), *values) == ["none", "none", "q-1", "a-b-c", "none", "none", "a" * 128, "1", "1" * 128]


def test_numbers_and_units(spark):
    values = ["5 cm", "-3.5e2 m/s", ".5", "x", "5", "1e999", None, "-43　cm²"]
    assert [None if v is None else float(v) for v in one(spark, text.number_part, *values)] == [5.0, -350.0, 0.5, None, 5.0, None, None, -43.0]
    assert one(spark, text.unit_part, *values) == ["cm", "m/s", "", None, "", "", None, "cm²"]


def test_to_decimal_and_rounding(spark):
    got = one(spark, numeric.to_decimal, "5", " 5 ", "1e2", "1_000", "NaN", "true", None, "0x1")
    assert [None if v is None else float(v) for v in got] == [5.0, 5.0, 100.0, 1000.0, None, None, None, None]
    pairs = spark.createDataFrame([(1, 3), (1, 8), (0, 0), (2, 3), (1, 800)], "p long, w long")
    assert [r[0] for r in pairs.select(numeric.percentage(F.col("p"), F.col("w"))).collect()] == [33.33, 12.5, 0.0, 66.67, 0.13]
    assert one(spark, lambda c: numeric.py_round(c, 1), 6.25, 2.675, None, schema="x double") == [6.2, 2.7, None]
    assert one(spark, lambda c: numeric.plain_number(c.cast("decimal(20,6)")), "5", "2.50", "10") == ["5", "2.5", "10"]


def test_hashes(spark):
    value = {"b": 5.0, "a": ["数", 1e-05, True, None]}
    spelled = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    got = one(spark, hashing.canonical_json, json.dumps(value, indent=2), "{", None)
    assert got == [spelled, None, None]
    assert one(spark, hashing.sha256_value, json.dumps(value)) == ["sha256:" + hashlib.sha256(spelled.encode()).hexdigest()] == [hashing.digest(value)]
    assert one(spark, hashing.state_hash, json.dumps(value | {"audit_log": [1]})) == [hashing.digest(value)]


def test_has_offset_datetime(spark):
    values = ["2026-07-29T09:00:00+08:00", "2026-07-29T09:00:00Z", "2026-07-29T09:00:00", "2026-02-30T09:00:00Z", "x", None]
    assert one(spark, text.has_offset_datetime, *values) == [True, True, False, False, False, False]


def test_cells_labels_and_escapes(spark):
    assert one(spark, text.csv_cell, "=1", ' "x"', " -1", "\tx", None, "a") == ["\"'=1\"", '" ""x"""', "\"' -1\"", "\"'\tx\"", '""', '"a"']
    assert one(spark, text.html_escaped, "<a&'\">", None) == ["&lt;a&amp;&#39;&quot;&gt;", "—"]
    assert one(spark, lambda c: labels.label("error", c), "sign-error", "new", None) == ["符号错误", "其他错因", "其他错因"]
    assert one(spark, lambda c: labels.label("error", c, F.lit("")), "sign-error") == ["符号错误"]
    assert one(spark, lambda c: labels.label("knowledge", c, F.lit("own")), "sign-error") == ["own"]
    assert one(spark, lambda c: labels.label("review_reason", c), "unanswered", "x") == ["学生未作答", "其他需要人工确认的情况"]
    assert one(spark, labels.subject_label, "math", " 八年级数学", "Math", "x", None) == ["数学", "数学", "其他学科", "其他学科", "其他学科"]
    assert one(spark, labels.grade_label, "grade-8", "初二", "八年级", "x") == ["八年级", "八年级", "八年级", "年级待确认"]
    assert one(spark, lambda c: labels.question_label(c.try_cast("int")), "3", None) == ["第 3 题", "题号待确认"]


def test_weighted_jaccard_and_cosine(spark):
    maps = spark.createDataFrame([({"a": 1.0, "b": 0.5}, {"a": 0.5}), ({}, {}), ({"a": 0.0}, {"a": 0.0}), ({}, {"a": 1.0})], "l map<string,double>, r map<string,double>")
    got = [r[0] for r in maps.select(vectors.weighted_jaccard(F.col("l"), F.col("r"))).collect()]
    assert math.isclose(got[0], 1 / 3) and got[1:] == [None, 0.0, 0.0]
    arrays = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0], [1.0]), ([], []), ([1.0], [1.0, 2.0]), (None, [1.0])], "l array<double>, r array<double>")
    got = [r[0] for r in arrays.select(vectors.cosine(F.col("l"), F.col("r"))).collect()]
    assert math.isclose(got[0], 1 / math.sqrt(2)) and got[1:] == [0.0, None, None, None]
    tags = spark.createDataFrame([([("knowledge", "a", 0.5), ("knowledge", "a", None), ("error", "b", 0.1)],), (None,)], "t array<struct<dimension:string,name:string,confidence:double>>")
    assert [r[0] for r in tags.select(vectors.tag_map(F.col("t"), "knowledge")).collect()] == [{"a": 1.0}, {}]


@pytest.mark.parametrize(
    ("kind", "answer", "reference", "share", "note"),
    [
        ("single_choice", "ｂ.", "B", 1.0, None),
        ("single_choice", "B", None, None, "reference missing"),
        ("single_choice", " ", "B", 0.0, "unanswered"),
        ("multiple_choice", "C, A", "A;C", 1.0, None),
        ("multiple_choice", "AB", "A,B", 0.0, None),
        ("numeric", "5.0 cm", "5 cm", 1.0, None),
        ("numeric", "5 m", "5 cm", 0.0, "other unit"),
        ("numeric", "5 m", "5", 1.0, None),
        ("numeric", "five", "5", None, "number not readable"),
        ("ordered_steps", "a; b; x", "a; b; c; d", 0.5, None),
        ("ordered_steps", "a; b; c", "a; b", 1.0, None),
        ("subjective", "x", "y", None, "no rule"),
    ],
)
def test_compared(spark, kind, answer, reference, share, note):
    row = compared(spark.createDataFrame([(kind, answer, reference)], "question_type string, normalized_answer string, reference_answer string")).first()
    assert (row["match_share"], row["match_note"]) == (share, note) and row["matches"] == (None if share is None else share == 1.0)
