import json

from markwise.operators.nested import class_table

EVIDENCE = "attempts.responses.evidence"


def found(spark, records):
    frame = spark.createDataFrame(records, "record_id long, payload string, record string")
    return sorted(map(tuple, class_table(frame, EVIDENCE, ["attempt_id", "question_id", "evidence_id"]).collect()), key=repr)


def record(*evidence, **more):
    return json.dumps({"attempts": [None, {"attempt_id": "a", "responses": [{"question_id": "q", "evidence": e} for e in evidence]} | more]})


def test_positions_wrappers_and_snapshots(spark):
    e = lambda i: {"evidence_id": i}
    text = record([e("x"), None, e("y")], e("z"), json.dumps([e("u"), None, e("v")]), json.dumps(e("w")), None, "no json", 5, [[e("deep")], "s"])
    snapshot = json.dumps({"attempts": [{"attempt_id": "b", "responses": [{"question_id": "q", "teacher_review": {"before": {"evidence": [e("old")]}}}]}]})
    rows = [(1, text, "r"), (1, text, "r"), (2, text[:-3], "r"), (3, snapshot, "r"), (None, text, "r"), (4, None, "r"), (5, "", "r"), (6, "[]", "r"), (7, "null", "r"), (8, '{"attempts": NaN}', "r")]
    assert found(spark, rows) == sorted([(1, 1, 0, 0, "a", "q", "x"), (1, 1, 0, 2, "a", "q", "y"), (1, 1, 1, 0, "a", "q", "z"), (1, 1, 2, 0, "a", "q", "u"), (1, 1, 2, 2, "a", "q", "v"), (1, 1, 3, 0, "a", "q", "w")], key=repr)


def test_ids_absent_repeated_or_no_text(spark):
    text = json.dumps({"attempts": [{"responses": [{"evidence": [{}, {"evidence_id": 5}, {"evidence_id": None}]}]}] * 2})
    assert found(spark, [(1, text, "")]) == sorted([(1, a, 0, i, None, None, v) for a in (0, 1) for i, v in ((0, None), (1, "5"), (2, None))], key=repr)


def test_long_deep_and_empty_input(spark):
    long = record([{"evidence_id": "é" * 200_000}])
    deep = '{"attempts": ' + "[" * 100_000 + "]" * 100_000 + "}"
    assert len(found(spark, [(1, long, ""), (2, deep, "")])) == 1
    assert class_table(spark.createDataFrame([], "record_id long, payload string"), EVIDENCE).count() == 0


def test_no_field_is_lost(spark):
    review = {"actor_ref": "t", "before": {"evidence": [{"evidence_id": "old"}]}}
    response = {"question_id": "q", "error_tags": [None, {"name": "n", "evidence_ids": ["x"], "more": 1}], "teacher_review": review, "first_error_step": 2, "confidence": {"tagging": 0.5}, "none": {}}
    text = json.dumps({"analysis_id": "z", "attempts": [{"attempt_id": "a", "responses": response}], "review_queue": [{"question_id": "q", "reasons": ["r"]}], "paper": {"grade": "g", "questions": [{"question_id": "q", "difficulty": "easy"}]}})
    table = lambda group: [r.asDict() for r in class_table(spark.createDataFrame([(1, text)], "record_id long, payload string"), group).collect()]
    [tag] = table("attempts.responses.error_tags")
    assert (tag["attempt_pos"], tag["response_pos"], tag["tag_pos"], tag["attempt_id"], tag["question_id"], tag["name"], tag["evidence_ids"], tag["rest"]) == (0, 0, 1, "a", "q", "n", '["x"]', '{"more":1}')
    [row] = table("attempts.responses")
    assert json.loads(row["teacher_review"]) == review and json.loads(row["rest"]) == {"confidence.tagging": 0.5, "first_error_step": 2, "none": {}}
    [top], [question], [queued] = table(""), table("paper.questions"), table("review_queue")
    assert top["analysis_id"] == "z" and json.loads(top["rest"]) == {"paper.grade": "g"} and json.loads(question["rest"]) == {"difficulty": "easy"} and (queued["review_pos"], queued["reasons"]) == (0, '["r"]')


def test_tables_are_linked(spark, data):
    from markwise.plans import data_queries as q

    attempts, responses, evidence = q.p2_attempts(spark, data), q.p2_responses(spark, data), q.p2_evidence(spark, data)
    assert responses.join(attempts, ["record_id", "attempt_pos", "attempt_id"], "left_anti").count() == 0
    assert evidence.join(responses, ["record_id", "attempt_pos", "response_pos", "attempt_id", "question_id"], "left_anti").count() == 0
    assert evidence.count() == q.p2_found(spark, data).count() > 0


def test_of_different_deliveries_the_latest_counts_whole(spark):
    old = json.dumps({"attempts": [{"attempt_id": "a", "class_id": "z", "student_ref": "s"}, {"attempt_id": "more"}]})
    new = json.dumps({"attempts": [{"attempt_id": "b", "student_ref": None}]})
    rows = [(1, "2026-01-01", old), (1, "2026-01-02", new), (1, "2026-01-03", new[:-1]), (2, "2026-01-02", old), (2, "2026-01-01", new), (2, "2026-01-02", old)]
    frame = spark.createDataFrame(rows, "record_id long, at string, payload string").selectExpr("record_id", "cast(at as timestamp) as loaded_at", "payload")
    got = {(r["record_id"], r["attempt_pos"], r["attempt_id"], r["class_id"], r["student_ref"]) for r in class_table(frame, "attempts").collect()}
    assert got == {(1, 0, "b", None, None), (2, 0, "a", "z", "s"), (2, 1, "more", None, None)}


def test_streams_keep_late_keys_repeated_keys_and_deep_values(spark):
    deep = "[" * 50_000 + "]" * 50_000
    text = '{"attempts": [{"attempt_id": "lost"}], "deep": %s, "attempts": [{"responses": [{"evidence": [{"evidence_id": "e"}], "question_id": "q"}], "attempt_id": "x", "attempt_id": "a"}]}' % deep
    assert found(spark, [(1, text, ""), (2, text[:-1], ""), (3, text + "}", "")]) == [(1, 0, 0, 0, "a", "q", "e")]


def test_one_pass_gives_the_same_tables(spark, data):
    from markwise.operators.nested import CLASS_FIELDS, class_tables

    records = spark.read.parquet(f"{data}/class_records.parquet")
    tables = class_tables(records)
    for group in CLASS_FIELDS:
        assert sorted(map(repr, tables[group].collect())) == sorted(map(repr, class_table(records, group).collect()))
