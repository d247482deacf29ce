import json

from markwise.operators import document_rules, review
from markwise.sources import exports

KEYS = "record_id long, attempt_id string, question_id string"


def tables(spark):
    attempts = spark.createDataFrame([(1, 0, "a", "s"), (1, 1, "b", None), (2, 0, "a", "t")], "record_id long, attempt_pos int, attempt_id string, student_ref string")
    questions = spark.createDataFrame([(1, 0, "q1", "5"), (1, 1, "q2", "4"), (2, 0, "q1", "5")], "record_id long, question_pos int, question_id string, max_score string")
    responses = spark.createDataFrame(
        [(1, 0, 0, "a", "q1", "5", "auto_confirmed"), (1, 0, 1, "a", "q2", None, "needs_review"), (1, 1, 0, "b", "q1", "2", "provisional"), (1, 1, 1, "b", "zz", "1", "rejected"), (2, 0, 0, "a", "q1", "1", "provisional")],
        "record_id long, attempt_pos int, response_pos int, attempt_id string, question_id string, score string, review_status string",
    )
    queue = spark.createDataFrame([(1, 0, "a", "q2"), (1, 1, "b", "q1"), (1, 2, None, "q9")], "record_id long, review_pos int, attempt_id string, question_id string")
    return attempts, questions, responses, queue


def test_round_trip(spark):
    attempts, questions, responses, queue = tables(spark)
    assert [tuple(r) for r in review.missing(responses, queue).collect()] == [(2, "a", "q1")]
    assert {tuple(r) for r in review.unknown(queue, attempts, questions).collect()} == {(1, 2, "attempt_id"), (1, 2, "question_id")}
    schema = KEYS + ", at int, decision string, reason string, actor_ref string, score string"
    sound = [(1, "a", "q2", 1, "modify", "r", "t", "3"), (1, "a", "q2", 2, "modify", "r", "t", "4"), (1, "b", "q1", 1, "confirm", "r", "t", None)]
    bad = [(1, "a", "q1", 3, "confirm", "r", "t", None), (1, "a", "q2", 4, "x", "r", "t", None), (1, "a", "q2", 5, "reject", "", "t", None), (1, "a", "q2", 6, "reject", "r", "中", None), (1, "a", "q2", 7, "modify", "r", "t", "4.5"), (1, None, "q9", 8, "confirm", "r", "t", None)]
    decisions = spark.createDataFrame(sound + bad, schema)
    assert {r["at"]: r["fault"] for r in review.decision_faults(decisions, queue, responses, questions).collect()} == {3: "not in the open queue", 4: "decision", 5: "reason", 6: "actor", 7: "score", 8: "unknown response"}
    done = {(r["attempt_id"], r["at"]): tuple(r)[4:] for r in review.applied(responses, spark.createDataFrame(sound, schema)).collect()}
    assert done == {("a", 1): (None, 3.0, "needs_review", "teacher_confirmed"), ("a", 2): (3.0, 4.0, "teacher_confirmed", "teacher_confirmed"), ("b", 1): (2.0, 2.0, "provisional", "teacher_confirmed")}
    decided = spark.createDataFrame([(1, "a", "q2", "4")], KEYS + ", score string")
    final = {(r["record_id"], r["student_ref"]): tuple(r)[2:] for r in review.final_scores(attempts, responses, questions, queue, decided).collect()}
    assert final == {(1, "s"): (9.0, 9.0, 100.0, 0, 0, True), (1, "anonymous-student"): (2.0, 5.0, 40.0, 1, 0, False), (2, "t"): (1.0, 5.0, 20.0, 0, 0, True)}
    assert {tuple(r) for r in review.final_incorrect(attempts, responses, questions, decided).collect()} == {(1, "anonymous-student", "1"), (2, "t", "1")}
    assert [tuple(r) for r in review.remaining(queue, decided).collect()] == [(1, 3, 1, 2)]


def test_binding_and_reloading(spark):
    docs = spark.createDataFrame([(1, "o", "x", "h")], "record_id long, organization_id string, analysis_id string, state_hash string")
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 1)], "record_id long, key string, n int")
    made = json.loads(exports.bound_documents(rows, docs, ["key"], ["n"], "2026").first()["document"])
    assert made["document_state_hash"] == "h" and made["decisions"] == [{"key": "a", "n": 1}, {"key": "b", "n": 2}]
    assert review.bound(docs, docs).count() == 0
    assert [r["field"] for r in review.bound(docs.withColumn("state_hash", docs["analysis_id"]), docs).collect()] == ["state_hash"]
    items = spark.createDataFrame([(1, "a", "q", "2", "5"), (1, "a", "r", None, "5")], KEYS + ", score string, max_score string")
    saved = spark.createDataFrame([(1, "a", "q", "2.0", "t"), (1, "a", "r", "2.345", "t"), (1, "a", "z", "1", "t"), (1, "a", "q", "9", "t")], KEYS + ", score string, reviewed_at string")
    assert {(r["question_id"], r["decision"], r["score"]) for r in exports.reloaded(saved, items).collect()} == {("q", "confirm", 2.0), ("r", "modify", 2.35)}


def test_rules_of_records(spark):
    evidence = {"evidence_id": "e", "observed": "o", "explanation": None, "causal_role": "why", "step": 0, "confidence": True, "source": {"bbox": [1, 2, 0, 4], "page": 1.5}}
    record = {"schema_version": 2, "attempts": [None, {"attempt_id": "-", "student_name": " ", "responses": [{"evidence": [evidence], "error_tags": {}, "normalized_answer": [[1]], "review_reasons": [1]}]}], "paper": {"questions": []}, "more": 1}
    frame = spark.createDataFrame([(1, "2026", json.dumps(record)), (1, "2027", "{"), (2, "2026", None), (None, "2026", "{}"), (3, "2026", "[]")], "record_id long, loaded_at string, payload string")
    got = {(r["record_id"], r["location"], r["rule"]) for r in document_rules.all_violations(document_rules.documents(frame)).collect()}
    at = "attempts[1].responses[0]"
    for location, rule in [
        ("root", "unsupported more"), ("root", "missing provenance"), ("root", "schema_version: one_of"), ("paper", "questions: filled"), ("attempts[0]", "no object"), ("attempts[1]", "attempt_id: id"), ("attempts[1]", "student_name: name_or_null"),
        (at, "error_tags: list"), (at, "normalized_answer: answer"), (at, "review_reasons: texts"), (f"{at}.evidence[0]", "explanation: long"), (f"{at}.evidence[0]", "causal_role: one_of"), (f"{at}.evidence[0]", "step: positive_or_null"),
        (f"{at}.evidence[0]", "confidence: confidence"), (f"{at}.evidence[0].source", "bbox: box_or_null"), (f"{at}.evidence[0].source", "page: positive_or_null"),
    ]:
        assert (1, location, rule) in got, (location, rule)
    assert (3, "root", "no object") in got and not any(r[0] == 2 for r in got) and (1, f"{at}.evidence[0]", "evidence_id: id") not in got
