from markwise.operators import answers

SCHEMA = "response_id long, question_type string, normalized_answer string, reference_answer string, max_score double, tolerance string, unit_required boolean"


def test_rules_by_type(spark):
    cases = [
        (("single_choice", "Ａ.", "a", 5.0, None, None), (True, 5.0, 1.0, None, None)),
        (("true_false", "true", "false", 5.0, None, None), (False, 0.0, 1.0, 1, None)),
        (("single_choice", None, "a", 5.0, None, None), (False, 0.0, 1.0, 1, "unanswered")),
        (("single_choice", "a", None, 5.0, None, None), (None, None, None, None, "reference missing")),
        (("subjective", "a", "b", 5.0, None, None), (None, None, None, None, "no rule")),
        (("fill_blank", '["X", " y "]', '["x", "Y。"]', 4.0, None, None), (True, 4.0, 1.0, None, None)),
        (("fill_blank", "x", '["x", "y"]', 4.0, None, None), (False, 0.0, 1.0, 1, None)),
        (("fill_blank", "x", '["x"]', 4.0, None, None), (True, 4.0, 1.0, None, None)),
        (("multiple_choice", "C，a", "A;C", 3.0, None, None), (True, 3.0, 1.0, None, None)),
        (("multiple_choice", '["A", "C"]', "c a", 3.0, None, None), (True, 3.0, 1.0, None, None)),
        (("multiple_choice", "AC", "A,C", 3.0, None, None), (False, 0.0, 1.0, 1, None)),
        (("numeric", "5.05 cm", "5 cm", 2.0, "0.1", None), (True, 2.0, 1.0, None, None)),
        (("numeric", "５ m", "5 cm", 2.0, None, None), (False, 0.0, 1.0, 1, "other unit")),
        (("numeric", "5 m", "5 cm", 2.0, None, False), (True, 2.0, 1.0, None, None)),
        (("numeric", "five", "5", 2.0, None, None), (None, None, 0.5, None, "number not readable")),
        (("formula", "a + b", "A  + b", 2.0, None, None), (True, 2.0, 1.0, None, None)),
        (("ordered_steps", '["a", "b", "x"]', '["a", "B", "c"]', 5.0, None, None), (False, 3.33, 1.0, 3, None)),
        (("ordered_steps", '["a", "b", "c", "d"]', '["a", "b", "c"]', 5.0, None, None), (True, 5.0, 1.0, 4, None)),
        (("ordered_steps", "a", '["a", "b"]', 5.0, None, None), (False, 2.5, 1.0, 2, None)),
        (("ordered_steps", '["a"]', "[]", 5.0, None, None), (True, 5.0, 1.0, 1, None)),
        (("ordered_steps", None, '["a"]', 5.0, None, None), (False, 0.0, 1.0, 1, "unanswered")),
        ((None, "a", "a", None, None, None), (None, None, None, None, "no rule")),
    ]
    frame = spark.createDataFrame([(i, *given) for i, (given, _) in enumerate(cases)], SCHEMA)
    got = {r["response_id"]: (r["matches"], r["points"], r["certainty"], r["error_step"], r["match_note"]) for r in answers.compared(frame).collect()}
    for i, (given, want) in enumerate(cases):
        assert got[i] == want, given
    assert answers.compared(frame.limit(0)).count() == 0
