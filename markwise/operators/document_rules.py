"""Rules over whole nested records: every violation of shape, type and value as a row.

Rules are data: what a kind of object must hold, may hold, and how its fields must look. The records are read as variants inside
the JVM; every object of a kind becomes a row with its location, and all rules of the kind are evaluated on it in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markwise.functions.labels import LABELS
from markwise.functions.numeric import to_decimal
from markwise.functions.text import has_offset_datetime
from markwise.operators.migration import STATUSES, TYPES
from markwise.operators.validation import IDENTIFIER, LONGEST_TEXT
from markwise.session import stored

# Codes that fields may hold.
COGNITIVE = ("remember", "understand", "apply", "analyze", "evaluate", "create")
ROLES = ("causal", "consequential", "context")
DIGEST = r"\Asha256:[0-9a-f]{64}\z"


@dataclass(frozen=True)
class Kind:
    """One kind of object: where it stands in its parent, which fields it must and may hold, and rules (name of the test, field, values)."""

    parent: str
    step: str
    many: bool
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    rules: tuple[tuple, ...] = field(default=())


_TAG = (("text", "name"), ("text_or_null", "display_name"), ("text_or_null", "definition"), ("confidence", "confidence"))
# The fields of every kind of object.
KINDS = {
    "root": Kind("", "", False, ("schema_version", "organization_id", "analysis_id", "created_at", "paper", "attempts", "provenance", "review_queue", "audit_log"), (),
        (("one_of", "schema_version", ("2.0",)), ("id", "organization_id"), ("id", "analysis_id"), ("moment", "created_at"), ("list", "attempts"), ("list", "review_queue"), ("list", "audit_log"))),
    "paper": Kind("root", "paper", False, ("paper_id", "subject", "grade", "curriculum_version", "max_score", "questions"), (), (("id", "paper_id"), ("text", "subject"), ("score", "max_score"), ("filled", "questions"))),
    "question": Kind("paper", "questions", True, ("question_id", "question_type", "question_text", "max_score", "reference_answer", "rubric_points", "difficulty", "tags", "source"), ("answer_options", "scoring_config"),
        (("id", "question_id"), ("one_of", "question_type", TYPES), ("long_or_null", "question_text"), ("answer", "reference_answer"), ("score", "max_score"), ("one_of", "difficulty", ("easy", "medium", "hard", "unknown")), ("list", "tags"), ("list", "rubric_points"))),
    "rubric_point": Kind("question", "rubric_points", True, (), ("rubric_id", "description", "max_score"), (("id", "rubric_id"), ("score", "max_score"))),
    "question_tag": Kind("question", "tags", True, ("dimension", "name", "confidence"), ("display_name", "definition", "evidence_ids"), (("one_of", "dimension", ("knowledge", "cognitive")), *_TAG)),
    "attempt": Kind("root", "attempts", True, ("attempt_id", "class_id", "student_ref", "submitted_at", "responses"), ("student_name",),
        (("id", "attempt_id"), ("id", "student_ref"), ("name_or_null", "student_name"), ("id_or_null", "class_id"), ("moment_or_null", "submitted_at"), ("list", "responses"))),
    "response": Kind("attempt", "responses", True,
        ("question_id", "raw_ocr_text", "normalized_answer", "score", "is_correct", "confidence", "review_status", "review_reasons", "rubric_results", "first_error_step", "evidence", "error_tags", "suggested_tags", "source", "teacher_review"), (),
        (("long_or_null", "raw_ocr_text"), ("answer", "normalized_answer"), ("number_or_null", "score"), ("one_of", "review_status", STATUSES), ("list", "evidence"), ("list", "error_tags"), ("list", "suggested_tags"), ("list", "rubric_results"), ("texts", "review_reasons"))),
    "confidence": Kind("response", "confidence", False, ("ocr", "grading", "tagging"), (), (("confidence", "ocr"), ("confidence", "grading"), ("confidence", "tagging"))),
    "evidence": Kind("response", "evidence", True, ("evidence_id", "observed", "explanation", "causal_role", "step", "confidence", "source"), (),
        (("id", "evidence_id"), ("one_of", "causal_role", ROLES), ("long", "observed"), ("long", "explanation"), ("positive_or_null", "step"), ("confidence", "confidence"))),
    "error_tag": Kind("response", "error_tags", True, ("dimension", "name", "confidence"), ("display_name", "definition", "evidence_ids"), (("one_of", "dimension", ("error",)), *_TAG, ("one_of", "name", tuple(LABELS["error"])), ("list", "evidence_ids"))),
    "suggested_tag": Kind("response", "suggested_tags", True, ("dimension", "name", "confidence"), ("display_name", "definition", "evidence_ids"), (("one_of", "dimension", ("error", "knowledge")), *_TAG)),
    "rubric_result": Kind("response", "rubric_results", True, (), ("rubric_id", "awarded_score", "evidence_ids", "status"), (("one_of", "status", ("suggested", "teacher_confirmed", "rejected")),)),
    "teacher_review": Kind("response", "teacher_review", False, (), ("actor_ref", "reviewed_at", "decision", "reason", "before", "after"), (("id", "actor_ref"), ("moment", "reviewed_at"), ("one_of", "decision", ("confirm", "modify", "reject")), ("text", "reason"))),
    "evidence_source": Kind("evidence", "source", False, ("document_id", "page", "bbox", "bbox_unit", "raw_text", "file_hash"), (), (("box_or_null", "bbox"), ("one_of_or_null", "bbox_unit", ("pixel", "normalized")), ("positive_or_null", "page"), ("digest_or_null", "file_hash"))),
    "question_source": Kind("question", "source", False, ("document_id", "page", "bbox", "bbox_unit", "raw_text", "file_hash"), (), (("box_or_null", "bbox"), ("one_of_or_null", "bbox_unit", ("pixel", "normalized")), ("positive_or_null", "page"), ("digest_or_null", "file_hash"))),
    "response_source": Kind("response", "source", False, ("document_id", "page", "bbox", "bbox_unit", "raw_text", "file_hash"), (), (("box_or_null", "bbox"), ("one_of_or_null", "bbox_unit", ("pixel", "normalized")), ("positive_or_null", "page"), ("digest_or_null", "file_hash"))),
    "review": Kind("root", "review_queue", True, (), ("review_id", "attempt_id", "question_id", "reasons", "status", "created_at"), (("id", "review_id"), ("filled", "reasons"), ("one_of", "status", ("open", "resolved", "rejected")), ("moment", "created_at"))),
    "provenance": Kind("root", "provenance", False, ("input_hash", "source_files", "adapters", "model_calls", "migration_warnings"), (), (("list_or_none", "source_files"), ("list_or_none", "adapters"), ("list_or_none", "model_calls"), ("list_or_none", "migration_warnings"))),
    "event": Kind("root", "audit_log", True, ("event_id", "timestamp", "event_type", "actor_ref", "payload_hash", "previous_hash", "event_hash"), ("state_hash",),
        (("id", "event_id"), ("id", "actor_ref"), ("moment", "timestamp"), ("digest", "payload_hash"), ("digest", "event_hash"), ("digest_or_null", "state_hash"), ("digest_or_null", "previous_hash"))),
}
#: Kinds whose objects may be null or absent.
NULLABLE = ("teacher_review", "evidence_source", "question_source", "response_source")


def documents(records: DataFrame) -> DataFrame:
    """record_id, x: the latest complete delivery of every record as a variant. Records without a complete one are left out."""
    whole = records.where(F.col("record_id").isNotNull() & F.try_parse_json("payload").isNotNull())
    last = whole.groupBy("record_id").agg(F.max(F.struct("loaded_at", "payload")).alias("d"))
    return last.select("record_id", F.try_parse_json("d.payload").alias("x"))


def objects(docs: DataFrame, kind: str, kept: dict[str, DataFrame] | None = None) -> DataFrame:
    """record_id, location, x of every object of a kind; entries of lists that are no objects too. Parts that are no list hold none.

    ``kept`` holds objects of kinds that were read before.
    """
    k = KINDS[kind]
    if kept and kind in kept:
        return kept[kind]
    if not k.parent:
        return docs.select("record_id", F.lit("root").alias("location"), "x")
    parents = objects(docs, k.parent, kept)
    prefix = F.when(F.col("location") == "root", "").otherwise(F.concat("location", F.lit(".")))
    at = F.concat(prefix, F.lit(k.step))
    if not k.many:
        return parents.select("record_id", at.alias("location"), F.try_variant_get("x", f"$.{k.step}", "variant").alias("x"), _fields(F.col("x")).alias("__f")).where(F.map_contains_key("__f", k.step)).drop("__f")
    inner = parents.select("record_id", at.alias("at"), F.posexplode(F.try_variant_get("x", f"$.{k.step}", "array<variant>")).alias("i", "x"))
    return inner.select("record_id", F.concat("at", F.lit("["), F.col("i").cast("string"), F.lit("]")).alias("location"), "x")


def _fields(x: Column) -> Column:
    """The fields of an object; null for anything else."""
    return F.try_variant_get(x, "$", "map<string,variant>")


def _test(test: str, key: str, values: tuple[str, ...] = ()) -> Column:
    """Whether a field breaks a test; ``fields`` is the map of the object's fields."""
    if test.endswith("_or_null"):
        return ~_null(key) & _test(test[:-8], key, values)
    value, kind = F.try_element_at(F.col("fields"), F.lit(key)), F.schema_of_variant(F.try_element_at(F.col("fields"), F.lit(key)))
    text, number = F.try_variant_get(value, "$", "string"), kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    double, items = F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "array<variant>")
    is_text = kind == "STRING"
    numbers = F.transform(items, lambda i: F.when(F.schema_of_variant(i).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(i, "$", "double")))
    holds = {
        "id": lambda: is_text & text.rlike(IDENTIFIER),
        "text": lambda: is_text & (F.trim(text) != ""),
        "long": lambda: is_text & (F.length(text) <= LONGEST_TEXT),
        "name": lambda: is_text & (F.trim(text) != "") & (F.length(text) <= 100) & ~text.rlike(r"[\x00-\x1f]"),
        "one_of": lambda: is_text & text.isin(*values),
        "score": lambda: ~kind.isin("BOOLEAN") & (to_decimal(text) >= 0),
        "number": lambda: ~kind.isin("BOOLEAN") & to_decimal(text).isNotNull(),
        "confidence": lambda: _null(key) | (number & (double >= 0) & (double <= 1)),
        "positive": lambda: (kind == "BIGINT") & (double >= 1),
        "list": lambda: items.isNotNull(),
        "list_or_none": lambda: ~F.map_contains_key("fields", key) | items.isNotNull(),
        "filled": lambda: items.isNotNull() & (F.size(items) > 0),
        "texts": lambda: items.isNotNull() & F.forall(items, lambda i: F.schema_of_variant(i) == "STRING"),
        "answer": lambda: _null(key) | is_text | number | (kind == "BOOLEAN") | (items.isNotNull() & F.forall(items, lambda i: F.schema_of_variant(i).rlike("^(STRING|BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN|VOID)"))),
        "moment": lambda: is_text & has_offset_datetime(text),
        "digest": lambda: is_text & text.rlike(DIGEST),
        "box": lambda: items.isNotNull() & (F.size(items) == 4) & F.forall(numbers, lambda n: n.isNotNull()) & (F.get(numbers, F.lit(2)) >= F.get(numbers, F.lit(0))) & (F.get(numbers, F.lit(3)) >= F.get(numbers, F.lit(1))),
    }
    return ~F.coalesce(holds[test](), F.lit(False))


def _null(key: str) -> Column:
    """Whether a field is absent or null."""
    kind = F.schema_of_variant(F.try_element_at(F.col("fields"), F.lit(key)))
    return kind.isNull() | (kind == "VOID")


def violations(docs: DataFrame, kind: str, kept: dict[str, DataFrame] | None = None) -> DataFrame:
    """record_id, location, rule of everything that objects of a kind break: no object, missing and unsupported fields, tests of fields."""
    k = KINDS[kind]
    rows = objects(docs, kind, kept).withColumn("fields", _fields(F.col("x")))
    absent = F.col("x").isNull() | (F.schema_of_variant("x") == "VOID")
    held = F.map_keys("fields")
    texts = lambda names: F.array(*[F.lit(n) for n in names]).cast("array<string>")
    found = F.concat(
        F.transform(F.array_except(texts(k.required), held), lambda n: F.concat(F.lit("missing "), n)),
        F.transform(F.array_except(held, texts((*k.required, *k.optional))), lambda n: F.concat(F.lit("unsupported "), n)),
        F.array_compact(F.array(*[F.when(_test(*rule), F.lit(f"{rule[1]}: {rule[0]}")) for rule in k.rules]).cast("array<string>")),
    )
    wrong = F.when(F.col("fields").isNull(), F.array(F.lit("no object"))).otherwise(found)
    if kind in NULLABLE:
        rows = rows.where(~F.coalesce(absent, F.lit(True)))
    return rows.select("record_id", "location", F.explode(wrong).alias("rule"))


def all_violations(docs: DataFrame) -> DataFrame:
    """record_id, location, rule of every kind. The records, and the objects that hold most others, are kept in the shared folder."""
    docs = stored(docs)
    kept = {kind: stored(objects(docs, kind)) for kind in ("question", "response")}
    out = None
    for kind in KINDS:
        found = violations(docs, kind, kept)
        out = found if out is None else out.unionByName(found)
    return out


def repeated(rows: DataFrame, within: list[str], key: str, order: list[str]) -> DataFrame:
    """The rows whose ``key`` an earlier row of the same parent holds; null keys do not repeat."""
    nth = F.row_number().over(Window.partitionBy(*within, key).orderBy(*order))
    return rows.where(F.col(key).isNotNull()).withColumn("__nth", nth).where("__nth > 1").drop("__nth")


def broken_links(attempts: DataFrame, responses: DataFrame, evidence: DataFrame, tags: DataFrame, questions: DataFrame) -> DataFrame:
    """record_id, location, rule: repeated ids, responses to unknown questions, scores outside their range, evidence that is not there.

    Over the flat tables of the records. A tag other than unclassified must name evidence of its own response.
    """
    spot = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) and not p.endswith("_pos") else F.col(p).cast("string") for p in parts])
    attempt, response = ("attempts[", "attempt_pos", "]"), ("attempts[", "attempt_pos", "].responses[", "response_pos", "]")
    row = lambda df, place, rule: df.select("record_id", spot(*place).alias("location"), F.lit(rule).alias("rule"))
    known = questions.groupBy("record_id", "question_id").agg(F.max_by(to_decimal(F.col("max_score")), "question_pos").alias("top"))
    joined = responses.join(known.withColumn("known", F.lit(True)), ["record_id", "question_id"], "left")
    score = to_decimal(F.col("score"))
    own = evidence.where("evidence_id is not null").groupBy("record_id", "attempt_pos", "response_pos").agg(F.collect_set("evidence_id").alias("ids"))  # the evidence of one response
    named = tags.join(own, ["record_id", "attempt_pos", "response_pos"], "left").withColumn("named", F.from_json("evidence_ids", "array<string>"))
    none = F.array().cast("array<string>")
    lost = named.withColumn("lost", F.array_except("named", F.coalesce("ids", none)))
    tag = (*response, ".error_tags[", "tag_pos", "]")
    return (
        row(repeated(attempts, ["record_id"], "attempt_id", ["attempt_pos"]), attempt, "attempt_id: repeated")
        .unionByName(row(repeated(questions, ["record_id"], "question_id", ["question_pos"]), ("paper.questions[", "question_pos", "]"), "question_id: repeated"))
        .unionByName(row(repeated(responses, ["record_id", "attempt_pos"], "question_id", ["response_pos"]), response, "question_id: repeated"))
        .unionByName(row(repeated(evidence, ["record_id", "attempt_pos", "response_pos"], "evidence_id", ["evidence_pos"]), (*response, ".evidence[", "evidence_pos", "]"), "evidence_id: repeated"))
        .unionByName(row(joined.where("known is null"), response, "question_id: unknown"))
        .unionByName(row(joined.where(F.col("known") & ((score < 0) | (score > F.coalesce("top", F.lit(0))))), response, "score: outside the range"))
        .unionByName(row(lost.where(F.size("lost") > 0), tag, "evidence_ids: unknown evidence"))
        .unionByName(row(named.where((F.size("named") == 0) & (F.coalesce("name", F.lit("")) != "unclassified")), tag, "evidence_ids: none"))
    )
