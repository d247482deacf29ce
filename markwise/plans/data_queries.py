"""Queries of the general data problems: drifting schemas, nested records, mixed timestamps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markwise.operators import drift, instants, nested
from markwise.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every change of every export file against the file before it in its feed."""
    return drift.changes(drift.delivered(table(spark, folder, "export_lines")))


def p1_items(spark: SparkSession, folder: str) -> DataFrame:
    """All exported items in one consistent typed table; the rescue column as sorted JSON."""
    lines = drift.delivered(table(spark, folder, "export_lines"))
    items = drift.consistent(lines, drift.changes(lines))
    return drift.replay(items, "scanner_model", "string", ("scanner_model",)).withColumn("rescued", F.to_json("rescued"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every evidence object of the class records with its positions and parents."""
    found = nested.class_table(table(spark, folder, "class_records"), "attempts.responses.evidence", ["attempt_id", "question_id", "evidence_id"])
    return found.select("record_id", "attempt_pos", "response_pos", "evidence_pos", "attempt_id", "question_id", "evidence_id")


def p2_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table of attempts."""
    return nested.class_table(table(spark, folder, "class_records"), "attempts")


def p2_responses(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table of responses, linked to their attempt."""
    return nested.class_table(table(spark, folder, "class_records"), "attempts.responses")


def p2_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table of evidence, linked to its response and attempt."""
    return nested.class_table(table(spark, folder, "class_records"), "attempts.responses.evidence")


def p2_error_tags(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table of error tags, linked to their response and, by evidence_ids, to its evidence."""
    return nested.class_table(table(spark, folder, "class_records"), "attempts.responses.error_tags")


def p2_records(spark: SparkSession, folder: str) -> DataFrame:
    """The fields of the records themselves."""
    return nested.class_table(table(spark, folder, "class_records"), "")


def p2_questions(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table of the questions of the records' papers."""
    return nested.class_table(table(spark, folder, "class_records"), "paper.questions")


def p2_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table of the review queues."""
    return nested.class_table(table(spark, folder, "class_records"), "review_queue")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The exact moment of every attempt whose submitted_at names one."""
    return instants.moments(table(spark, folder, "attempts"), table(spark, folder, "org_settings"), "attempt_id", "submitted_at", "organization_id")


def list_sql(value: str, path: str) -> str:
    """A repeated part in DuckDB's SQL: a list, a lone object, or the JSON text of either."""
    own = f"(CASE json_type({value}, '{path}') WHEN 'VARCHAR' THEN CAST(CASE WHEN json_valid({value} ->> '{path}') THEN {value} ->> '{path}' END AS JSON) ELSE {value} -> '{path}' END)"
    return f"(CASE json_type({own}) WHEN 'ARRAY' THEN CAST({own} AS JSON[]) WHEN 'OBJECT' THEN [{own}] ELSE [] END)"


#: Attempts (a), responses (r) and evidence (e) of the latest complete delivery of every record, with their positions.
NESTED = f"""
WITH c AS (SELECT record_id, CAST(payload AS JSON) AS p FROM class_records WHERE record_id IS NOT NULL AND json_valid(payload) QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY loaded_at DESC, payload DESC) = 1),
a0 AS (SELECT record_id, unnest(l) AS x, CAST(unnest(range(len(l))) AS INT) AS attempt_pos FROM (SELECT record_id, {list_sql("p", "$.attempts")} AS l FROM c)),
a AS (SELECT *, x ->> '$.attempt_id' AS attempt_id FROM a0 WHERE json_type(x) = 'OBJECT'),
r0 AS (SELECT * EXCLUDE (l, x), unnest(l) AS x, CAST(unnest(range(len(l))) AS INT) AS response_pos FROM (SELECT *, {list_sql("x", "$.responses")} AS l FROM a)),
r AS (SELECT *, x ->> '$.question_id' AS question_id FROM r0 WHERE json_type(x) = 'OBJECT'),
e0 AS (SELECT * EXCLUDE (l, x), unnest(l) AS x, CAST(unnest(range(len(l))) AS INT) AS evidence_pos FROM (SELECT *, {list_sql("x", "$.evidence")} AS l FROM r)),
e AS (SELECT * FROM e0 WHERE json_type(x) = 'OBJECT'),
t0 AS (SELECT * EXCLUDE (l, x), unnest(l) AS x, CAST(unnest(range(len(l))) AS INT) AS tag_pos FROM (SELECT *, {list_sql("x", "$.error_tags")} AS l FROM r)),
t AS (SELECT * FROM t0 WHERE json_type(x) = 'OBJECT')
"""
P2_FOUND = NESTED + "SELECT record_id, attempt_pos, response_pos, evidence_pos, attempt_id, question_id, x ->> '$.evidence_id' AS evidence_id FROM e"


def _rest_sql(*known: str) -> str:
    """Null where an object has the known keys only; these data hold no others in attempts, responses and tags."""
    return f"CASE WHEN len(list_filter(json_keys(x), lambda k: k NOT IN ({', '.join(repr(k) for k in known)}))) > 0 THEN 'more' END AS rest"


def _fields_sql(*paths: str) -> str:
    return ", ".join(f"x ->> '$.{p}' AS {p.replace('.', '_')}" for p in paths)


P2_ATTEMPTS = NESTED + f"SELECT record_id, attempt_pos, attempt_id, {_fields_sql('class_id', 'student_ref', 'submitted_at')}, {_rest_sql('attempt_id', 'class_id', 'student_ref', 'submitted_at', 'responses')} FROM a"
P2_RESPONSES = (
    NESTED
    + f"SELECT record_id, attempt_pos, response_pos, attempt_id, question_id, {_fields_sql('raw_ocr_text', 'normalized_answer', 'score', 'confidence.ocr', 'confidence.grading', 'review_status', 'teacher_review')}, "
    + _rest_sql("question_id", "raw_ocr_text", "normalized_answer", "score", "confidence", "review_status", "teacher_review", "evidence", "error_tags")
    + " FROM r"
)
P2_TAGS = NESTED + f"SELECT record_id, attempt_pos, response_pos, tag_pos, attempt_id, question_id, {_fields_sql('dimension', 'name', 'confidence', 'evidence_ids')}, {_rest_sql('dimension', 'name', 'confidence', 'evidence_ids')} FROM t"
_REST_PARTS = ", ".join(f"CASE WHEN json_exists(x, '$.source.{k}') THEN '\"source.{k}\":' || CAST(x -> '$.source.{k}' AS VARCHAR) END" for k in ("bbox", "bbox_unit", "raw_text"))
P2_EVIDENCE = (
    NESTED
    + f"SELECT record_id, attempt_pos, response_pos, evidence_pos, attempt_id, question_id, {_fields_sql('evidence_id', 'observed', 'explanation', 'causal_role', 'step', 'confidence', 'source.document_id', 'source.page')}, "
    + f"'{{' || nullif(concat_ws(',', {_REST_PARTS}, CASE WHEN json_type(x, '$.source') = 'NULL' THEN '\"source\":null' END), '') || '}}' AS rest FROM e"
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    return {f.__name__: f for f in (p1_found, p1_items, p2_found, p2_attempts, p2_responses, p2_evidence, p2_error_tags, p2_records, p2_questions, p2_reviews, p5_found)}


def oracle_sql() -> dict[str, str]:
    """SQL of those that SQL can express in whole."""
    return {"p2_found": P2_FOUND, "p2_attempts": P2_ATTEMPTS, "p2_responses": P2_RESPONSES, "p2_evidence": P2_EVIDENCE, "p2_error_tags": P2_TAGS}
