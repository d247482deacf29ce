"""Exam entities over the tables of a folder: each response once, each attempt once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markwise.functions.numeric import units
from markwise.sources.tables import table


def responses(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """response_id and the named columns (all by default) of the responses, without repeated rows.

    Repeated rows are equal, so a distinct over the columns that a query needs leaves one; unlike a choice of one row per id
    it is aggregated by hash, without sorting.
    """
    rows = table(spark, folder, "responses")
    return (rows.select("response_id", *[c for c in columns if c != "response_id"]) if columns else rows).distinct()


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Questions."""
    return table(spark, folder, "questions")


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """attempt_id, student_ref, student_name, class_id of each attempt: repeated deliveries fall together, an empty class is none."""
    filled = lambda c: F.max(F.nullif(F.col(c), F.lit(""))).alias(c)
    return table(spark, folder, "attempts").groupBy("attempt_id").agg(filled("student_ref"), filled("class_id"))


def joined(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Responses with their question; ``score_u`` and ``max_u`` are scores in millionths. Unknown questions give no row.

    ``columns`` of the responses are read beside question_id and score; all by default.
    """
    r, q = responses(spark, folder, *(("question_id", "score", *columns) if columns else ())), questions(spark, folder)
    both = r.join(q, "question_id")
    score = F.when(F.isnan("score"), None).otherwise(F.col("score"))
    return both.withColumns({"score_u": units(score), "max_u": units(F.col("max_score"))})


def placed(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Responses with their question and attempt."""
    return joined(spark, folder, *(("attempt_id", *columns) if columns else ())).join(attempts(spark, folder), "attempt_id")


#: The same views in DuckDB's SQL, as the beginning of a query.
BASE = """
WITH r AS (SELECT * FROM responses QUALIFY row_number() OVER (PARTITION BY response_id ORDER BY ingested_at) = 1),
a AS (SELECT attempt_id, max(nullif(student_ref, '')) AS student_ref, max(nullif(class_id, '')) AS class_id FROM attempts GROUP BY attempt_id),
j AS (
  SELECT r.*, q.paper_id, q.question_type, q.question_text, q.max_score, q.reference_answer, q.difficulty, q.tags,
         CAST(CAST(r.score AS DECIMAL(20,6)) * 1000000 AS HUGEINT) AS score_u, CAST(CAST(q.max_score AS DECIMAL(20,6)) * 1000000 AS HUGEINT) AS max_u
  FROM r JOIN questions q USING (question_id)
),
p AS (SELECT j.*, a.student_ref, a.class_id FROM j JOIN a USING (attempt_id))
"""


def round_sql(value: str) -> str:
    """A double rounded to one place as Python does, half to even on its exact binary value, in DuckDB's SQL."""
    tenths = f"(CAST(format('{{:.20f}}', {value}) AS DECIMAL(38,20)) * 10)"
    whole = f"floor({tenths})"
    return f"CAST(CASE WHEN {tenths} - {whole} > 0.5 THEN {whole} + 1 WHEN {tenths} - {whole} < 0.5 THEN {whole} ELSE {whole} + {whole} % 2 END AS DOUBLE) / 10"


def percent_sql(part: str, whole: str) -> str:
    """100 * part / whole rounded half up to two places, in DuckDB's SQL."""
    return f"CASE WHEN {whole} = 0 THEN CAST(0 AS DOUBLE) ELSE CAST((CAST({part} AS HUGEINT) * 20000 + {whole}) // (CAST({whole} AS HUGEINT) * 2) AS DOUBLE) / 100.0 END"
