"""Rules over the exam tables: every violation as a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markwise.operators.migration import STATUSES, TYPES

#: Identifiers: a letter or digit, then up to 127 of these.
IDENTIFIER = r"\A[A-Za-z0-9][A-Za-z0-9._-]{0,127}\z"
LONGEST_TEXT = 100_000


def _outside(value: Column, low: float, high: float) -> Column:
    return value.isNotNull() & (F.isnan(value) | (value < low) | (value > high))


def response_rules() -> dict[str, Column]:
    """Condition of a violation by rule, over responses joined with their question (known, max_score, question_type)."""
    score = F.col("score")
    c = lambda name: F.col(f"confidence.{name}")
    full = score == F.col("max_score")
    tags = F.coalesce("error_tags", F.expr("cast(array() as array<struct<dimension:string,name:string,confidence:double>>)"))
    low = F.exists(F.array("confidence.ocr", "confidence.grading", "confidence.tagging"), lambda x: x < 0.7)
    return {
        "response.attempt_id": ~F.col("attempt_id").rlike(IDENTIFIER),
        "response.question_unknown": ~F.col("known"),
        "response.duplicate": F.col("nth") > 1,
        "response.raw_text_length": F.length("raw_ocr_text") > LONGEST_TEXT,
        "response.confidence_range": _outside(c("ocr"), 0, 1) | _outside(c("grading"), 0, 1) | _outside(c("tagging"), 0, 1),
        "response.status": ~F.coalesce(F.col("review_status").isin(*STATUSES), F.lit(False)),
        "response.score_range": _outside(score, 0, float("inf")) | (score > F.col("max_score")),
        "response.is_correct": F.col("known") & ~F.col("is_correct").eqNullSafe(F.when(score.isNotNull(), full)),
        "response.subjective_auto": (F.col("question_type") == "subjective") & (F.col("review_status") == "auto_confirmed"),
        "response.first_error_step": F.col("first_error_step") < 1,
        "response.tag_dimension": F.exists(tags, lambda t: ~F.coalesce(t["dimension"] == "error", F.lit(False))),
        "response.tag_name": F.exists(tags, lambda t: F.coalesce(F.trim(t["name"]), F.lit("")) == ""),
        "response.tag_confidence": F.exists(tags, lambda t: (t["confidence"] < 0) | (t["confidence"] > 1)),
        "response.low_confidence_status": low & ~F.col("review_status").isin("needs_review", "teacher_confirmed", "rejected"),
    }


def violations(responses: DataFrame, questions: DataFrame) -> DataFrame:
    """location, rule: every violated rule of every response. A condition that is null is no violation.

    All rules are evaluated in one pass over the joined rows.
    """
    own = questions.select("question_id", "max_score", "question_type", F.lit(True).alias("known"))
    nth = F.row_number().over(Window.partitionBy("attempt_id", "question_id").orderBy("response_id"))
    rows = responses.join(own, "question_id", "left").withColumns({"known": F.coalesce("known", F.lit(False)), "nth": nth})
    found = F.array_compact(F.array(*[F.when(condition, F.lit(rule)) for rule, condition in response_rules().items()]))
    return rows.select(F.concat(F.lit("responses/"), F.col("response_id").cast("string")).alias("location"), F.explode(found).alias("rule"))


def question_violations(questions: DataFrame) -> DataFrame:
    """location, rule: violations of single questions."""
    tags = F.col("tags")
    rules = {
        "question.id": ~F.col("question_id").rlike(IDENTIFIER),
        "question.type": ~F.coalesce(F.col("question_type").isin(*TYPES), F.lit(False)),
        "question.max_score": F.col("max_score").isNull() | _outside(F.col("max_score"), 0, float("inf")),
        "question.difficulty": ~F.coalesce(F.col("difficulty").isin("easy", "medium", "hard", "unknown"), F.lit(False)),
        "question.reference_missing": F.col("reference_answer").isNull(),
        "question.tag_dimension": F.exists(tags, lambda t: ~F.coalesce(t["dimension"].isin("knowledge", "cognitive"), F.lit(False))),
        "question.tag_confidence_missing": F.exists(tags, lambda t: t["confidence"].isNull()),
    }
    found = F.array_compact(F.array(*[F.when(condition, F.lit(rule)) for rule, condition in rules.items()]))
    return questions.select(F.concat(F.lit("questions/"), "question_id").alias("location"), F.explode(found).alias("rule"))


def missing_references(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """The distinct keys of ``child`` that ``parent`` lacks."""
    return child.select(key).where(F.col(key).isNotNull()).distinct().join(parent.select(key), key, "left_anti")
