"""Old-format answers to the current form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwise.functions.numeric import to_decimal
from markwise.functions.text import safe_id

# Old names of question types, and the types of today.
TYPE_ALIASES = {"choice": "single_choice", "single-choice": "single_choice", "multiple-choice": "multiple_choice", "boolean": "true_false", "blank": "fill_blank", "calculation": "numeric", "math": "formula", "essay": "subjective"}
TYPES = ("single_choice", "multiple_choice", "true_false", "fill_blank", "numeric", "formula", "ordered_steps", "subjective")
STATUSES = ("unreviewed", "provisional", "needs_review", "auto_confirmed", "teacher_confirmed", "rejected")


def question_type(text: Column) -> Column:
    """Today's question type of an old name; subjective for unknown ones."""
    plain = F.replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lit(" "), F.lit("_"))
    aliases = F.create_map(*[F.lit(x) for pair in TYPE_ALIASES.items() for x in pair])
    mapped = F.coalesce(F.try_element_at(aliases, plain), plain)
    return F.when(mapped.isin(*TYPES), mapped).otherwise("subjective")


def review_status(text: Column) -> Column:
    """Statuses that need review or were settled stay; confirmed, unreviewed, missing and unknown ones are provisional."""
    return F.when(text.isin(*[s for s in STATUSES if s != "unreviewed"]), text).otherwise("provisional")


def migrated(old: DataFrame) -> DataFrame:
    """Old answers as responses: ids made safe, types and statuses mapped, the score compared with the maximum.

    Each v1_id once; repeated rows are equal. A missing maximum counts as 0.
    """
    score = to_decimal(F.col("score"))
    top = F.coalesce(to_decimal(F.col("max_score")), F.lit(0).cast("decimal(20,6)"))
    return old.dropDuplicates(["v1_id"]).select(
        F.col("v1_id"), safe_id(F.col("attempt_id"), F.lit("attempt-unknown")).alias("attempt_id"), safe_id(F.col("student_id"), F.lit("student-unknown")).alias("student_ref"), safe_id(F.col("question_id"), F.lit("q-unknown")).alias("question_id"),
        question_type(F.col("question_type")).alias("question_type"), F.col("student_answer").alias("normalized_answer"), "reference_answer", top.cast("double").alias("max_score"), score.cast("double").alias("score"),
        (score == top).alias("is_correct"), F.col("ocr_confidence").alias("ocr"), F.col("grading_confidence").alias("grading"), review_status(F.col("review_status")).alias("review_status"), F.lit("migrated_from_v1").alias("review_reason"),
    )


_TAGS = "array<struct<dimension:string,name:string,confidence:double>>"


def split_tags(tags: Column) -> tuple[Column, Column]:
    """The tags of a question (knowledge, cognitive) and those of the response (error) from the mixed tags of an old answer."""
    all_ = F.coalesce(tags, F.array().cast(_TAGS))
    of = lambda *kinds: F.filter(all_, lambda t: F.coalesce(t["dimension"].isin(*kinds), F.lit(False)))
    return of("knowledge", "cognitive"), of("error")


def migrated_evidence(question_id: Column, evidence: Column) -> Column:
    """Old evidence (array of observed, explanation, step as text, confidence) in the current form.

    Ids are numbered from 1 within the question; the first is causal, the others follow from it; a step is kept if it is whole.
    """
    def one(e: Column, i: Column) -> Column:
        step = F.when(e["step"].rlike(r"^-?\d+$"), e["step"].try_cast("int"))
        return F.struct(
            F.concat(F.lit("ev-"), question_id, F.lit("-"), (i + 1).cast("string")).alias("evidence_id"), F.coalesce(e["observed"], F.lit("")).alias("observed"), F.coalesce(e["explanation"], F.lit("")).alias("explanation"),
            F.when(i == 0, "causal").otherwise("consequential").alias("causal_role"), step.alias("step"), e["confidence"].alias("confidence"),
        )

    return F.transform(F.coalesce(evidence, F.array().cast("array<struct<observed:string,explanation:string,step:string,confidence:double>>")), one)


def old_papers(old: DataFrame) -> DataFrame:
    """attempt_id, student_ref, answers, max_score, score, without_score: one paper per old attempt, summed exactly.

    Each v1_id once. An attempt named for several students goes to the least.
    """
    rows = migrated(old)
    exact = lambda c: F.col(c).cast("decimal(20,6)")
    return rows.groupBy("attempt_id").agg(
        F.min("student_ref").alias("student_ref"), F.count("*").alias("answers"), F.sum(exact("max_score")).cast("double").alias("max_score"), F.coalesce(F.sum(exact("score")), F.lit(0)).cast("double").alias("score"), F.count_if(F.col("score").isNull()).alias("without_score")
    )


def warnings(old: DataFrame) -> DataFrame:
    """v1_id, warning: what the migration of each old answer had to make up."""
    rules = {
        "question type unknown": F.col("question_type").isNull() | ((question_type(F.col("question_type")) == "subjective") & ~F.coalesce(F.lower(F.trim("question_type")).isin("subjective", "essay"), F.lit(False))),
        "maximum missing": to_decimal(F.col("max_score")).isNull(), "reference missing": F.col("reference_answer").isNull(),
        "status unknown": ~F.coalesce(F.col("review_status").isin(*STATUSES, "confirmed"), F.lit(False)),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(w)) for w, c in rules.items()]))
    return old.dropDuplicates(["v1_id"]).select("v1_id", F.explode(found).alias("warning"))
