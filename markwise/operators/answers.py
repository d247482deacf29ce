"""Comparison of answers with their references by type of question, and what the comparison is worth."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwise.functions.numeric import to_decimal
from markwise.functions.text import answer_set, normalize_text, normalized, number_part, unit_part
from markwise.session import shipped_here


def entries(text: Column) -> Column:
    """The entries of an answer that is a list: a JSON list of texts, numbers and truth values; null for anything else."""
    return F.when(text.rlike(r"\A\s*\["), F.from_json(text, "array<string>"))


def own_entries(text: Column, steps: Column) -> Column:
    """The entries of a list, the steps of a text (separated by semicolons), or another text as a list of one; null entries are empty."""
    parts = F.filter(F.transform(F.split(text, "[;；]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(F.coalesce(entries(text), F.when(steps, parts), F.array(text)), lambda i: F.coalesce(i, F.lit("")))


def matching_prefix(given: Column, wanted: Column) -> Column:
    """How many leading items of two arrays are equal; what one array lacks differs."""
    return F.aggregate(
        F.zip_with(given, wanted, lambda a, b: F.coalesce(a == b, F.lit(False))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, same: F.struct((s["n"] + (s["on"] & same).cast("int")).alias("n"), (s["on"] & same).alias("on")),
    )["n"]


def normalized_items(items: Column) -> Column:
    """Every entry of an array normalised; null for null. Arrow batches, for the few answers that are lists."""
    shipped_here()

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        return pa.array([None if entries is None else [normalized(e) for e in entries] for entries in lists.to_pylist()], pa.list_(pa.string()))

    return run(items)


def compared(rows: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """``rows`` (question_type, normalized_answer, reference_answer, max_score and perhaps tolerance and unit_required) with
    matches, match_share, match_note, points, certainty and error_step.

    Texts are normalised once per side. Single choice, true or false, blanks and formulas match when equal; blanks with a list of
    references when the lists are equal entry by entry; multiple choice when the sets of items are equal; numbers within the
    tolerance and, where a unit is required (by default: where the reference has one), with an equal unit; ordered steps by the
    share of leading steps; the steps of a plain text are separated by semicolons. ``error_step`` is the first step that differs (1 for other types), null
    for a full match. Nothing is decided, and certainty is null, without a reference and for types without a rule; a number that
    cannot be read has certainty 0.5 and no points. A missing or empty answer has no points. ``points`` are the share of
    max_score, rounded half up to two places for steps. ``tolerance`` holds where a row has none of its own.
    """
    several = entries(F.col("reference_answer")).isNotNull() | entries(F.col("normalized_answer")).isNotNull()
    steps = F.coalesce(F.col("question_type") == "ordered_steps", F.lit(False))
    by_list = steps | (F.coalesce(F.col("question_type").isin("fill_blank", "multiple_choice"), F.lit(False)) & F.coalesce(several, F.lit(False)))
    listed = lambda text: normalized_items(F.when(by_list, own_entries(F.col(text), steps)))
    df = rows.withColumns({"__a": normalize_text(F.col("normalized_answer")), "__r": normalize_text(F.col("reference_answer")), "__given": listed("normalized_answer"), "__wanted": listed("reference_answer")})

    a, r, kind = F.col("__a"), F.col("__r"), F.col("question_type")
    common = F.lit(tolerance).cast("decimal(20,6)")
    limit = F.coalesce(to_decimal(F.col("tolerance")), common) if "tolerance" in rows.columns else common
    near = F.abs(number_part(a) - number_part(r)) <= limit
    needs = F.coalesce(F.col("unit_required"), unit_part(r) != "") if "unit_required" in rows.columns else unit_part(r) != ""
    unit = ~needs | (unit_part(a) == unit_part(r))
    readable = number_part(a).isNotNull() & number_part(r).isNotNull()
    items = lambda text, raw, array: F.when(entries(F.col(raw)).isNull(), answer_set(text)).otherwise(F.array_sort(F.array_distinct(F.filter(array, lambda x: x != ""))))
    n, m = F.size("__wanted"), matching_prefix(F.col("__given"), F.col("__wanted"))
    missing, empty = F.col("reference_answer").isNull(), F.col("normalized_answer").isNull() | (a == "")
    share = (
        F.when(missing, None)
        .when(empty, 0.0)
        .when((kind == "fill_blank") & F.col("__wanted").isNotNull() & entries(F.col("reference_answer")).isNotNull(), (F.col("__given") == F.col("__wanted")).cast("double"))
        .when(kind.isin("single_choice", "true_false", "fill_blank", "formula"), (a == r).cast("double"))
        .when(kind == "multiple_choice", (items(a, "normalized_answer", "__given") == items(r, "reference_answer", "__wanted")).cast("double"))
        .when((kind == "numeric") & readable, (near & unit).cast("double"))
        .when(kind == "ordered_steps", F.when(n == 0, 1.0).otherwise(m / n))
    )
    note = (
        F.when(missing, "reference missing")
        .when(empty, "unanswered")
        .when((kind == "numeric") & ~readable, "number not readable")
        .when((kind == "numeric") & near & ~unit, "other unit")
        .when(~F.coalesce(kind.isin("single_choice", "true_false", "fill_blank", "formula", "multiple_choice", "numeric", "ordered_steps"), F.lit(False)), "no rule")
    )
    top = F.coalesce(to_decimal(F.col("max_score")), F.lit(0).cast("decimal(20,6)")) if "max_score" in rows.columns else F.lit(1).cast("decimal(20,6)")
    by_step = F.when(empty | (n == 0), top * (~empty).cast("int")).otherwise(F.round(top * m / n, 2))
    points = F.when(share.isNull(), None).when(kind == "ordered_steps", by_step.cast("double")).otherwise(top.cast("double") * share)
    certainty = F.when(F.coalesce(note, F.lit("")).isin("reference missing", "no rule"), None).when(F.coalesce(note, F.lit("")) == "number not readable", 0.5).otherwise(1.0)
    # more steps than wanted err at the first one too many
    step = F.when(share.isNull(), None).when(empty, 1).when(kind == "ordered_steps", F.when(m < n, m + 1).when(F.size("__given") != n, F.least(F.size("__given"), n) + 1)).when(share < 1.0, 1)
    done = df.withColumns({"match_share": share, "match_note": note, "points": points, "certainty": certainty, "error_step": step.cast("int")})
    return done.withColumn("matches", F.col("match_share") == 1.0).drop("__a", "__r", "__given", "__wanted")
