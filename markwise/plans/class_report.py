"""The report of one class."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markwise.functions import hashing, labels
from markwise.operators import statistics, vocabulary
from markwise.plans.exam_views import attempts, placed, questions
from markwise.sources.report import VIEW
from markwise.sources.tables import table


#: Rows of one list that a page holds where the whole list is written beside it.
PAGE = 20_000


def report_lists(spark: SparkSession, folder: str, rows: DataFrame) -> dict[str, DataFrame]:
    """The lists of the report over the responses of one class, whole and in their order.

    Distributions have the width of a bar (by the longest); the three questions that cost the most are marked. Questions show
    their errors and knowledge, students their names, wrong questions, main errors and weak knowledge, by label.
    """
    widest = Window.partitionBy(F.lit(1))  # one row per label
    named = lambda df, kind: df.withColumn("label", labels.label(kind, F.col("name"))).withColumn("width", F.round(F.col("n") * 100 / F.max("n").over(widest), 2)).orderBy(F.desc("n"), "name")
    asked = questions(spark, folder).join(rows.select("question_id").distinct(), "question_id", "left_semi")
    waiting = rows.where(F.col("review_status").isin("needs_review", "provisional"))
    shown = lambda kind: F.concat_ws(" × ", labels.label(kind, F.col("name")), F.col("n").cast("string"))
    listed = lambda df, key, kind, out: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", shown(kind).alias("s")))).alias("l")).select(key, F.array_join(F.transform("l", lambda x: x["s"]), "、").alias(out))
    knowledge = F.transform(F.filter("tags", lambda t: (t["dimension"] == "knowledge") & (t["name"] != "")), lambda t: t["name"])
    insight = statistics.question_insight(asked, rows).join(asked.select("question_id", "question_text", F.array_join(F.array_sort(F.array_distinct(F.transform(knowledge, lambda n: labels.label("knowledge", n)))), "、").alias("knowledge")), "question_id")
    insight = insight.join(listed(statistics.question_errors(rows), "question_id", "error", "errors"), "question_id", "left").withColumn("priority", F.when(F.col("position") <= 3, "高").otherwise("常规"))
    key = F.coalesce(F.nullif(F.col("student_ref"), F.lit("")), F.lit("anonymous-student"))
    wrong = rows.where(F.col("is_correct").eqNullSafe(F.lit(False))).groupBy(key.alias("student_ref")).agg(F.array_join(F.array_sort(F.collect_set("question_id")), "、").alias("wrong_questions"))
    reviews = waiting.groupBy(key.alias("student_ref")).agg(F.count("*").alias("review_count"))
    people = table(spark, folder, "attempts").where("nullif(student_ref, '') is not null").groupBy("student_ref").agg(F.min("student_name").alias("name"), (F.count_distinct("student_name") > 1).alias("name_conflict"))
    students = statistics.student_summary(rows)
    for more in (
        wrong, reviews, people,
        listed(statistics.student_top(rows, F.transform("error_tags", lambda t: t["name"])), "student_ref", "error", "main_errors"),
        listed(statistics.student_top(rows, knowledge), "student_ref", "knowledge", "weak_knowledge"),
    ):
        students = students.join(more, "student_ref", "left")
    students = students.na.fill(0, ["review_count"]).na.fill(labels.DEFAULTS["student"], ["name"])
    reasons = F.array_join(F.transform(F.array_sort(F.coalesce("review_reasons", F.array().cast("array<string>"))), lambda c: labels.label("review_reason", c)), "、")
    tags = rows.select(F.explode("error_tags").alias("t"), "response_id", "question_id", "student_ref").where(~F.coalesce(F.col("t.name").isin(*labels.LABELS["error"]), F.lit(True)))
    return {
        "knowledge_distribution": named(statistics.tag_distribution(rows, "knowledge"), "knowledge"),
        "error_distribution": named(statistics.error_distribution(rows), "error"),
        "priority_questions": insight.orderBy("position"),
        "student_summaries": students.orderBy(F.asc_nulls_last("score_rate"), F.desc("incorrect"), F.desc("review_count"), "student_ref"),
        "review_items": waiting.select("question_id", "student_ref", "attempt_id", "response_id", "score", "max_score", labels.label("review_status", F.col("review_status")).alias("state"), reasons.alias("reasons")).orderBy("question_id", "student_ref", "attempt_id", "response_id"),
        "taxonomy_candidates": vocabulary.candidates(tags.select("t.dimension", "t.name", F.lit(None).cast("string").alias("display_name"), F.col("response_id").alias("at"), "question_id", "student_ref")).orderBy("id"),
    }


def report_model(spark: SparkSession, folder: str, class_id: str, organization_id: str = "", subject: str | None = None, grade: str | None = None, rows_to: str | None = None, page: int = PAGE) -> dict:
    """The report of one class, its lists whole.

    Where ``rows_to`` names a folder, a list of more than ``page`` rows is written there whole, as Parquet, and the model
    holds its first ``page`` rows and a note that says so; without a folder all rows come to the driver.
    """
    rows = placed(spark, folder, "is_correct", "review_status", "review_reasons", "error_tags").where(F.col("class_id") == class_id).persist()
    try:
        lists, notes = {}, ["一次作答可有多个标签，各项百分比之和可超过 100%。"]
        named = spark.range(1).select(labels.subject_label(F.lit(subject)).alias("subject"), labels.grade_label(F.lit(grade)).alias("grade")).first()
        subject, grade = named["subject"], named["grade"]
        for name, df in report_lists(spark, folder, rows).items():
            got = (df if rows_to is None else df.limit(page + 1)).collect()
            if rows_to is not None and len(got) > page:
                df.write.mode("overwrite").parquet(f"{rows_to}/{name}")
                got = got[:page]
                notes.append(f"{name}: 此处为前 {page} 行，全部 {df.count()} 行见 {rows_to}/{name}")
            lists[name] = [r.asDict() for r in got]
        model = {
            "view_schema_version": VIEW, "title": "错题分析报告", "organization_id": organization_id, "analysis_id": class_id, "subject": subject, "grade": grade, "curriculum_version": None,
            "student_count": attempts(spark, folder).where(F.col("class_id") == class_id).count(), "class_count": 1, "metrics": statistics.overall(rows).first().asDict() | {"review_count": rows.where(F.col("review_status").isin("needs_review", "provisional")).count()}, **lists,
            "teaching_actions": [f"先讲 {q['question_id']}" for q in lists["priority_questions"][:3] if q["incorrect"]], "notes": notes,
        }
        return model | {"document_state_hash": hashing.digest(model)}
    finally:
        rows.unpersist()

