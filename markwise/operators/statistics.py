"""Class, question and student statistics over responses joined with their questions.

Input rows carry score_u and max_u (scores in millionths), is_correct, difficulty, tags, error_tags and, where
students are concerned, student_ref and class_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markwise.functions.numeric import percentage, py_round
from markwise.session import stored

def scored() -> Column:
    """Whether a response has a score."""
    return F.col("score_u").isNotNull()


def _points(millionths: Column) -> Column:
    return (millionths.cast("decimal(38,0)") / 1_000_000).cast("double")


def _wrong() -> Column:
    """Scored and marked incorrect; an unknown mark is not incorrect."""
    return scored() & F.col("is_correct").eqNullSafe(F.lit(False))


def _sum(condition: Column, value: str) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0).cast("decimal(38,0)"))


def overall(rows: DataFrame) -> DataFrame:
    """One row: responses, scored, unscored, incorrect, incorrect_rate, earned, possible, score_rate. Zeros for an empty table."""
    got = rows.agg(F.count("*").alias("responses"), F.count_if(scored()).alias("scored"), F.count_if(_wrong()).alias("incorrect"), _sum(scored(), "score_u").alias("e"), _sum(scored(), "max_u").alias("m"))
    return got.select(
        "responses", "scored", (F.col("responses") - F.col("scored")).alias("unscored"), "incorrect", percentage(F.col("incorrect"), F.col("scored")).alias("incorrect_rate"),
        _points(F.col("e")).alias("earned"), _points(F.col("m")).alias("possible"), percentage(F.col("e"), F.col("m")).alias("score_rate"),
    )


def difficulty_distribution(rows: DataFrame) -> DataFrame:
    """difficulty, n over all responses; a missing difficulty is unknown."""
    return rows.groupBy(F.coalesce("difficulty", F.lit("unknown")).alias("difficulty")).agg(F.count("*").alias("n"))


def class_summary(rows: DataFrame) -> DataFrame:
    """class_id, responses, scored, incorrect; a missing or empty class is unassigned."""
    key = F.coalesce(F.nullif(F.col("class_id"), F.lit("")), F.lit("unassigned"))
    return rows.groupBy(key.alias("class_id")).agg(F.count("*").alias("responses"), F.count_if(scored()).alias("scored"), F.count_if(_wrong()).alias("incorrect"))


def tag_distribution(rows: DataFrame, dimension: str) -> DataFrame:
    """name, n, denominator, percentage: occurrences of question tags of one dimension on incorrect responses."""
    mine = F.transform(F.filter("tags", lambda t: (t["dimension"] == dimension) & t["name"].isNotNull()), lambda t: t["name"])
    return _with_share(rows.where(_wrong()).select(*_names(mine)).select("name", (F.col("at") == 0).alias("first")))


def error_distribution(rows: DataFrame) -> DataFrame:
    """name, n, denominator, percentage: error tags of incorrect responses, each name once per response."""
    return _with_share(rows.where(_wrong()).select(*_names(_error_names())).select("name", (F.col("at") == 0).alias("first")))


def _error_names() -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.coalesce("error_tags", F.expr("cast(array() as array<struct<dimension:string,name:string,confidence:double>>)")), lambda t: (t["dimension"] == "error") & t["name"].isNotNull()), lambda t: t["name"])))


def _with_share(names: DataFrame) -> DataFrame:
    """name, n, denominator, percentage from one row (name, first) per name of a response and one of a null name where it has none.

    One aggregation counts both the names and the responses (their first rows), so that the rows are read once; the window is
    over one row per name.
    """
    counts = names.groupBy("name").agg(F.count("*").alias("n"), F.count_if("first").alias("firsts"))
    whole = F.sum("firsts").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("denominator", whole).where("name is not null").select("name", "n", "denominator", percentage(F.col("n"), F.col("denominator")).alias("percentage"))


def _names(names: Column) -> list[Column]:
    """first, name of every name of an array, nulls too; one row of a null name for an empty or null array."""
    filled = F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(None).cast("string")))
    return [F.posexplode(filled).alias("at", "name")]


def error_pairs(rows: DataFrame) -> DataFrame:
    """first, second, n, at: pairs of distinct error names of one incorrect response (first < second).

    ``at`` is the least response_id that holds the pair, which orders pairs of one count. The pairs are formed inside
    each response, whose tags are few.
    """
    names = rows.where(_wrong()).select("response_id", _error_names().alias("names"))
    pairs = names.select("response_id", F.explode("names").alias("first"), "names").select("response_id", "first", F.explode("names").alias("second")).where("first < second")
    return pairs.groupBy("first", "second").agg(F.count("*").alias("n"), F.min("response_id").alias("at"))


def question_insight(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """Per question, answered or not: responses, incorrect, scored, lost_score, review_count, incorrect_rate and its rank.

    Here a response marked incorrect counts even when it has no score. ``incorrect_rate`` is by responses, to one place. ``position``
    orders by lost score, incorrect and review count (descending), then by question_id.
    """
    marked = F.col("is_correct").eqNullSafe(F.lit(False))
    got = rows.groupBy("question_id").agg(
        F.count("*").alias("responses"), F.count_if(marked).alias("incorrect"), F.count_if(scored()).alias("scored"),
        F.coalesce(F.sum(F.when(scored(), F.col("max_u") - F.col("score_u"))), F.lit(0)).alias("lost_u"), F.count_if(F.col("review_status").isin("needs_review", "provisional")).alias("review_count"),
    )
    all_ = questions.select("question_id").join(got, "question_id", "left").na.fill(0, ["responses", "incorrect", "scored", "review_count"]).withColumn("lost_u", F.coalesce("lost_u", F.lit(0)))
    rate = F.when(F.col("responses") > 0, py_round(F.try_divide(F.col("incorrect"), F.col("responses")) * 100, 1)).otherwise(0.0)
    ranked = ranked_by(all_, [F.desc("lost_u"), F.desc("incorrect"), F.desc("review_count"), F.asc("question_id")])
    return ranked.select("question_id", "responses", "incorrect", "scored", _points(F.col("lost_u")).alias("lost_score"), "review_count", rate.alias("incorrect_rate"), "position")


def ranked_by(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``position`` (int, from 1) in a total order, without one task that sorts them all.

    The rows are split by ranges of the order and numbered within each; what stands before a range is added from the sizes of the
    ranges, of which there are as many as shuffle partitions. They are kept in the shared folder, so that both readings see the
    same ranges.
    """
    split = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    kept = stored(split.withColumns({"__part": F.shiftrightunsigned("__id", 33).cast("int"), "__nth": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__id"))
    before = Window.partitionBy(F.lit(1)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = kept.groupBy("__part").agg(F.count("*").alias("n")).withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return kept.join(F.broadcast(sizes), "__part").withColumn("position", (F.col("__before") + F.col("__nth") + 1).cast("int")).drop("__part", "__nth", "__before")


def question_errors(rows: DataFrame) -> DataFrame:
    """question_id, name, n, position: error tags over all responses, occurrences as they are, most frequent first."""
    counts = rows.select("question_id", F.explode("error_tags").alias("t")).where("t.name is not null").groupBy("question_id", F.col("t.name").alias("name")).agg(F.count("*").alias("n"))
    return counts.withColumn("position", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("n"), "name")))


def question_examples(rows: DataFrame, most: int = 3) -> DataFrame:
    """question_id, response_id, student_ref, answer, place: the first incorrect responses of each question.

    First by response_id; shown in the order of student and answer. Spark cuts each partition to the first few of
    every question before the shuffle, so a question with a third of all rows costs no more than another.
    """
    wrong = rows.where(F.col("is_correct").eqNullSafe(F.lit(False))).select("question_id", "response_id", "student_ref", F.col("normalized_answer").alias("answer"))
    first = Window.partitionBy("question_id").orderBy("response_id")
    taken = wrong.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most).drop("rank")
    shown = Window.partitionBy("question_id").orderBy(F.asc_nulls_first("student_ref"), F.asc_nulls_first("answer"), "response_id")
    return taken.withColumn("place", F.row_number().over(shown))


def student_summary(rows: DataFrame) -> DataFrame:
    """Per student: attempts, scored_score, scored_max, unscored, incorrect, incorrect_questions, score_rate.

    A missing student is anonymous-student. The rate, to one place, is null where nothing is scored. Questions are counted distinct.
    """
    marked = F.col("is_correct").eqNullSafe(F.lit(False))
    got = rows.groupBy(F.coalesce(F.nullif(F.col("student_ref"), F.lit("")), F.lit("anonymous-student")).alias("student_ref")).agg(
        F.count_distinct("attempt_id").alias("attempts"), _sum(scored(), "score_u").alias("e"), _sum(scored(), "max_u").alias("m"), F.count_if(~scored()).alias("unscored"), F.count_if(marked).alias("incorrect"), F.count_distinct(F.when(marked, F.col("question_id"))).alias("incorrect_questions")
    )
    return got.select("student_ref", "attempts", _points(F.col("e")).alias("scored_score"), _points(F.col("m")).alias("scored_max"), "unscored", "incorrect", "incorrect_questions", F.when(F.col("m") > 0, py_round(F.try_divide(F.col("e").cast("double"), F.col("m").cast("double")) * 100, 1)).alias("score_rate"))


def student_top(rows: DataFrame, names: Column, most: int = 2) -> DataFrame:
    """student_ref, name, n, position: the most frequent of ``names`` (an array) over a student's incorrect responses.

    A missing student is anonymous-student.
    """
    key = F.coalesce(F.nullif(F.col("student_ref"), F.lit("")), F.lit("anonymous-student"))
    marked = rows.where(F.col("is_correct").eqNullSafe(F.lit(False)))
    counts = marked.select(key.alias("student_ref"), F.explode(names).alias("name")).where("name is not null").groupBy("student_ref", "name").agg(F.count("*").alias("n"))
    return counts.withColumn("position", F.row_number().over(Window.partitionBy("student_ref").orderBy(F.desc("n"), "name"))).where(F.col("position") <= most)


def report_metrics(rows: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row: student_count (attempts, as reports count them), class_count, and the figures of :func:`overall`."""
    people = attempts.agg(F.count("*").alias("student_count"), F.count_distinct("class_id").alias("class_count"))
    return people.join(F.broadcast(overall(rows).drop("earned", "possible")))  # one row each
