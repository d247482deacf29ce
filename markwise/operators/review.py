"""The review round trip over flat tables: queue, decisions, and the figures after them.

Tables carry record_id and the keys of :mod:`markwise.operators.nested`. A pair is an attempt_id and a question_id of a record;
where a pair stands for several responses, the last one in the order of the record counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markwise.functions.labels import DEFAULTS, label, question_label
from markwise.functions.numeric import to_decimal
from markwise.functions.text import safe_id

PAIR = ["record_id", "attempt_id", "question_id"]
WAITING = ("needs_review", "provisional")
DECISIONS = ("confirm", "modify", "reject")


def last_of_pair(responses: DataFrame) -> DataFrame:
    """One response per pair, the last in the order of the record. Partial aggregation keeps one per pair before the shuffle."""
    rest = [c for c in responses.columns if c not in PAIR]
    place = ["attempt_pos", "response_pos"]
    kept = responses.groupBy(*PAIR).agg(F.max(F.struct(*place, *[c for c in rest if c not in place])).alias("r"))
    return kept.select(*PAIR, *[F.col(f"r.{c}").alias(c) for c in rest])


def _matched(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join on keys that may be null; null keys match each other."""
    own = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(own, on, how).drop(*[f"__{k}" for k in keys])


def exported(queue: DataFrame, responses: DataFrame, attempts: DataFrame) -> DataFrame:
    """Every item of the queue with its student, answer, score and confidences; nulls where the pair is unknown."""
    students = attempts.select("record_id", "attempt_pos", "student_ref")
    known = last_of_pair(responses).join(students, ["record_id", "attempt_pos"], "left").drop("attempt_pos", "response_pos")
    return _matched(queue, known, PAIR, "left")


def missing(responses: DataFrame, queue: DataFrame) -> DataFrame:
    """record_id, attempt_id, question_id of every pair whose status asks for a review and that no item of the queue names."""
    wanted = responses.where(F.col("review_status").isin(*WAITING)).select(*PAIR).distinct()
    return _matched(wanted, queue.select(*PAIR), PAIR, "left_anti")


def unknown(queue: DataFrame, attempts: DataFrame, questions: DataFrame) -> DataFrame:
    """record_id, review_pos, side of every item of the queue whose attempt or question its record does not hold."""
    lost = lambda table, key: _matched(queue, table.select("record_id", key).distinct(), ["record_id", key], "left_anti").select("record_id", "review_pos", F.lit(key).alias("side"))
    return lost(attempts, "attempt_id").unionByName(lost(questions, "question_id"))


def items(export: DataFrame, questions: DataFrame) -> DataFrame:
    """The exported queue as reports show it: question label and number, greatest score, reasons with their labels, and a place.

    Ordered within each record by question number (unknown ones last), student, attempt and reasons.
    """
    numbered = questions.groupBy("record_id", "question_id").agg(F.max(F.struct((F.col("question_pos") + 1).alias("number"), "max_score")).alias("q"))
    rows = _matched(export, numbered, ["record_id", "question_id"], "left")
    codes = F.array_sort(F.coalesce(F.from_json("reasons", "array<string>"), F.array().cast("array<string>")))
    order = Window.partitionBy("record_id").orderBy(F.coalesce("q.number", F.lit(10**9)), F.coalesce("student_ref", F.lit("")), F.coalesce("attempt_id", F.lit("")), "codes", "review_pos")
    rows = rows.withColumn("codes", codes)
    return rows.select(
        "record_id", F.row_number().over(order).alias("place"), "attempt_id", "student_ref", "question_id", question_label(F.col("q.number")).alias("question"), "score", F.col("q.max_score").alias("max_score"),
        F.array_join("codes", "|").alias("reason_codes"), F.array_join(F.transform("codes", lambda c: label("review_reason", c)), "|").alias("reasons"),
    )


def bound(decisions: DataFrame, documents: DataFrame, by: tuple[str, ...] = ("organization_id", "analysis_id", "state_hash")) -> DataFrame:
    """record_id, field of every decision document that is bound to another state of its document."""
    theirs = documents.select("record_id", *[F.col(c).alias(f"__{c}") for c in by])
    wrong = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in by]))
    return decisions.join(theirs, "record_id", "left").select("record_id", F.explode(wrong).alias("field"))


def decision_faults(decisions: DataFrame, queue: DataFrame, responses: DataFrame, questions: DataFrame) -> DataFrame:
    """record_id, at, fault: the first thing that is wrong with each decision; none for sound ones.

    In this order: the pair is not in the open queue, the response is unknown, the decision is no known one, the reason is
    empty, the actor gives no identifier, a modified score lies outside the question's range. A queue without a status is open.
    """
    open_ = queue.where((F.col("status") == "open") if "status" in queue.columns else F.lit(True)).select(*PAIR).distinct().withColumn("__open", F.lit(True))
    known = responses.select(*PAIR).distinct().withColumn("__known", F.lit(True))
    top = questions.groupBy("record_id", "question_id").agg(F.max(to_decimal(F.col("max_score"))).alias("__max"))
    rows = _matched(_matched(_matched(decisions, open_, PAIR, "left"), known, PAIR, "left"), top, ["record_id", "question_id"], "left")
    score = to_decimal(F.col("score"))
    no = lambda c: F.coalesce(c, F.lit(False))
    outside = score.isNull() | (score < 0) | (score > F.coalesce("__max", F.lit(0)))
    fault = (
        F.when(~no(F.col("__open")), "not in the open queue")
        .when(~no(F.col("__known")), "unknown response")
        .when(~no(F.col("decision").isin(*DECISIONS)), "decision")
        .when(F.coalesce("reason", F.lit("")) == "", "reason")
        .when(safe_id(F.col("actor_ref"), F.lit("")) == "", "actor")
        .when((F.col("decision") == "modify") & F.col("score").isNotNull() & outside, "score")
    )
    return rows.select("record_id", "at", fault.alias("fault")).where("fault is not null")


def applied(responses: DataFrame, decisions: DataFrame) -> DataFrame:
    """record_id, attempt_id, question_id, at, score_before, score_after, status_before, status_after of every sound decision.

    Decisions on one pair chain in their order: each starts from what the one before it left. A modification without a score
    keeps it; a rejection rejects, everything else confirms.
    """
    start = last_of_pair(responses).select(*PAIR, to_decimal(F.col("score")).alias("__score"), F.col("review_status").alias("__status"))
    rows = _matched(decisions, start, PAIR, "left").withColumn("__new", F.when(F.col("decision") == "modify", to_decimal(F.col("score"))))
    chain = Window.partitionBy(*PAIR).orderBy("at")
    after = F.coalesce(F.last("__new", ignorenulls=True).over(chain), F.col("__score"))
    status = F.when(F.col("decision") == "reject", "rejected").otherwise("teacher_confirmed")
    done = rows.withColumns({"__after": after, "__to": status})
    return done.select(
        *PAIR, "at", F.when(F.row_number().over(chain) == 1, F.col("__score")).otherwise(F.lag("__after").over(chain)).cast("double").alias("score_before"), F.col("__after").cast("double").alias("score_after"),
        F.coalesce(F.lag("__to").over(chain), F.col("__status")).alias("status_before"), F.col("__to").alias("status_after"),
    )


def _rounded(value: Column) -> Column:
    return F.round(value.cast("decimal(38,6)"), 2).cast("double")


def final_scores(attempts: DataFrame, responses: DataFrame, questions: DataFrame, queue: DataFrame, decided: DataFrame) -> DataFrame:
    """Per record and student: score, maximum, rate, remaining, unscored, ready, after the decisions.

    ``decided`` has a pair and score, one row per pair of the queue that was decided. A decided item that had no score adds its
    score and its greatest score and is not unscored any more; one that had a score is replaced. ``remaining`` counts the items
    of the queue without a decision; a student is ready without remaining and unscored ones. Responses to unknown questions do
    not count. A missing student is anonymous-student. The rate, to two places, is null without any greatest score.
    """
    key = F.coalesce(F.nullif(F.col("student_ref"), F.lit("")), F.lit("anonymous-student"))
    people = attempts.select("record_id", "attempt_pos", "attempt_id", key.alias("student_ref"))
    top = questions.groupBy("record_id", "question_id").agg(F.max(F.coalesce(to_decimal(F.col("max_score")), F.lit(0).cast("decimal(20,6)"))).alias("top"))
    rows = responses.join(people.drop("attempt_id"), ["record_id", "attempt_pos"]).join(top, ["record_id", "question_id"]).withColumn("own", to_decimal(F.col("score")))
    first = rows.groupBy("record_id", "student_ref").agg(F.sum("own").alias("s"), F.sum(F.when(F.col("own").isNotNull(), F.col("top"))).alias("m"), F.count_if(F.col("own").isNull()).alias("u"))
    # an item of the queue belongs to the student of its attempt (of repeated ids the last one)
    owner = attempts.groupBy("record_id", "attempt_id").agg(F.max(F.struct("attempt_pos", key.alias("student_ref"))).alias("o")).select("record_id", "attempt_id", "o.student_ref")
    last = last_of_pair(responses).select(*PAIR, to_decimal(F.col("score")).alias("own"))
    queued = _matched(_matched(_matched(queue.select("review_pos", *PAIR), owner, ["record_id", "attempt_id"], "inner"), last, PAIR, "left"), top, ["record_id", "question_id"], "left")
    queued = _matched(queued, decided.select(*PAIR, to_decimal(F.col("score")).alias("new"), F.lit(True).alias("done")), PAIR, "left")
    change = queued.groupBy("record_id", "student_ref").agg(
        F.sum(F.when(F.col("done"), F.col("new") - F.coalesce("own", F.lit(0)))).alias("ds"), F.sum(F.when(F.col("done") & F.col("own").isNull(), F.coalesce("top", F.lit(0)))).alias("dm"),
        F.count_if(F.col("done") & F.col("own").isNull()).alias("du"), F.count_if(F.col("done").isNull()).alias("remaining"),
    )
    nil = lambda c: F.coalesce(c, F.lit(0))
    all_ = people.select("record_id", "student_ref").distinct().join(first, ["record_id", "student_ref"], "left").join(change, ["record_id", "student_ref"], "left")
    score, most = nil(F.col("s")) + nil(F.col("ds")), nil(F.col("m")) + nil(F.col("dm"))
    unscored = F.greatest(nil(F.col("u")) - nil(F.col("du")), F.lit(0)).cast("bigint")
    rate = F.when(most > 0, _rounded(score.cast("double") / most.cast("double") * 100))
    remaining = nil(F.col("remaining")).cast("bigint")
    return all_.select("record_id", "student_ref", _rounded(score).alias("score"), _rounded(most).alias("maximum"), rate.alias("rate"), remaining.alias("remaining"), unscored.alias("unscored"), ((remaining == 0) & (unscored == 0)).alias("ready"))


def final_incorrect(attempts: DataFrame, responses: DataFrame, questions: DataFrame, decided: DataFrame) -> DataFrame:
    """record_id, student_ref, questions: the numbers of the questions a student has wrong after the decisions, in order.

    A scored response below the greatest score is wrong; a decided pair counts by its decision.
    """
    key = F.coalesce(F.nullif(F.col("student_ref"), F.lit("")), F.lit("anonymous-student"))
    numbered = questions.groupBy("record_id", "question_id").agg(F.max(F.struct((F.col("question_pos") + 1).alias("number"), to_decimal(F.col("max_score")).alias("top"))).alias("q"))
    rows = responses.join(attempts.select("record_id", "attempt_pos", key.alias("student_ref")), ["record_id", "attempt_pos"]).join(numbered, ["record_id", "question_id"])
    rows = _matched(rows, decided.select(*PAIR, to_decimal(F.col("score")).alias("new")), PAIR, "left")
    wrong = rows.where(F.coalesce("new", to_decimal(F.col("score"))) < F.coalesce("q.top", F.lit(0)))
    return wrong.groupBy("record_id", "student_ref").agg(F.array_join(F.transform(F.array_sort(F.collect_set("q.number")), lambda n: n.cast("string")), ",").alias("questions"))


def remaining(queue: DataFrame, decided: DataFrame) -> DataFrame:
    """record_id, items, decided, remaining: how far each queue has come."""
    done = _matched(queue.select("review_pos", *PAIR), decided.select(*PAIR, F.lit(True).alias("done")), PAIR, "left")
    return done.groupBy("record_id").agg(F.count("*").alias("items"), F.count("done").alias("decided"), F.count_if(F.col("done").isNull()).alias("remaining"))


def confirmed(item_score: Column, score: Column, top: Column) -> Column:
    """confirm, modify or null: what entering ``score`` for an item means; null where it is no score within the range."""
    new, old = to_decimal(score), to_decimal(item_score)
    sound = new.isNotNull() & (new >= 0) & (new <= to_decimal(top))
    return F.when(sound, F.when(old.eqNullSafe(new), "confirm").otherwise("modify"))


def review_csv(item_rows: DataFrame, decided: DataFrame, names: DataFrame) -> DataFrame:
    """The review list for people: student, question, score, maximum, final score, state, reasons, all as text."""
    rows = item_rows.join(decided.select(*PAIR, F.col("score").alias("final"), "decision"), PAIR, "left").join(names.select("student_ref", "name"), "student_ref", "left")
    state = F.when(F.col("decision").isNull(), "待复核").when(F.col("decision") == "modify", "已修改并确认").otherwise("已确认原分")
    return rows.select(F.coalesce("name", F.lit(DEFAULTS["student"])).alias("学生姓名"), F.col("question").alias("题目"), F.col("score").alias("原分数"), F.col("max_score").alias("满分"), F.coalesce(F.col("final").cast("string"), F.lit("")).alias("最终分数"), state.alias("复核状态"), F.col("reasons").alias("原因"))
