"""Queries of the review round trip over the class records, each with its SQL.

The records hold the decisions of teachers as teacher_review of a response (decision, actor_ref, before, after). They are what is
applied here: a decision on the pair of its response, with the score that ``after`` names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markwise.functions import labels
from markwise.operators import nested, review
from markwise.plans.data_queries import NESTED, list_sql
from markwise.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    """Registers a query and its SQL under its function's name."""

    def put(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[function.__name__], SQL[function.__name__] = function, sql
        return function

    return put


class Records:
    """The flat tables of a folder's class records."""

    def __init__(self, spark: SparkSession, folder: str):
        tables = nested.class_tables(table(spark, folder, "class_records"))
        self.attempts, self.responses = tables["attempts"], tables["attempts.responses"]
        self.evidence, self.tags = tables["attempts.responses.evidence"], tables["attempts.responses.error_tags"]
        self.questions, self.queue, self.records = tables["paper.questions"], tables["review_queue"], tables[""]

    def decisions(self) -> DataFrame:
        """One decision per response that a teacher reviewed, in the order of the record (``at``)."""
        of = lambda path: F.get_json_object("teacher_review", path)
        rows = self.responses.where(F.get_json_object("teacher_review", "$.decision").isNotNull())
        return rows.select("record_id", "attempt_id", "question_id", (F.col("attempt_pos") * 100_000 + F.col("response_pos")).alias("at"), of("$.decision").alias("decision"), of("$.reason").alias("reason"), of("$.actor_ref").alias("actor_ref"), of("$.after.score").alias("score"))

    def decided(self) -> DataFrame:
        """The last decided score of every pair; a rejection, or one without a score, decides none."""
        rows = self.decisions().where("decision <> 'reject' and score is not null")
        return rows.groupBy("record_id", "attempt_id", "question_id").agg(F.max_by("score", "at").alias("score"))


REVIEW = (
    NESTED
    + f""", q0 AS (SELECT record_id, unnest(l) AS x, CAST(unnest(range(len(l))) AS INT) AS question_pos FROM (SELECT record_id, {list_sql("p", "$.paper.questions")} AS l FROM c)),
q AS (SELECT *, x ->> '$.question_id' AS question_id, TRY_CAST(x ->> '$.max_score' AS DECIMAL(20,6)) AS top FROM q0 WHERE json_type(x) = 'OBJECT'),
n AS (SELECT record_id, question_id, max(question_pos + 1) AS number, arg_max(x ->> '$.max_score', question_pos) AS max_score, arg_max(top, question_pos) AS top FROM q GROUP BY ALL),
w0 AS (SELECT record_id, unnest(l) AS x, CAST(unnest(range(len(l))) AS INT) AS review_pos FROM (SELECT record_id, {list_sql("p", "$.review_queue")} AS l FROM c)),
w AS (SELECT record_id, review_pos, x ->> '$.attempt_id' AS attempt_id, x ->> '$.question_id' AS question_id, x ->> '$.reasons' AS reasons FROM w0 WHERE json_type(x) = 'OBJECT'),
s AS (SELECT r.record_id, r.attempt_id, r.question_id, r.attempt_pos, r.response_pos, r.x ->> '$.normalized_answer' AS answer, r.x ->> '$.score' AS score, TRY_CAST(r.x ->> '$.score' AS DECIMAL(20,6)) AS own, r.x ->> '$.confidence.ocr' AS ocr, r.x ->> '$.review_status' AS status,
  r.x ->> '$.teacher_review.decision' AS decision, r.x ->> '$.teacher_review.reason' AS reason, r.x ->> '$.teacher_review.actor_ref' AS actor_ref, TRY_CAST(r.x ->> '$.teacher_review.after.score' AS DECIMAL(20,6)) AS new,
  a.x ->> '$.student_ref' AS student_ref FROM r JOIN a USING (record_id, attempt_pos)),
l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY record_id, attempt_id, question_id ORDER BY attempt_pos DESC, response_pos DESC) = 1),
d AS (SELECT record_id, attempt_id, question_id, arg_max(new, (attempt_pos, response_pos)) AS new FROM s WHERE decision <> 'reject' AND new IS NOT NULL GROUP BY ALL)
"""
)


@query(
    REVIEW
    + """SELECT w.record_id, review_pos, w.attempt_id, w.question_id, reasons, student_ref, answer, score, ocr, status AS review_status FROM w LEFT JOIN l
ON w.record_id = l.record_id AND w.attempt_id IS NOT DISTINCT FROM l.attempt_id AND w.question_id IS NOT DISTINCT FROM l.question_id"""
)
def review_export(spark: SparkSession, folder: str) -> DataFrame:
    """The review queues with student, answer and score of each item."""
    t = Records(spark, folder)
    got = review.exported(t.queue.drop("rest"), t.responses, t.attempts)
    return got.select("record_id", "review_pos", "attempt_id", "question_id", "reasons", "student_ref", F.col("normalized_answer").alias("answer"), "score", F.col("confidence_ocr").alias("ocr"), "review_status")


@query(REVIEW + "SELECT DISTINCT record_id, attempt_id, question_id FROM s WHERE status IN ('needs_review', 'provisional') AND NOT EXISTS (FROM w WHERE w.record_id = s.record_id AND w.attempt_id IS NOT DISTINCT FROM s.attempt_id AND w.question_id IS NOT DISTINCT FROM s.question_id)")
def review_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs that ask for a review and stand in no queue."""
    t = Records(spark, folder)
    return review.missing(t.responses, t.queue)


@query(
    REVIEW
    + """SELECT record_id, review_pos, 'attempt_id' AS side FROM w WHERE NOT EXISTS (FROM a WHERE a.record_id = w.record_id AND a.attempt_id IS NOT DISTINCT FROM w.attempt_id)
UNION ALL SELECT record_id, review_pos, 'question_id' FROM w WHERE NOT EXISTS (FROM q WHERE q.record_id = w.record_id AND q.question_id IS NOT DISTINCT FROM w.question_id)"""
)
def review_unknown(spark: SparkSession, folder: str) -> DataFrame:
    """Items of the queues whose attempt or question the record does not hold."""
    t = Records(spark, folder)
    return review.unknown(t.queue, t.attempts, t.questions)


_REASON_SQL = "CASE u " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.LABELS["review_reason"].items()) + f" ELSE '{labels.DEFAULTS['review_reason']}' END"


@query(
    REVIEW
    + f""", g AS (SELECT w.record_id, review_pos, w.attempt_id, w.question_id, student_ref, score, number, max_score, list_sort(coalesce(CAST(CAST(reasons AS JSON) AS VARCHAR[]), [])) AS codes FROM w LEFT JOIN l
ON w.record_id = l.record_id AND w.attempt_id IS NOT DISTINCT FROM l.attempt_id AND w.question_id IS NOT DISTINCT FROM l.question_id LEFT JOIN n ON n.record_id = w.record_id AND n.question_id IS NOT DISTINCT FROM w.question_id)
SELECT record_id, CAST(row_number() OVER (PARTITION BY record_id ORDER BY coalesce(number, 1000000000), coalesce(student_ref, ''), coalesce(attempt_id, ''), codes, review_pos) AS INT) AS place, attempt_id, student_ref, question_id,
coalesce('第 ' || number || ' 题', '题号待确认') AS question, score, max_score, array_to_string(codes, '|') AS reason_codes, array_to_string(list_transform(codes, lambda u: {_REASON_SQL}), '|') AS reasons FROM g"""
)
def review_items(spark: SparkSession, folder: str) -> DataFrame:
    """The review queues as reports show them."""
    t = Records(spark, folder)
    return review.items(review.exported(t.queue.drop("rest"), t.responses, t.attempts), t.questions)


@query(
    REVIEW
    + """SELECT record_id, attempt_pos * 100000 + response_pos AS at, CASE WHEN NOT EXISTS (FROM w WHERE w.record_id = s.record_id AND w.attempt_id IS NOT DISTINCT FROM s.attempt_id AND w.question_id IS NOT DISTINCT FROM s.question_id) THEN 'not in the open queue'
WHEN decision NOT IN ('confirm', 'modify', 'reject') THEN 'decision' WHEN coalesce(reason, '') = '' THEN 'reason' WHEN NOT regexp_matches(coalesce(actor_ref, ''), '[A-Za-z0-9]') THEN 'actor'
WHEN decision = 'modify' AND (new < 0 OR new > coalesce((SELECT top FROM n WHERE n.record_id = s.record_id AND n.question_id = s.question_id), 0)) THEN 'score' END AS fault FROM s WHERE decision IS NOT NULL AND fault IS NOT NULL"""
)
def review_decision_faults(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with each decision of a teacher."""
    t = Records(spark, folder)
    return review.decision_faults(t.decisions(), t.queue.drop("rest"), t.responses, t.questions)


@query(
    REVIEW
    + """, k AS (SELECT s.record_id, s.attempt_id, s.question_id, s.attempt_pos * 100000 + s.response_pos AS spot, s.decision, CASE WHEN s.decision = 'modify' THEN s.new END AS changed, l.own AS first_score, l.status AS began,
CASE WHEN s.decision = 'reject' THEN 'rejected' ELSE 'teacher_confirmed' END AS state FROM s JOIN l ON s.record_id = l.record_id AND s.attempt_id IS NOT DISTINCT FROM l.attempt_id AND s.question_id IS NOT DISTINCT FROM l.question_id WHERE s.decision IS NOT NULL),
f AS (SELECT *, coalesce(last_value(changed IGNORE NULLS) OVER (PARTITION BY record_id, attempt_id, question_id ORDER BY spot), first_score) AS later FROM k)
SELECT record_id, attempt_id, question_id, spot AS "at", CAST(CASE WHEN row_number() OVER chain = 1 THEN first_score ELSE lag(later) OVER chain END AS DOUBLE) AS score_before, CAST(later AS DOUBLE) AS score_after, coalesce(lag(state) OVER chain, began) AS status_before, state AS status_after
FROM f WINDOW chain AS (PARTITION BY record_id, attempt_id, question_id ORDER BY spot)"""
)
def review_applied(spark: SparkSession, folder: str) -> DataFrame:
    """Scores and states before and after each decision of a teacher."""
    t = Records(spark, folder)
    return review.applied(t.responses, t.decisions())


@query(
    REVIEW
    + """, people AS (SELECT DISTINCT record_id, coalesce(nullif(x ->> '$.student_ref', ''), 'anonymous-student') AS student_ref FROM a),
f AS (SELECT s.record_id, coalesce(nullif(student_ref, ''), 'anonymous-student') AS student_ref, sum(own) AS s, sum(coalesce(top, 0)) FILTER (own IS NOT NULL) AS m, count(*) FILTER (own IS NULL) AS u FROM s JOIN n USING (record_id, question_id) GROUP BY ALL),
o AS (SELECT record_id, attempt_id, arg_max(coalesce(nullif(x ->> '$.student_ref', ''), 'anonymous-student'), attempt_pos) AS student_ref FROM a GROUP BY ALL),
g AS (SELECT w.record_id, o.student_ref, l.own, coalesce(n.top, 0) AS top, d.new FROM w JOIN o ON o.record_id = w.record_id AND o.attempt_id IS NOT DISTINCT FROM w.attempt_id LEFT JOIN l ON l.record_id = w.record_id AND l.attempt_id IS NOT DISTINCT FROM w.attempt_id AND l.question_id IS NOT DISTINCT FROM w.question_id
  LEFT JOIN n ON n.record_id = w.record_id AND n.question_id IS NOT DISTINCT FROM w.question_id LEFT JOIN d ON d.record_id = w.record_id AND d.attempt_id IS NOT DISTINCT FROM w.attempt_id AND d.question_id IS NOT DISTINCT FROM w.question_id),
h AS (SELECT record_id, student_ref, sum(new - coalesce(own, 0)) AS ds, sum(top) FILTER (new IS NOT NULL AND own IS NULL) AS dm, count(*) FILTER (new IS NOT NULL AND own IS NULL) AS du, count(*) FILTER (new IS NULL) AS remaining FROM g GROUP BY ALL),
z AS (SELECT record_id, student_ref, coalesce(s, 0) + coalesce(ds, 0) AS score, coalesce(m, 0) + coalesce(dm, 0) AS maximum, coalesce(remaining, 0) AS remaining, greatest(coalesce(u, 0) - coalesce(du, 0), 0) AS unscored FROM people LEFT JOIN f USING (record_id, student_ref) LEFT JOIN h USING (record_id, student_ref))
SELECT record_id, student_ref, CAST(round(score, 2) AS DOUBLE) AS score, CAST(round(maximum, 2) AS DOUBLE) AS maximum, CASE WHEN maximum > 0 THEN CAST(round(CAST(CAST(score AS DOUBLE) / CAST(maximum AS DOUBLE) * 100 AS DECIMAL(38,6)), 2) AS DOUBLE) END AS rate, remaining, unscored, remaining = 0 AND unscored = 0 AS ready FROM z"""
)
def review_final_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The scores of every student of a record after the decisions."""
    t = Records(spark, folder)
    return review.final_scores(t.attempts, t.responses, t.questions, t.queue, t.decided())


@query(
    REVIEW
    + """SELECT s.record_id, coalesce(nullif(student_ref, ''), 'anonymous-student') AS student_ref, array_to_string(list_sort(list(DISTINCT number)), ',') AS questions FROM s JOIN n USING (record_id, question_id)
LEFT JOIN d ON d.record_id = s.record_id AND d.attempt_id IS NOT DISTINCT FROM s.attempt_id AND d.question_id IS NOT DISTINCT FROM s.question_id WHERE coalesce(d.new, own) < coalesce(top, 0) GROUP BY ALL"""
)
def review_final_incorrect(spark: SparkSession, folder: str) -> DataFrame:
    """The questions that every student of a record has wrong after the decisions."""
    t = Records(spark, folder)
    return review.final_incorrect(t.attempts, t.responses, t.questions, t.decided())


@query(
    REVIEW
    + """SELECT w.record_id, count(*) AS items, count(new) AS decided, count(*) FILTER (new IS NULL) AS remaining FROM w
LEFT JOIN d ON d.record_id = w.record_id AND d.attempt_id IS NOT DISTINCT FROM w.attempt_id AND d.question_id IS NOT DISTINCT FROM w.question_id GROUP BY 1"""
)
def review_remaining(spark: SparkSession, folder: str) -> DataFrame:
    """How far the review of each record has come."""
    t = Records(spark, folder)
    return review.remaining(t.queue, t.decided())


@query(REVIEW + "SELECT record_id, question_id, number, '第 ' || number || ' 题' AS label, max_score FROM n")
def paper_questions(spark: SparkSession, folder: str) -> DataFrame:
    """The questions of every record's paper with their number and label."""
    rows = Records(spark, folder).questions.groupBy("record_id", "question_id").agg(F.max(F.struct((F.col("question_pos") + 1).alias("number"), "max_score")).alias("q"))
    return rows.select("record_id", "question_id", "q.number", labels.question_label(F.col("q.number")).alias("label"), "q.max_score")


_FINAL = SQL["review_final_scores"].rsplit("SELECT", 1)
EXPORT_FINAL = (
    _FINAL[0]
    + ", fin AS (SELECT"
    + _FINAL[1]
    + """), bad AS (SELECT s.record_id, coalesce(nullif(student_ref, ''), 'anonymous-student') AS student_ref, array_to_string(list_transform(list_sort(list(DISTINCT number)), lambda i: '第 ' || i || ' 题'), '、') AS questions FROM s JOIN n USING (record_id, question_id)
LEFT JOIN d ON d.record_id = s.record_id AND d.attempt_id IS NOT DISTINCT FROM s.attempt_id AND d.question_id IS NOT DISTINCT FROM s.question_id WHERE coalesce(d.new, own) < coalesce(top, 0) GROUP BY ALL)
SELECT record_id, student_ref, coalesce(questions, '无') AS wrong_questions, score, maximum, rate, remaining, unscored, CASE WHEN ready THEN '可发布' ELSE '暂不可发布' END AS state FROM fin LEFT JOIN bad USING (record_id, student_ref)"""
)


@query(EXPORT_FINAL)
def export_final(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the final score list of every record."""
    t = Records(spark, folder)
    decided = t.decided()
    wrong = review.final_incorrect(t.attempts, t.responses, t.questions, decided)
    named = F.array_join(F.transform(F.split("questions", ","), lambda n: labels.question_label(n)), "、")
    rows = review.final_scores(t.attempts, t.responses, t.questions, t.queue, decided).join(wrong, ["record_id", "student_ref"], "left")
    return rows.select("record_id", "student_ref", F.coalesce(named, F.lit("无")).alias("wrong_questions"), "score", "maximum", "rate", "remaining", "unscored", F.when(F.col("ready"), "可发布").otherwise("暂不可发布").alias("state"))


@query(
    REVIEW
    + """SELECT s.record_id, c.p ->> '$.organization_id' AS organization_id, c.p ->> '$.analysis_id' AS analysis_id, count(*) AS decisions,
string_agg(s.attempt_id || '::' || s.question_id || '=' || s.decision, '|' ORDER BY s.attempt_id || '::' || s.question_id || '=' || s.decision) AS listed FROM s JOIN c USING (record_id) WHERE decision IS NOT NULL GROUP BY ALL"""
)
def export_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """The decisions of every record by key, bound to its organisation and analysis."""
    t = Records(spark, folder)
    line = F.concat("attempt_id", F.lit("::"), "question_id", F.lit("="), "decision")
    rows = t.decisions().groupBy("record_id").agg(F.count("*").alias("decisions"), F.array_join(F.array_sort(F.collect_list(line)), "|").alias("listed"))  # the reviewed responses of one record
    return rows.join(t.records.select("record_id", "organization_id", "analysis_id"), "record_id").select("record_id", "organization_id", "analysis_id", "decisions", "listed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return dict(SQL)
