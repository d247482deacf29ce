"""Queries of the exam analytics operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markwise.functions import hashing, labels, text, vectors
from markwise.functions.numeric import percentage
from markwise.operators import answers, audit, changes, graph, migration, statistics, validation, vocabulary
from markwise.plans import data_queries
from markwise.plans.exam_views import BASE, attempts, joined, percent_sql, placed, questions, responses, round_sql
from markwise.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name."""

    def put(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return put


# --- statistics ---------------------------------------------------------------------------------------------------


@query(
    BASE
    + f"""
, t AS (SELECT count(*) AS n, count(*) FILTER (score_u IS NOT NULL) AS s, count(*) FILTER (score_u IS NOT NULL AND is_correct = false) AS w,
        coalesce(sum(score_u), 0) AS e, coalesce(sum(max_u) FILTER (score_u IS NOT NULL), 0) AS m FROM j)
SELECT n AS responses, s AS scored, n - s AS unscored, w AS incorrect, {percent_sql("w", "s")} AS incorrect_rate, CAST(e AS DOUBLE) / 1000000 AS earned, CAST(m AS DOUBLE) / 1000000 AS possible, {percent_sql("e", "m")} AS score_rate FROM t
"""
)
def overall_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Totals and rates over all responses."""
    return statistics.overall(joined(spark, folder, "is_correct"))


@query(BASE + "SELECT coalesce(difficulty, 'unknown') AS difficulty, count(*) AS n FROM j GROUP BY 1")
def difficulty_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Responses by difficulty."""
    return statistics.difficulty_distribution(joined(spark, folder, "question_id"))


@query(
    BASE
    + """SELECT coalesce(nullif(class_id, ''), 'unassigned') AS class_id, count(*) AS responses, count(*) FILTER (score_u IS NOT NULL) AS scored,
count(*) FILTER (score_u IS NOT NULL AND is_correct = false) AS incorrect FROM p GROUP BY 1"""
)
def class_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Responses, scored and incorrect ones of each class."""
    return statistics.class_summary(placed(spark, folder, "is_correct"))


def _tags_sql(dimension: str) -> str:
    return (
        BASE
        + f""", w AS (SELECT * FROM j WHERE score_u IS NOT NULL AND is_correct = false), d AS (SELECT count(*) AS denominator FROM w),
t AS (SELECT u.name AS name, count(*) AS n FROM (SELECT unnest(tags) AS u FROM w) WHERE u.dimension = '{dimension}' GROUP BY 1)
SELECT name, n, denominator, {percent_sql("n", "denominator")} AS percentage FROM t, d"""
    )


@query(_tags_sql("knowledge"))
def knowledge_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Knowledge tags of incorrect responses."""
    return statistics.tag_distribution(joined(spark, folder, "is_correct"), "knowledge")


@query(_tags_sql("cognitive"))
def cognitive_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Cognitive tags of incorrect responses."""
    return statistics.tag_distribution(joined(spark, folder, "is_correct"), "cognitive")


NAMES = """, w AS (SELECT * FROM j WHERE score_u IS NOT NULL AND is_correct = false), d AS (SELECT count(*) AS denominator FROM w),
n AS (SELECT DISTINCT response_id, u.name AS name FROM (SELECT response_id, unnest(error_tags) AS u FROM w) WHERE u.dimension = 'error' AND u.name IS NOT NULL)
"""


@query(BASE + NAMES + f", c AS (SELECT name, count(*) AS n FROM n GROUP BY 1) SELECT name, n, denominator, {percent_sql('n', 'denominator')} AS percentage FROM c, d")
def error_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Error tags of incorrect responses, each once per response."""
    return statistics.error_distribution(joined(spark, folder, "is_correct", "error_tags"))


@query(BASE + NAMES + 'SELECT x.name AS "first", y.name AS "second", count(*) AS n, min(x.response_id) AS at FROM n x JOIN n y ON x.response_id = y.response_id AND x.name < y.name GROUP BY 1, 2')
def error_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Error tags that occur together."""
    return statistics.error_pairs(joined(spark, folder, "is_correct", "error_tags"))


# --- questions and students ---------------------------------------------------------------------------------------


@query(
    BASE
    + f""", g AS (SELECT q.question_id, count(j.response_id) AS responses, count(*) FILTER (j.is_correct = false) AS incorrect, count(*) FILTER (j.score_u IS NOT NULL) AS scored,
coalesce(sum(j.max_u - j.score_u) FILTER (j.score_u IS NOT NULL), 0) AS lost_u, count(*) FILTER (j.review_status IN ('needs_review', 'provisional')) AS review_count
FROM questions q LEFT JOIN j USING (question_id) GROUP BY 1)
SELECT question_id, responses, incorrect, scored, CAST(lost_u AS DOUBLE) / 1000000 AS lost_score, review_count, CASE WHEN responses > 0 THEN {round_sql("CAST(incorrect AS DOUBLE) / responses * 100")} ELSE 0.0 END AS incorrect_rate,
CAST(row_number() OVER (ORDER BY lost_u DESC, incorrect DESC, review_count DESC, question_id) AS INT) AS "position" FROM g"""
)
def question_insight(spark: SparkSession, folder: str) -> DataFrame:
    """Every question with its figures and its place in the order of priority."""
    return statistics.question_insight(questions(spark, folder), joined(spark, folder, "is_correct", "review_status"))


@query(
    BASE
    + """, c AS (SELECT question_id, u.name AS name, count(*) AS n FROM (SELECT question_id, unnest(error_tags) AS u FROM j) WHERE u.name IS NOT NULL GROUP BY ALL)
SELECT question_id, name, n, CAST(row_number() OVER (PARTITION BY question_id ORDER BY n DESC, name) AS INT) AS "position" FROM c"""
)
def question_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Error tags of every question by frequency."""
    return statistics.question_errors(joined(spark, folder, "error_tags"))


@query(
    BASE
    + """, f AS (SELECT question_id, response_id, student_ref, normalized_answer AS answer FROM p WHERE is_correct = false QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY response_id) <= 3)
SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY student_ref NULLS FIRST, answer NULLS FIRST, response_id) AS INT) AS place FROM f"""
)
def question_examples(spark: SparkSession, folder: str) -> DataFrame:
    """The first incorrect responses of every question."""
    return statistics.question_examples(placed(spark, folder, "is_correct", "normalized_answer"))


@query(
    """SELECT question_id, list_sort(list_distinct(list_transform(list_filter(tags, lambda t: t.dimension = 'knowledge' AND t.name <> ''), lambda t: coalesce(CASE t.name """
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.LABELS["knowledge"].items())
    + """ END, '自定义知识点')))) AS labels FROM questions"""
)
def question_knowledge(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct labels of the knowledge tags of every question."""
    mine = F.filter("tags", lambda t: (t["dimension"] == "knowledge") & (t["name"] != ""))
    return questions(spark, folder).select("question_id", F.array_sort(F.array_distinct(F.transform(mine, lambda t: labels.label("knowledge", t["name"])))).alias("labels"))


@query(
    BASE
    + f""", g AS (SELECT coalesce(nullif(student_ref, ''), 'anonymous-student') AS student_ref, count(DISTINCT attempt_id) AS attempts, coalesce(sum(score_u), 0) AS e, coalesce(sum(max_u) FILTER (score_u IS NOT NULL), 0) AS m,
count(*) FILTER (score_u IS NULL) AS unscored, count(*) FILTER (is_correct = false) AS incorrect, count(DISTINCT question_id) FILTER (is_correct = false) AS incorrect_questions FROM p GROUP BY 1)
SELECT student_ref, attempts, CAST(e AS DOUBLE) / 1000000 AS scored_score, CAST(m AS DOUBLE) / 1000000 AS scored_max, unscored, incorrect, incorrect_questions, CASE WHEN m > 0 THEN {round_sql("CAST(e AS DOUBLE) / CAST(m AS DOUBLE) * 100")} END AS score_rate FROM g"""
)
def student_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Figures of every student over all attempts."""
    return statistics.student_summary(placed(spark, folder, "is_correct"))


def _top_sql(array: str, condition: str) -> str:
    return (
        BASE
        + f""", c AS (SELECT student_ref, u.name AS name, count(*) AS n FROM (SELECT coalesce(student_ref, 'anonymous-student') AS student_ref, unnest({array}) AS u FROM p WHERE is_correct = false) WHERE u.name IS NOT NULL AND {condition} GROUP BY ALL)
SELECT student_ref, name, n, CAST(row_number() OVER (PARTITION BY student_ref ORDER BY n DESC, name) AS INT) AS "position" FROM c QUALIFY row_number() OVER (PARTITION BY student_ref ORDER BY n DESC, name) <= 2"""
    )


@query(_top_sql("error_tags", "true"))
def student_top_errors(spark: SparkSession, folder: str) -> DataFrame:
    """The two most frequent error tags of every student."""
    return statistics.student_top(placed(spark, folder, "is_correct", "error_tags"), F.transform("error_tags", lambda t: t["name"]))


@query(_top_sql("tags", "u.dimension = 'knowledge'"))
def student_weak_knowledge(spark: SparkSession, folder: str) -> DataFrame:
    """The two most frequent knowledge tags of every student's incorrect responses."""
    return statistics.student_top(placed(spark, folder, "is_correct"), F.transform(F.filter("tags", lambda t: t["dimension"] == "knowledge"), lambda t: t["name"]))


@query("SELECT student_ref, min(student_name) AS name, count(DISTINCT student_name) AS names, count(DISTINCT student_name) > 1 AS conflict FROM attempts WHERE nullif(student_ref, '') IS NOT NULL GROUP BY 1")
def student_names(spark: SparkSession, folder: str) -> DataFrame:
    """One display name of every student, and whether several were given."""
    rows = table(spark, folder, "attempts").where("nullif(student_ref, '') is not null")
    return rows.groupBy("student_ref").agg(F.min("student_name").alias("name"), F.count_distinct("student_name").alias("names")).withColumn("conflict", F.col("names") > 1)


@query(
    BASE
    + f""", t AS (SELECT count(*) AS n, count(*) FILTER (score_u IS NOT NULL) AS s, count(*) FILTER (score_u IS NOT NULL AND is_correct = false) AS w, coalesce(sum(score_u), 0) AS e, coalesce(sum(max_u) FILTER (score_u IS NOT NULL), 0) AS m FROM j)
SELECT (SELECT count(*) FROM a) AS student_count, (SELECT count(DISTINCT class_id) FROM a) AS class_count, n AS responses, s AS scored, n - s AS unscored, w AS incorrect, {percent_sql("w", "s")} AS incorrect_rate, {percent_sql("e", "m")} AS score_rate FROM t"""
)
def report_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The head figures of a report."""
    return statistics.report_metrics(joined(spark, folder, "is_correct"), attempts(spark, folder))


@query(
    BASE
    + """SELECT coalesce(nullif(p.student_ref, ''), 'anonymous-student') AS student_ref, count(*) FILTER (review_status IN ('needs_review', 'provisional')) AS review_count, count(*) AS responses FROM p GROUP BY 1"""
)
def student_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """How many responses of every student wait for a review."""
    key = F.coalesce(F.nullif(F.col("student_ref"), F.lit("")), F.lit("anonymous-student"))
    return placed(spark, folder, "review_status").groupBy(key.alias("student_ref")).agg(F.count_if(F.col("review_status").isin("needs_review", "provisional")).alias("review_count"), F.count("*").alias("responses"))


# --- graph and similarity -----------------------------------------------------------------------------------------


@query(
    BASE
    + f""", g AS (SELECT q.question_id, any_value(q.tags) AS tags, count(j.response_id) AS responses, count(*) FILTER (j.score_u IS NOT NULL) AS scored, count(*) FILTER (j.is_correct) AS correct,
count(*) FILTER (j.review_status IN ('needs_review', 'provisional')) AS review_count, CAST(coalesce(sum(j.max_u - j.score_u) FILTER (j.score_u IS NOT NULL), 0) AS DOUBLE) / 1000000 AS lost_score
FROM questions q LEFT JOIN j USING (question_id) GROUP BY 1),
k AS (SELECT question_id, arg_min(u.name, (-coalesce(u.confidence, 1.0), i)) AS grp FROM (SELECT question_id, unnest(tags) AS u, unnest(range(len(tags))) AS i FROM questions) WHERE u.dimension = 'knowledge' GROUP BY 1)
SELECT question_id, coalesce(grp, 'unclassified') AS grp, responses, scored, correct, CASE WHEN scored > 0 THEN {percent_sql("correct", "scored")} END AS correct_rate, review_count, lost_score, greatest(8.0, 8 + 2 * lost_score) AS size
FROM g LEFT JOIN k USING (question_id)"""
)
def graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Questions as nodes of the similarity graph."""
    return graph.node_statistics(questions(spark, folder), joined(spark, folder, "is_correct", "review_status"))


EDGES = """, own AS (SELECT question_id, u.dimension AS dimension, u.name AS name, arg_max(coalesce(u.confidence, 1.0), i) AS weight FROM (SELECT question_id, unnest(tags) AS u, unnest(range(len(tags))) AS i FROM questions)
  WHERE u.dimension IN ('knowledge', 'cognitive') AND u.name IS NOT NULL GROUP BY ALL),
err AS (SELECT question_id, 'error' AS dimension, u.name AS name, max(coalesce(u.confidence, 1.0)) AS weight FROM (SELECT question_id, unnest(error_tags) AS u FROM j) WHERE u.name IS NOT NULL GROUP BY ALL),
w AS (SELECT * FROM own UNION ALL SELECT * FROM err),
t AS (SELECT question_id, dimension, sum(weight) AS total FROM w GROUP BY ALL),
s AS (SELECT x.question_id AS source, y.question_id AS target, dimension, sum(least(x.weight, y.weight)) AS lo FROM w x JOIN w y USING (dimension, name) WHERE x.question_id < y.question_id GROUP BY ALL),
pairs AS (SELECT DISTINCT source, target FROM s), dims AS (SELECT * FROM (VALUES ('knowledge', 0.55), ('cognitive', 0.28), ('error', 0.17)) AS v(dimension, share)),
f AS (SELECT source, target, dims.dimension AS dimension, share, coalesce(lo, 0) AS lo, x.total AS a, y.total AS b FROM pairs CROSS JOIN dims LEFT JOIN s USING (source, target, dimension)
  LEFT JOIN t x ON x.question_id = source AND x.dimension = dims.dimension LEFT JOIN t y ON y.question_id = target AND y.dimension = dims.dimension),
e AS (SELECT source, target, max(CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN CASE WHEN coalesce(a, 0) + coalesce(b, 0) - lo > 0 THEN CAST(lo AS DOUBLE) / (coalesce(a, 0) + coalesce(b, 0) - lo) ELSE 0 END END) FILTER (dimension = 'knowledge') AS knowledge, max(CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN CASE WHEN coalesce(a, 0) + coalesce(b, 0) - lo > 0 THEN CAST(lo AS DOUBLE) / (coalesce(a, 0) + coalesce(b, 0) - lo) ELSE 0 END END) FILTER (dimension = 'cognitive') AS cognitive, max(CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN CASE WHEN coalesce(a, 0) + coalesce(b, 0) - lo > 0 THEN CAST(lo AS DOUBLE) / (coalesce(a, 0) + coalesce(b, 0) - lo) ELSE 0 END END) FILTER (dimension = 'error') AS error, sum(CASE WHEN coalesce(a, 0) + coalesce(b, 0) - lo > 0 THEN CAST(share AS DOUBLE) * lo / (coalesce(a, 0) + coalesce(b, 0) - lo) ELSE 0 END) FILTER (a IS NOT NULL OR b IS NOT NULL) / sum(CAST(share AS DOUBLE)) FILTER (a IS NOT NULL OR b IS NOT NULL) AS weight FROM f GROUP BY ALL)
"""


@query(BASE + EDGES + "SELECT source, target, CAST(round(CAST(weight AS DECIMAL(18,9)), 4) AS DOUBLE) AS weight, " + ", ".join(f"CAST(round(CAST({d} AS DECIMAL(18,9)), 4) AS DOUBLE) AS {d}" for d in graph.WEIGHTS) + " FROM e WHERE weight >= 0.2")
def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of questions with a similarity of at least 0.2."""
    return graph.edges(graph.tag_weights(questions(spark, folder), joined(spark, folder, "error_tags")))


@query("SELECT grp, count(*) AS nodes, CAST(sum(responses) AS BIGINT) AS responses, CAST(sum(review_count) AS BIGINT) AS review_count FROM (" + SQL["graph_nodes"] + ") GROUP BY 1")
def graph_legend(spark: SparkSession, folder: str) -> DataFrame:
    """The groups of the graph with their sizes."""
    return graph.legend(graph_nodes(spark, folder))


@query(
    """WITH t AS (SELECT x.question_id, x.paper_id, u.name AS name, arg_max(coalesce(u.confidence, 1.0), i) AS weight FROM (SELECT question_id, paper_id, unnest(tags) AS u, unnest(range(len(tags))) AS i FROM questions) x WHERE u.dimension = 'knowledge' AND u.name IS NOT NULL GROUP BY ALL),
n AS (SELECT question_id, lead(question_id) OVER (PARTITION BY paper_id ORDER BY question_id) AS following FROM questions),
k AS (SELECT n.question_id, n.following, name, max(CASE WHEN t.question_id = n.question_id THEN weight END) AS a, max(CASE WHEN t.question_id = n.following THEN weight END) AS b FROM n JOIN t ON t.question_id IN (n.question_id, n.following) WHERE n.following IS NOT NULL GROUP BY ALL)
SELECT n.question_id, n.following, round(sum(least(coalesce(a, 0), coalesce(b, 0))) / nullif(sum(greatest(coalesce(a, 0), coalesce(b, 0))), 0), 6) AS jaccard FROM n LEFT JOIN k USING (question_id, following) WHERE n.following IS NOT NULL GROUP BY ALL"""
)
def tag_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted Jaccard similarity of the knowledge tags of neighbouring questions of a paper."""
    order = Window.partitionBy("paper_id").orderBy("question_id")
    rows = questions(spark, folder).select("question_id", "paper_id", vectors.tag_map(F.col("tags"), "knowledge").alias("a"))
    both = rows.withColumns({"following": F.lead("question_id").over(order), "b": F.lead("a").over(order)}).where("following is not null")
    return both.select("question_id", "following", F.round(vectors.weighted_jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query(
    """WITH c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL),
m AS (SELECT label, list(m ORDER BY i) AS centre FROM c GROUP BY label)
SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centre), 6) AS cosine FROM embeddings JOIN m USING (label)"""
)
def vector_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of every vector with the centre of its label; centres are added up before they are shuffled."""
    rows = table(spark, folder, "embeddings")
    means = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
    return rows.join(centres, "label").select("vec_id", "label", F.round(vectors.cosine(F.transform("embedding", lambda x: x.cast("double")), F.col("centre")), 6).alias("cosine"))


# --- scalar functions over whole columns --------------------------------------------------------------------------


@query()
def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    """Normalised answers."""
    return responses(spark, folder, "normalized_answer").select("response_id", text.normalize_text(F.col("normalized_answer")).alias("normalized"))


@query(
    r"""SELECT doc_id, CASE WHEN regexp_full_match(t, '[A-Za-z0-9][A-Za-z0-9._-]{0,127}') THEN t WHEN c <> '' THEN left(c, 128) ELSE 'doc-' || doc_id END AS id FROM (
SELECT doc_id, t, regexp_replace(regexp_replace(t, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g') AS c FROM (SELECT doc_id, regexp_replace(coalesce(source, ''), '^\s+|\s+$', '', 'g') || '/' || coalesce(question_id, '') AS t FROM documents))"""
)
def safe_id(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers made of source and question of every document."""
    own = F.concat(F.regexp_replace(F.coalesce("source", F.lit("")), r"^\s+|\s+$", ""), F.lit("/"), F.coalesce("question_id", F.lit("")))
    return table(spark, folder, "documents").select("doc_id", text.safe_id(own, F.concat(F.lit("doc-"), "doc_id")).alias("id"))


@query("SELECT doc_id, sha256(text) AS digest, CAST(('0x' || left(sha256(text), 8)) AS BIGINT) AS seed FROM documents")
def sha256_value(spark: SparkSession, folder: str) -> DataFrame:
    """Digest and layout seed of every text."""
    return table(spark, folder, "documents").select("doc_id", text.sha256_text(F.col("text")).alias("digest"), text.layout_seed(F.col("text")).alias("seed"))


#: Normalised text in DuckDB's SQL as far as these columns need it: full-width forms, ideographic blanks, superscripts, case, blanks, end marks.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000\u00a0¹²³"
_NARROW = "".join(map(chr, range(0x21, 0x7F))) + "  123"


def _normal_sql(column: str) -> str:
    folded = f"lower(translate(nfc_normalize(coalesce({column}, '')), {_quoted(_WIDE)}, {_quoted(_NARROW)}))"
    return f"rtrim(trim(regexp_replace({folded}, '\\s+', ' ', 'g')), '，。；：、,.!?！？;:')"


def _quoted(text_: str) -> str:
    return "'" + text_.replace("'", "''") + "'"


NUMBER = r"^([-+]?(?:\d+\.?\d*|\.\d+)(?:e[-+]?\d+)?)\s*(.*)$"


@query(
    rf"""SELECT question_id, CASE WHEN regexp_matches(t, '{NUMBER}') THEN TRY_CAST(regexp_extract(t, '{NUMBER}', 1) AS DECIMAL(20,6)) END AS number, CASE WHEN regexp_matches(t, '{NUMBER}') THEN trim(regexp_extract(t, '{NUMBER}', 2)) END AS unit
FROM (SELECT question_id, {_normal_sql('reference_answer')} AS t FROM questions WHERE reference_answer IS NOT NULL)"""
)
def numeric_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Number and unit that each normalised reference answer begins with."""
    t = text.normalize_text(F.col("reference_answer"))
    return questions(spark, folder).where("reference_answer is not null").select("question_id", t.alias("t")).select("question_id", text.number_part(F.col("t")).alias("number"), text.unit_part(F.col("t")).alias("unit"))


@query()
def answer_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Items of every normalised answer, as a set; none for a missing answer."""
    rows = responses(spark, folder, "normalized_answer").select("response_id", text.normalize_text(F.col("normalized_answer")).alias("t"))
    return rows.select("response_id", F.array_join(text.answer_set(F.col("t")), "|").alias("items"))


@query(
    BASE
    + "SELECT name, label, count(*) AS n FROM (SELECT u.name AS name, CASE u.name "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.LABELS["error"].items())
    + " ELSE '其他错因' END AS label FROM (SELECT unnest(error_tags) AS u FROM r) WHERE u.name IS NOT NULL) GROUP BY ALL"
)
def label_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Error tags with their labels; counted before they are labelled."""
    counts = responses(spark, folder, "error_tags").select(F.explode("error_tags").alias("t")).where("t.name is not null").groupBy(F.col("t.name").alias("name")).agg(F.count("*").alias("n"))
    return counts.select("name", labels.label("error", F.col("name")).alias("label"), "n")


@query(
    r"""SELECT response_id, '"' || replace(CASE WHEN regexp_matches(v, '^([\t\r\n ]*[=+\-@]|[\t\r\n])') THEN '''' || v ELSE v END, '"', '""') || '"' AS cell
FROM (SELECT DISTINCT response_id, coalesce(normalized_answer, '') AS v FROM responses)"""
)
def csv_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Answers as cells for spreadsheets, guarded against formulas."""
    return responses(spark, folder, "normalized_answer").select("response_id", text.csv_cell(F.col("normalized_answer")).alias("cell"))


@query()
def canonical_json(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical digest and state digest of every class record."""
    rows = table(spark, folder, "class_records").dropDuplicates(["record_id"])
    return rows.select("record_id", hashing.sha256_value(F.col("payload")).alias("digest"), hashing.state_hash(F.col("payload")).alias("state"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def event_properties(spark: SparkSession, folder: str) -> DataFrame:
    """Events by type with the sum of a JSON property."""
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"))


# --- logs, vocabulary, migration, rules ---------------------------------------------------------------------------

CHAIN = """WITH RECURSIVE d AS (SELECT DISTINCT attempt_id, received_at, coalesce(submitted_at, '') AS s, coalesce(student_ref, '') AS t FROM attempts),
e AS (SELECT attempt_id, 'sha256:' || sha256(s || '|' || t) AS payload_hash, CAST(row_number() OVER (PARTITION BY attempt_id ORDER BY received_at, 'sha256:' || sha256(s || '|' || t)) AS INT) AS event_pos FROM (SELECT DISTINCT attempt_id, received_at, s, t FROM d)),
c AS (SELECT attempt_id, event_pos, payload_hash, '' AS previous_hash, 'sha256:' || sha256('|' || event_pos || '|' || payload_hash) AS event_hash FROM e WHERE event_pos = 1
UNION ALL SELECT e.attempt_id, e.event_pos, e.payload_hash, c.event_hash, 'sha256:' || sha256(c.event_hash || '|' || e.event_pos || '|' || e.payload_hash) FROM c JOIN e ON e.attempt_id = c.attempt_id AND e.event_pos = c.event_pos + 1)
SELECT attempt_id, event_pos, payload_hash, previous_hash, event_hash FROM c"""


@query(CHAIN)
def audit_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries of every attempt as a hash-chained log."""
    rows = table(spark, folder, "attempts").select("attempt_id", "received_at", audit.payload_hash(F.col("submitted_at"), F.col("student_ref")).alias("payload_hash")).distinct()
    return audit.chained(rows, "attempt_id", ["received_at"])


@query("SELECT CAST(NULL AS VARCHAR) AS attempt_id, CAST(NULL AS INT) AS event_pos, CAST(NULL AS VARCHAR) AS fault WHERE false")
def audit_verify(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of those logs: none."""
    return audit.broken(audit_chain(spark, folder), "attempt_id")


TAGGED = BASE + """, s AS (SELECT 'error' AS dimension, trim(u.name) AS name, response_id AS pos, question_id, student_ref FROM (SELECT unnest(error_tags) AS u, response_id, question_id, student_ref FROM p) WHERE u.dimension = 'error' AND trim(u.name) <> ''),
c AS (SELECT 'error-' || left(sha256('error:' || lower(name)), 16) AS id, 'error' AS dimension, arg_min(name, pos) AS name, arg_min(name, pos) AS display_name, count(DISTINCT (question_id, student_ref)) AS evidence FROM s GROUP BY 1)
"""


@query(TAGGED + "SELECT id, dimension, name, display_name, evidence FROM c")
def vocabulary_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Error tags as vocabulary candidates with their evidence."""
    return vocabulary.candidates(_tags(spark, folder)).drop("definition")


def _tags(spark: SparkSession, folder: str) -> DataFrame:
    rows = placed(spark, folder, "error_tags").select(F.explode("error_tags").alias("t"), F.col("response_id").alias("at"), "question_id", "student_ref")
    return rows.select("t.dimension", "t.name", F.lit(None).cast("string").alias("display_name"), "at", "question_id", "student_ref")


#: Error labels of the query's registry with their states: a third each approved, pending (without a display name) and rejected.
ITEMS = [(k, v if i % 3 != 1 else "", ("approved", "pending", "rejected")[i % 3]) for i, (k, v) in enumerate(labels.LABELS["error"].items())]


def registry(spark: SparkSession) -> DataFrame:
    """A registry of all fixed error labels, in every state."""
    base = spark.createDataFrame(ITEMS, "name string, display_name string, status string")
    return base.select(text.candidate_id(F.lit("error"), F.col("name")).alias("id"), F.lit("error").alias("dimension"), "name", "display_name", "status", F.lit(0).cast("bigint").alias("evidence"))


REGISTRY = ", g AS (SELECT 'error-' || left(sha256('error:' || name), 16) AS id, 'error' AS dimension, name, display_name, status, CAST(0 AS BIGINT) AS evidence FROM (VALUES " + ", ".join(f"('{k}', '{v}', '{s}')" for k, v, s in ITEMS) + ") AS v(name, display_name, status))\n"


@query(
    TAGGED
    + REGISTRY
    + """SELECT coalesce(g.id, c.id) AS id, coalesce(g.dimension, c.dimension) AS dimension, coalesce(g.name, c.name) AS name, CASE WHEN g.status = 'pending' THEN coalesce(nullif(g.display_name, ''), c.display_name) ELSE coalesce(g.display_name, c.display_name) END AS display_name,
coalesce(g.status, 'pending') AS status, CASE WHEN g.status = 'pending' THEN coalesce(c.evidence, g.evidence) ELSE coalesce(g.evidence, c.evidence) END AS evidence FROM g FULL JOIN c ON g.id = c.id"""
)
def vocabulary_merge(spark: SparkSession, folder: str) -> DataFrame:
    """The registry after the candidates are merged in twice: the second time the evidence is known."""
    tags = _tags(spark, folder)
    found, pairs = vocabulary.candidates(tags), vocabulary.evidence(tags)
    once = vocabulary.merged(registry(spark), found, pairs.limit(0), pairs)
    return vocabulary.merged(once, found, pairs, pairs).select("id", "dimension", "name", "display_name", "status", "evidence")


@query("SELECT 'error' AS dimension, name, display_name FROM (VALUES " + ", ".join(f"('{k}', '{v}', '{s}')" for k, v, s in ITEMS) + ") AS v(name, display_name, status) WHERE status = 'approved'")
def vocabulary_approved(spark: SparkSession, folder: str) -> DataFrame:
    """The approved labels of the registry."""
    return vocabulary.approved(registry(spark))


@query(
    r"""WITH o AS (SELECT * FROM v1_answers QUALIFY row_number() OVER (PARTITION BY v1_id ORDER BY exported_at) = 1),
m AS (SELECT *, replace(lower(trim(coalesce(question_type, ''))), ' ', '_') AS k FROM o)
SELECT v1_id, attempt_id, student_id AS student_ref, question_id,
CASE WHEN k IN ('single_choice', 'multiple_choice', 'true_false', 'fill_blank', 'numeric', 'formula', 'ordered_steps', 'subjective') THEN k
ELSE coalesce(CASE k WHEN 'choice' THEN 'single_choice' WHEN 'single-choice' THEN 'single_choice' WHEN 'multiple-choice' THEN 'multiple_choice' WHEN 'boolean' THEN 'true_false' WHEN 'blank' THEN 'fill_blank' WHEN 'calculation' THEN 'numeric' WHEN 'math' THEN 'formula' END, 'subjective') END AS question_type,
student_answer AS normalized_answer, reference_answer, coalesce(max_score, 0) AS max_score, score, score = coalesce(max_score, 0) AS is_correct, ocr_confidence AS ocr, grading_confidence AS grading,
CASE WHEN review_status IN ('provisional', 'needs_review', 'auto_confirmed', 'teacher_confirmed', 'rejected') THEN review_status ELSE 'provisional' END AS review_status, 'migrated_from_v1' AS review_reason FROM m"""
)
def migrate_v1(spark: SparkSession, folder: str) -> DataFrame:
    """Old-format answers in the current form."""
    return migration.migrated(table(spark, folder, "v1_answers"))


@query(
    """WITH o AS (SELECT * FROM v1_answers QUALIFY row_number() OVER (PARTITION BY v1_id ORDER BY exported_at) = 1)
SELECT attempt_id, min(student_id) AS student_ref, count(*) AS answers, CAST(sum(coalesce(CAST(max_score AS DECIMAL(20,6)), 0)) AS DOUBLE) AS max_score, CAST(coalesce(sum(CAST(score AS DECIMAL(20,6))), 0) AS DOUBLE) AS score, count(*) FILTER (score IS NULL) AS without_score FROM o GROUP BY 1"""
)
def old_papers(spark: SparkSession, folder: str) -> DataFrame:
    """The papers of old attempts with their exact totals."""
    return migration.old_papers(table(spark, folder, "v1_answers"))


@query(
    """WITH o AS (SELECT * FROM v1_answers QUALIFY row_number() OVER (PARTITION BY v1_id ORDER BY exported_at) = 1),
k AS (SELECT *, replace(lower(trim(question_type)), ' ', '_') AS k FROM o)
SELECT v1_id, unnest(list_filter([CASE WHEN k IS NULL OR k NOT IN ('single_choice', 'multiple_choice', 'true_false', 'fill_blank', 'numeric', 'formula', 'ordered_steps', 'subjective', 'essay', 'choice', 'single-choice', 'multiple-choice', 'boolean', 'blank', 'calculation', 'math') THEN 'question type unknown' END,
CASE WHEN max_score IS NULL THEN 'maximum missing' END, CASE WHEN reference_answer IS NULL THEN 'reference missing' END,
CASE WHEN review_status IS NULL OR review_status NOT IN ('unreviewed', 'provisional', 'needs_review', 'auto_confirmed', 'teacher_confirmed', 'rejected', 'confirmed') THEN 'status unknown' END], lambda w: w IS NOT NULL)) AS warning FROM k"""
)
def migration_warnings(spark: SparkSession, folder: str) -> DataFrame:
    """What the migration of old answers had to make up."""
    return migration.warnings(table(spark, folder, "v1_answers"))


@query(
    r"""WITH r AS (SELECT * FROM responses QUALIFY row_number() OVER (PARTITION BY response_id ORDER BY ingested_at) = 1),
x AS (SELECT r.*, q.max_score, q.question_type, q.question_id IS NOT NULL AS known, row_number() OVER (PARTITION BY attempt_id, r.question_id ORDER BY response_id) AS nth FROM r LEFT JOIN questions q USING (question_id)),
v AS (SELECT response_id, unnest([
CASE WHEN NOT regexp_full_match(attempt_id, '[A-Za-z0-9][A-Za-z0-9._-]{0,127}') THEN 'response.attempt_id' END,
CASE WHEN NOT known THEN 'response.question_unknown' END,
CASE WHEN nth > 1 THEN 'response.duplicate' END,
CASE WHEN length(raw_ocr_text) > 100000 THEN 'response.raw_text_length' END,
CASE WHEN confidence.ocr NOT BETWEEN 0 AND 1 OR confidence.grading NOT BETWEEN 0 AND 1 OR confidence.tagging NOT BETWEEN 0 AND 1 THEN 'response.confidence_range' END,
CASE WHEN review_status IS NULL OR review_status NOT IN ('unreviewed', 'provisional', 'needs_review', 'auto_confirmed', 'teacher_confirmed', 'rejected') THEN 'response.status' END,
CASE WHEN score < 0 OR score > max_score THEN 'response.score_range' END,
CASE WHEN known AND is_correct IS DISTINCT FROM (score = max_score) THEN 'response.is_correct' END,
CASE WHEN question_type = 'subjective' AND review_status = 'auto_confirmed' THEN 'response.subjective_auto' END,
CASE WHEN first_error_step < 1 THEN 'response.first_error_step' END,
CASE WHEN len(list_filter(error_tags, lambda t: t.dimension IS DISTINCT FROM 'error')) > 0 THEN 'response.tag_dimension' END,
CASE WHEN len(list_filter(error_tags, lambda t: coalesce(trim(t.name), '') = '')) > 0 THEN 'response.tag_name' END,
CASE WHEN len(list_filter(error_tags, lambda t: t.confidence < 0 OR t.confidence > 1)) > 0 THEN 'response.tag_confidence' END,
CASE WHEN (confidence.ocr < 0.7 OR confidence.grading < 0.7 OR confidence.tagging < 0.7) AND review_status NOT IN ('needs_review', 'teacher_confirmed', 'rejected') THEN 'response.low_confidence_status' END]) AS rule FROM x)
SELECT 'responses/' || response_id AS location, rule FROM v WHERE rule IS NOT NULL"""
)
def validation_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Every violated rule of every response."""
    return validation.violations(responses(spark, folder, "attempt_id", "question_id", "raw_ocr_text", "confidence", "review_status", "score", "is_correct", "first_error_step", "error_tags"), questions(spark, folder))


@query(
    r"""SELECT 'questions/' || question_id AS location, rule FROM (SELECT question_id, unnest([
CASE WHEN NOT regexp_full_match(question_id, '[A-Za-z0-9][A-Za-z0-9._-]{0,127}') THEN 'question.id' END,
CASE WHEN question_type IS NULL OR question_type NOT IN ('single_choice', 'multiple_choice', 'true_false', 'fill_blank', 'numeric', 'formula', 'ordered_steps', 'subjective') THEN 'question.type' END,
CASE WHEN max_score IS NULL OR max_score < 0 THEN 'question.max_score' END,
CASE WHEN difficulty IS NULL OR difficulty NOT IN ('easy', 'medium', 'hard', 'unknown') THEN 'question.difficulty' END,
CASE WHEN reference_answer IS NULL THEN 'question.reference_missing' END,
CASE WHEN len(list_filter(tags, lambda t: t.dimension IS NULL OR t.dimension NOT IN ('knowledge', 'cognitive'))) > 0 THEN 'question.tag_dimension' END,
CASE WHEN len(list_filter(tags, lambda t: t.confidence IS NULL)) > 0 THEN 'question.tag_confidence_missing' END]) AS rule FROM questions) WHERE rule IS NOT NULL"""
)
def question_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Every violated rule of every question."""
    return validation.question_violations(questions(spark, folder))


@query("SELECT DISTINCT question_id FROM documents WHERE question_id IS NOT NULL AND question_id NOT IN (SELECT question_id FROM questions WHERE question_id IS NOT NULL)")
def unknown_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Questions that documents name and the paper lacks."""
    return validation.missing_references(table(spark, folder, "documents"), questions(spark, folder), "question_id")


@query("SELECT p.paper_id, count(*) AS questions, CAST(sum(CAST(max_score AS DECIMAL(20,6))) AS DOUBLE) AS max_score FROM questions p GROUP BY 1")
def paper_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Questions and greatest score of every paper, in exact arithmetic."""
    return questions(spark, folder).groupBy("paper_id").agg(F.count("*").alias("questions"), F.sum(F.col("max_score").cast("decimal(20,6)")).cast("double").alias("max_score"))


@query()
def compared_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Every response compared with its reference by the type of its question."""
    return answers.compared(joined(spark, folder, "normalized_answer")).select("response_id", "matches", "match_share", "match_note")


@query(
    BASE
    + f""", c AS (SELECT question_type, count(*) AS n, count(*) FILTER (is_correct) AS correct FROM j GROUP BY 1) SELECT question_type, n, correct, {percent_sql("correct", "n")} AS correct_rate FROM c"""
)
def type_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Correct responses by type of question."""
    got = joined(spark, folder, "is_correct").groupBy("question_type").agg(F.count("*").alias("n"), F.count_if(F.col("is_correct").eqNullSafe(F.lit(True))).alias("correct"))
    return got.withColumn("correct_rate", percentage(F.col("correct"), F.col("n")))


@query("SELECT event_id, user_id, event_type, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events")
def value_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Every event with the value that it replaces for its user and type."""
    return changes.traced(table(spark, folder, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value").select("event_id", "user_id", "event_type", "value", "before")


@query(
    """WITH l AS (SELECT user_id AS c_custkey, arg_max(value, (ts, event_id)) AS v, count(*) AS n FROM events GROUP BY 1)
SELECT c_custkey, CASE WHEN n > 0 THEN v ELSE c_acctbal END AS c_acctbal, coalesce(n, 0) AS changed FROM customer LEFT JOIN l USING (c_custkey)"""
)
def changes_applied(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with their last event's value in place of the balance."""
    news = table(spark, folder, "events").select(F.col("user_id").alias("c_custkey"), "ts", "event_id", F.col("value").alias("c_acctbal"))
    return changes.applied(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), news, ["c_custkey"], ["ts", "event_id"], "c_acctbal")


@query("SELECT DISTINCT user_id AS c_custkey FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)")
def changes_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Users of events that are no customers."""
    return changes.unmatched(table(spark, folder, "events").select(F.col("user_id").alias("c_custkey")), table(spark, folder, "customer"), ["c_custkey"])


@query(
    data_queries.NESTED
    + """SELECT record_id, attempt_pos, response_pos, count(*) AS evidence, count(*) FILTER (x ->> '$.causal_role' = 'causal') AS causal,
min(TRY_CAST(x ->> '$.step' AS INT)) FILTER (x ->> '$.causal_role' = 'causal') AS first_step FROM e GROUP BY 1, 2, 3"""
)
def causal_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence of every response of the class records, with the first causal step."""
    return changes.first_causal_step(data_queries.p2_evidence(spark, folder), ["record_id", "attempt_pos", "response_pos"])


@query("SELECT DISTINCT response_id, list_min(list_transform(error_tags, lambda t: t.confidence)) AS least FROM responses")
def tag_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """The least tag confidence of every response."""
    return responses(spark, folder, "error_tags").select("response_id", changes.least_confidence(F.col("error_tags")).alias("least"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return dict(SQL)
