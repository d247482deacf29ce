"""Queries of the language-model operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markwise.llm import lookalike, mix, names, spans, tokens
from markwise.session import checkpointed
from markwise.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of student_refs of one class that are the same student."""
    return names.same_student(names.students(table(spark, folder, "attempts")))


def p3_students(spark: SparkSession, folder: str) -> DataFrame:
    """The student of every student_ref."""
    return names.students(table(spark, folder, "attempts"))


def answer_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """origin, row_id, answer, reference of all responses and all old-format answers."""
    responses = table(spark, folder, "responses").select("response_id", "question_id", "normalized_answer")
    questions = table(spark, folder, "questions").select("question_id", "reference_answer")
    new = responses.join(questions, "question_id", "left").select(F.lit("responses").alias("origin"), F.col("response_id").alias("row_id"), F.col("normalized_answer").alias("answer"), F.col("reference_answer").alias("reference"))
    old = table(spark, folder, "v1_answers").select(F.lit("v1_answers").alias("origin"), F.col("v1_id").alias("row_id"), F.col("student_answer").alias("answer"), F.col("reference_answer").alias("reference"))
    return new.unionByName(old)


def answer_bigrams(pairs: DataFrame) -> DataFrame:
    """Character bigrams of all answers and references."""
    return lookalike.bigram_counts(pairs.select(F.explode(F.array("answer", "reference")).alias("text")), "text")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose answer and reference differ in their characters and look the same."""
    pairs = answer_pairs(spark, folder).withColumn("row", F.struct("origin", "row_id"))
    return lookalike.looking_alike(pairs, "row", "answer", "reference", answer_bigrams(pairs)).select("row.origin", "row.row_id")


def p4_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every answer and reference in its one form."""
    pairs = answer_pairs(spark, folder)
    formed = lookalike.one_form(pairs, {"answer": "answer_form", "reference": "reference_form"}, answer_bigrams(pairs))
    return formed.select("origin", "row_id", "answer_form", "reference_form").distinct()


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k."""
    return tokens.with_ids(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "ids")


def sized_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, source, size in tokens of byte_bpe_50k; computed once and kept in the shared folder."""
    docs = table(spark, folder, "documents").where("source is not null").select("doc_id", "source", "text")
    return checkpointed(tokens.with_token_count(docs, out="size").select("doc_id", "source", "size"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mix of the sources, one row per copy of a document."""
    return mix.mixed(sized_documents(spark, folder), table(spark, folder, "mix_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source in the mix."""
    sized, targets = sized_documents(spark, folder), table(spark, folder, "mix_targets")
    return mix.actual_shares(mix.mixed(sized, targets), sized, targets)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Where each document holds text that stands verbatim in another one."""
    return spans.shared_spans(table(spark, folder, "documents"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each document stands elsewhere too."""
    docs = table(spark, folder, "documents")
    return spans.shares(docs, spans.shared_spans(docs))


def p8_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the documents with the earliest occurrence of each marked."""
    return spans.line_units(table(spark, folder, "documents"))


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The documents without the lines that stand earlier in the corpus."""
    docs = table(spark, folder, "documents")
    return spans.without_repeats(docs, spans.line_units(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    return {f.__name__: f for f in (p3_found, p3_students, p4_found, p4_forms, p6_ids, p7_mix, p7_shares, p8_found, p8_shares, p8_lines, p8_clean)}


_TRIMMED = "trim(line, " + " || ".join(f"chr({ord(c)})" for c in spans.BLANKS) + ")"
_UNITS = rf"""
WITH parts AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), lines AS (
  SELECT doc_id, unnest(range(len(lines))) AS unit, unnest(lines) AS line FROM parts
), placed AS (
  SELECT doc_id, CAST(unit AS INT) AS unit, line, {_TRIMMED} AS body, CAST(length(line) AS BIGINT) AS unit_chars, length({_TRIMMED}) >= {spans.LEAST_LINE} AS compared,
         CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS unit_start
  FROM lines
), units AS (
  SELECT doc_id, unit, unit_start, unit_chars, compared, line, CASE WHEN compared THEN count(*) OVER w ELSE 1 END AS occurrences,
         compared AND min(doc_id) OVER w < max(doc_id) OVER w AS elsewhere, NOT compared OR row_number() OVER (w ORDER BY doc_id, unit) = 1 AS kept
  FROM placed WINDOW w AS (PARTITION BY body, compared)
)
"""
P8_LINES = _UNITS + "SELECT doc_id, unit, unit_start, unit_chars, compared, occurrences, elsewhere, kept FROM units"
P8_CLEAN = (
    _UNITS
    + """, left_over AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY unit) FILTER (kept) AS text, count(*) FILTER (kept) AS lines_left, count(*) FILTER (NOT kept) AS lines_removed,
string_agg(unit_start || ':' || unit_chars, ',' ORDER BY unit) FILTER (NOT kept) AS removed FROM units GROUP BY 1)
SELECT d.doc_id, CASE WHEN lines_removed > 0 THEN coalesce(l.text, '') ELSE d.text END AS text, l.lines_left, coalesce(l.lines_removed, 0) AS lines_removed, coalesce(l.removed, '') AS removed FROM documents d LEFT JOIN left_over l USING (doc_id)"""
)
#: Every window of every text, by brute force over code points; two hashes stand for a window.
P8_SPANS = rf"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= {spans.LEAST}),
c AS (SELECT doc_id, unnest(range(1, length(text) - {spans.LEAST - 2})) AS i, text FROM d),
w AS (SELECT doc_id, i, md5_number(substring(text, i, {spans.LEAST})) AS h FROM c),
s AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1),
f AS (SELECT doc_id, i FROM w SEMI JOIN s USING (h)),
b AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {spans.LEAST}, true) AS begins FROM f),
r AS (SELECT *, sum(CAST(begins AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b),
runs AS (SELECT doc_id, min(i) - 1 AS span_start, max(i) + {spans.LEAST} - min(i) AS span_chars FROM r GROUP BY doc_id, run)
"""
P8_FOUND = P8_SPANS + "SELECT doc_id, span_start, span_chars FROM runs"
P8_SHARES = (
    P8_SPANS
    + """, t AS (SELECT doc_id, CAST(sum(span_chars) AS BIGINT) AS shared_chars FROM runs GROUP BY 1)
SELECT doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS chars, coalesce(shared_chars, 0) AS shared_chars, CASE WHEN length(text) > 0 THEN CAST(coalesce(shared_chars, 0) AS DOUBLE) / length(text) ELSE 0.0 END AS share FROM documents LEFT JOIN t USING (doc_id)"""
)


def oracle_sql() -> dict[str, str]:
    """SQL of those that SQL can express in whole."""
    return {"p8_lines": P8_LINES, "p8_clean": P8_CLEAN, "p8_found": P8_FOUND, "p8_shares": P8_SHARES}
