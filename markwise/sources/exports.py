"""Exports for people and for other programs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwise.functions.text import csv_cell
from markwise.operators.review import PAIR, confirmed


# The heads of the lists for people.
REVIEW_HEAD = ("学生姓名", "题目", "原分数", "满分", "最终分数", "复核状态", "原因")
FINAL_HEAD = ("学生姓名", "错题题号", "最终得分", "总分", "得分率", "剩余待复核", "未评分题", "发布状态")


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One line of text per row: every cell quoted and guarded against being read as a formula."""
    return rows.select(F.concat_ws(",", *[csv_cell(F.col(c).cast("string")) for c in columns]).alias("value"))


def write_csv(rows: DataFrame, columns: list[str], path: str) -> None:
    """Writes the lines as text files with CRLF ends; the header is the first line of every file.

    Each partition writes its own file, so no row passes through the driver.
    """
    head = ",".join('"' + c.replace('"', '""') + '"' for c in columns)

    def with_head(batches):
        import pandas as pd

        first = True
        for batch in batches:
            if first:
                yield pd.DataFrame({"value": ["﻿" + head]})
                first = False
            yield batch

    csv_lines(rows, columns).mapInPandas(with_head, "value string").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def bound_documents(rows: DataFrame, documents: DataFrame, order: list[str], fields: list[str], exported_at: str) -> DataFrame:
    """record_id, document: one JSON document per record with its decisions in order, bound to the document's state.

    ``documents`` has record_id, organization_id, analysis_id and state_hash; what reads the decisions back refuses them where
    one of these differs (:func:`markwise.operators.review.bound`). Serves decisions on reviews and on vocabulary alike.
    """
    lists = rows.groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in (*order, *fields)]))).alias("decisions"))  # the decisions of one record
    body = F.struct("organization_id", "analysis_id", F.col("state_hash").alias("document_state_hash"), F.lit(exported_at).alias("exported_at"), "decisions")
    return lists.join(documents, "record_id").select("record_id", F.to_json(body).alias("document"))


def reloaded(saved: DataFrame, items: DataFrame) -> DataFrame:
    """Saved decisions that still fit the queue: of a known pair and with a score in range; confirm or modify is decided anew."""
    rows = saved.select(*PAIR, F.col("score").alias("new"), "reviewed_at").join(items.select(*PAIR, "score", "max_score"), PAIR)
    return rows.withColumn("decision", confirmed(F.col("score"), F.col("new"), F.col("max_score"))).where("decision is not null").select(*PAIR, "decision", F.round(F.col("new").cast("decimal(20,6)"), 2).cast("double").alias("score"), "reviewed_at")


def decision_documents(rows: DataFrame, key: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """One JSON document per key with its rows as a sorted list, for a program that applies them.

    Meant for decisions, of which one key (an analysis) has a bounded list.
    """
    return rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in (*order, *fields)]))).alias("decisions")).select(*key, F.to_json(F.struct(*key, "decisions")).alias("document"))
