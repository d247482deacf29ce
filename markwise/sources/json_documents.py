"""Bounded JSON documents, one per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markwise.operators.nested import pivoted, triples

#: Largest document in bytes that is read unless told otherwise.
LARGEST = 256 * 1024 * 1024


def read_documents(spark: SparkSession, path: str, largest: int = LARGEST) -> DataFrame:
    """doc_id (the file's path), bytes, payload, fault of every file under ``path``.

    ``fault`` is null, or says that the file is too large (its text is then not read), is not complete JSON, or holds
    no object at its root. No file stops the others.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), F.col("length").alias("bytes"), F.when(F.col("length") <= largest, F.try_validate_utf8(F.col("content").cast("string"))).alias("payload"))
    parsed = F.try_parse_json("payload")
    fault = F.when(F.col("bytes") > largest, "too large").when(parsed.isNull(), "not JSON").when(~F.schema_of_variant(parsed).startswith("OBJECT"), "no object")
    return files.withColumn("fault", fault)


def require_sound(documents: DataFrame) -> DataFrame:
    """``documents``, or a ValueError that names the first few files with a fault."""
    bad = documents.where("fault is not null").select("doc_id", "fault").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['doc_id']}: {r['fault']}" for r in bad))
    return documents


def document_table(documents: DataFrame, group: str, lists: list[str], keys: dict[str, list[str]], fields: list[str], levels: list[str]) -> DataFrame:
    """One flat table of a repeated part of the documents; see :mod:`markwise.operators.nested`."""
    parts = triples(documents.where("fault is null"), "doc_id", "payload", lists, keys, {group: fields})
    return pivoted(parts, group, levels, fields).withColumnRenamed("record", "doc_id")
