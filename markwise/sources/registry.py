"""Storage of the extension vocabulary."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, dimension string, name string, display_name string, definition string, status string, evidence bigint, created_at string, updated_at string, reviewed_at string, review_source string"


def registry_faults(items: DataFrame) -> DataFrame:
    """id, rule of every item that breaks a rule of the registry."""
    rules = {
        "id missing": F.coalesce(F.col("id"), F.lit("")) == "",
        "dimension": ~F.coalesce(F.col("dimension").isin("error", "knowledge"), F.lit(False)),
        "name": F.coalesce(F.trim("name"), F.lit("")) == "",
        "display name": F.coalesce(F.trim("display_name"), F.lit("")) == "",
        "created": F.col("created_at").isNull() | F.col("updated_at").isNull(),
        "status": ~F.coalesce(F.col("status").isin("pending", "approved", "rejected"), F.lit(False)),
    }
    single = items.select("id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))).alias("rule"))
    twice = items.where("id <> ''").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("id repeated").alias("rule"))
    return single.unionByName(twice)


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry under ``path``; an empty one if nothing is there. A broken registry raises ValueError."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], SCHEMA)
    items = spark.read.schema(SCHEMA).json(path)
    bad = registry_faults(items).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['id']}: {r['rule']}" for r in bad))
    return items


def save_registry(items: DataFrame, path: str) -> None:
    """Writes the registry beside ``path`` and renames it, so that a reader sees the old or the new one, never half."""
    bad = registry_faults(items).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['id']}: {r['rule']}" for r in bad))
    spark = items.sparkSession
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    items.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.json(new)
    make = spark._jvm.org.apache.hadoop.fs.Path
    fs = make(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(make(path))
    if had:
        fs.rename(make(path), make(old))
    fs.rename(make(new), make(path))
    if had:
        fs.delete(make(old), True)
