"""Extension vocabulary: candidates from tags, their evidence, merge into a registry, decisions.

A registry is a table (id, dimension, name, display_name, definition, status, evidence, created_at, updated_at, reviewed_at,
review_source). The evidence itself, distinct (id, question_id, student_ref), is a table beside it, since one tag may be shown by a
third of all responses; ``evidence`` counts its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markwise.functions.text import candidate_id, collapsed


def _named(tags: DataFrame) -> DataFrame:
    return tags.withColumn("name", collapsed(F.col("name"), 80)).where("dimension in ('error', 'knowledge') and name <> ''").withColumn("id", candidate_id(F.col("dimension"), F.col("name")))


def evidence(tags: DataFrame) -> DataFrame:
    """id, question_id, student_ref: the distinct evidence of every tag name."""
    return _named(tags).select("id", "question_id", "student_ref").distinct()


def candidates(tags: DataFrame) -> DataFrame:
    """id, dimension, name, display_name, definition, evidence of every tag name.

    ``tags`` has dimension, name, display_name, at (orders occurrences), question_id, student_ref and perhaps definition. Names
    are trimmed, collapsed and cut to 80; those that differ in case are one candidate, spelled as first seen. ``evidence`` counts
    distinct (question, student) pairs. Dimensions other than error and knowledge, and blank names, are left out.
    """
    own = F.col("definition") if "definition" in tags.columns else F.lit(None).cast("string")
    clean = _named(tags).withColumn("definition", collapsed(own, 300))
    once = clean.groupBy("id", "question_id", "student_ref").agg(F.min(F.struct("at", "dimension", "name", "display_name", "definition")).alias("f"))
    first = once.groupBy("id").agg(F.min("f").alias("f"), F.count("*").alias("evidence"))
    return first.select("id", "f.dimension", "f.name", F.coalesce(F.nullif("f.display_name", F.lit("")), "f.name").alias("display_name"), F.nullif("f.definition", F.lit("")).alias("definition"), "evidence")


def merged(registry: DataFrame, found: DataFrame, known: DataFrame | None = None, news: DataFrame | None = None, at: str | None = None) -> DataFrame:
    """The registry with ``found`` merged in.

    A new candidate is pending; a pending item counts evidence that it does not have yet and fills an empty display name and
    definition; approved and rejected items stay as they are. ``known`` and ``news`` are the evidence of the registry and of the
    candidates; a pair in both counts once, so that merging again changes nothing. Without them the greater count stays.
    """
    own = lambda c: F.col(c) if c in registry.columns else F.lit(None).cast("string")
    r = registry.select("id", "dimension", "name", "display_name", own("definition").alias("definition"), "status", "evidence", *[own(c).alias(c) for c in ("created_at", "updated_at", "reviewed_at", "review_source")]).alias("r")
    c = found.alias("c")
    both = r.join(c, F.col("r.id") == F.col("c.id"), "full_outer")
    pending, new = F.col("r.status") == "pending", F.col("r.id").isNull()
    fill = lambda name: F.when(pending, F.coalesce(F.nullif(f"r.{name}", F.lit("")), f"c.{name}")).when(new, F.col(f"c.{name}")).otherwise(F.col(f"r.{name}"))
    time = F.lit(at).cast("string")
    seen = pending & F.col("c.id").isNotNull()
    out = both.select(
        F.coalesce("r.id", "c.id").alias("id"), F.coalesce("r.dimension", "c.dimension").alias("dimension"), F.coalesce("r.name", "c.name").alias("name"), fill("display_name").alias("display_name"), fill("definition").alias("definition"),
        F.coalesce("r.status", F.lit("pending")).alias("status"), F.when(seen, F.greatest(F.coalesce("r.evidence", F.lit(0)), F.col("c.evidence"))).otherwise(F.coalesce("r.evidence", "c.evidence")).cast("bigint").alias("evidence"),
        F.coalesce("r.created_at", F.when(new, time)).alias("created_at"), F.when(seen | new, F.coalesce(time, "r.updated_at")).otherwise(F.col("r.updated_at")).alias("updated_at"), F.col("r.reviewed_at").alias("reviewed_at"), F.col("r.review_source").alias("review_source"),
        (seen | new).alias("__open"),
    )
    if known is None or news is None:
        return out.drop("__open")
    counts = known.unionByName(news).distinct().groupBy("id").agg(F.count("*").alias("__n"))
    return out.join(counts, "id", "left").withColumn("evidence", F.when(F.col("__open"), F.coalesce("__n", F.lit(0))).otherwise(F.col("evidence"))).drop("__open", "__n")


def _first_decisions(decisions: DataFrame) -> DataFrame:
    first = Window.partitionBy("id").orderBy("at")
    own: Column = F.col("definition") if "definition" in decisions.columns else F.lit(None).cast("string")
    valid = decisions.where("decision in ('approve', 'reject')").withColumn("rank", F.row_number().over(first)).where("rank = 1")
    return valid.select("id", "decision", collapsed(F.col("display_name"), 80).alias("renamed"), collapsed(own, 300).alias("redefined"))


def decided(registry: DataFrame, decisions: DataFrame, at: str | None = None, source: str = "teacher") -> DataFrame:
    """The registry after ``decisions`` (id, at, decision, display_name, perhaps definition): the first approve or reject of a pending item holds.

    An approval may rename and redefine. A decided item keeps when and by what it was reviewed.
    """
    pending = (F.col("status") == "pending") & F.col("decision").isNotNull()
    approved_ = pending & (F.col("decision") == "approve")
    change = lambda new, old: F.when(approved_, F.coalesce(F.nullif(new, F.lit("")), old)).otherwise(F.col(old))
    rows = registry.join(_first_decisions(decisions), "id", "left")
    out = {"display_name": change("renamed", "display_name"), "status": F.when(approved_, "approved").when(pending, "rejected").otherwise(F.col("status"))}
    if "definition" in registry.columns:
        out["definition"] = change("redefined", "definition")
        out |= {c: F.when(pending, F.lit(at)).otherwise(F.col(c)) for c in ("updated_at", "reviewed_at")} if at else {}
        out["review_source"] = F.when(pending, F.lit(source)).otherwise(F.col("review_source"))
    return rows.withColumns({"__pending": pending, **out}).select(*registry.columns)


def decision_counts(registry: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: applied, ignored. Of the decisions on a pending item the first approve or reject is applied, all others are ignored."""
    applied = _first_decisions(decisions).join(registry.where("status = 'pending'").select("id"), "id", "left_semi").agg(F.count("*").alias("applied"))
    return applied.join(F.broadcast(decisions.agg(F.count("*").alias("n")))).select("applied", (F.col("n") - F.col("applied")).alias("ignored"))  # one row each


def approved(registry: DataFrame) -> DataFrame:
    """dimension, name, display_name of the approved items; of one name the item of the greatest id."""
    return registry.where("status = 'approved'").groupBy("dimension", "name").agg(F.max_by("display_name", "id").alias("display_name"))
