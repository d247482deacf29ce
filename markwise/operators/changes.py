"""Keyed changes applied in order, and final figures after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unmatched(changes: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys that are changed but do not exist."""
    return changes.select(*keys).distinct().join(targets.select(*keys), keys, "left_anti")


def traced(changes: DataFrame, keys: list[str], order: list[str], value: str, start: DataFrame | None = None) -> DataFrame:
    """``changes`` with ``before``: the value that each change replaces, from the change before it or from ``start``.

    ``start`` has the keys and the value before any change; without it the first change replaces null. Ties of
    ``order`` must not occur.
    """
    chain = Window.partitionBy(*keys).orderBy(*order)
    if start is None:
        return changes.withColumn("before", F.lag(value).over(chain))
    own = start.select(*keys, F.col(value).alias("__start"))
    rows = changes.join(own, keys, "left").withColumn("__nth", F.row_number().over(chain))
    return rows.withColumn("before", F.when(F.col("__nth") == 1, F.col("__start")).otherwise(F.lag(value).over(chain))).drop("__start", "__nth")


def applied(targets: DataFrame, changes: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``targets`` with ``value`` as the last change of each key leaves it, and ``changed`` (how many there were).

    Only the last change of a key is shuffled: the maximum is taken before. A changed value may be null.
    """
    last = changes.groupBy(*keys).agg(F.max(F.struct(*[F.col(o) for o in order], F.col(value).alias("__new"))).alias("__last"), F.count("*").alias("__n"))
    both = targets.join(last, keys, "left")
    return both.withColumn(value, F.when(F.col("__n") > 0, F.col("__last.__new")).otherwise(F.col(value))).withColumn("changed", F.coalesce("__n", F.lit(0))).drop("__last", "__n")


def first_causal_step(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Per response: pieces of evidence, causal ones, and the least step of the causal ones (null without)."""
    step = F.col("step").try_cast("int")
    causal = F.col("causal_role") == "causal"
    return evidence.groupBy(*keys).agg(F.count("*").alias("evidence"), F.count_if(causal).alias("causal"), F.min(F.when(causal, step)).alias("first_step"))


def least_confidence(tags: Column) -> Column:
    """The least confidence of an array of tags; null without any."""
    return F.array_min(F.transform(tags, lambda t: t["confidence"]))


def dangling(ids: Column, known: Column) -> Column:
    """The ids of an array that another array does not hold."""
    return F.array_except(F.coalesce(ids, F.array().cast("array<string>")), F.coalesce(known, F.array().cast("array<string>")))
