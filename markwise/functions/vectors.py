"""Similarities of weighted sets and of vectors, as higher-order functions inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag_map(tags: Column, dimension: str) -> Column:
    """Names of one dimension with their confidence (1 for null); a later duplicate wins. Empty for null tags."""
    mine = F.filter(F.coalesce(tags, F.array().cast("array<struct<dimension:string,name:string,confidence:double>>")), lambda t: (t["dimension"] == dimension) & t["name"].isNotNull())
    keys = F.array_distinct(F.transform(mine, lambda t: t["name"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(F.element_at(F.filter(mine, lambda t: t["name"] == k), -1)["confidence"], F.lit(1.0))))


def weighted_jaccard(left: Column, right: Column) -> Column:
    """Sum of the lesser over sum of the greater weights; null if both are empty, 0 if the weights are 0."""
    zipped = F.map_zip_with(left, right, lambda _, a, b: F.struct(F.least(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))).alias("lo"), F.greatest(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))).alias("hi")))
    values = F.map_values(zipped)
    total = lambda part: F.aggregate(values, F.lit(0.0), lambda s, x: s + x[part])
    return F.when((F.size(left) == 0) & (F.size(right) == 0), None).when(total("hi") == 0, 0.0).otherwise(total("lo") / total("hi"))


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two arrays of one length above 0, else null; 0 where a norm is 0."""
    dot = F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((F.size(left) != F.size(right)) | (F.size(left) <= 0) | left.isNull() | right.isNull(), None).when((norm(left) == 0) | (norm(right) == 0), 0.0).otherwise(dot / (norm(left) * norm(right)))
