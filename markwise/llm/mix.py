"""Mixing sources to target weights by systematic sampling.

Every document has an expected number of copies. Within the source the expectations are summed up along a fixed order, one
random offset is added, and a document comes once per integer that its step crosses. The order runs by size, so that
every stretch of sizes gets its share and the sizes add up as exactly as single documents allow.

A document of more than a hundredth of what its source shall give is drawn first, since with it a visible part of the
share is drawn or not; the others then expect what is still wanted. So a share misses its target by about one of the
smaller documents, unless these cannot make up for the large ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markwise.session import checkpointed

#: Documents of one size step of a source that a window part holds, about.
PART = 100_000
#: Steps of size per doubling. At most 64 doublings, so a source has at most 64 * STEPS groups per part.
STEPS = 8
#: A document is large if it has more than one in so many of the size that its source shall give.
LARGE = 100


def sampling_plan(sized: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """source, target_share, max_repeats, documents, available, expected, wanted: one row per target.

    ``available`` is the size of the source; ``wanted`` the size that it shall give; ``expected`` the copies of each
    document. The mix is as large as the caps allow with exact shares, or as ``total`` if that is less. A source
    without any size cannot contribute: it expects nothing and does not bound the others.
    """
    have = sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("size").alias("available"))
    plan = targets.select("source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
    plan = plan.where("source is not null").dropDuplicates(["source"]).join(have, "source", "left").na.fill(0, ["documents", "available"])
    reach = F.when((F.col("available") > 0) & (F.col("target_share") > 0), F.col("available") * F.greatest("max_repeats", F.lit(0)) / F.col("target_share"))
    # one row per source of the targets table: the window is as small as that table
    most = F.min(reach).over(Window.partitionBy(F.lit(1)))
    size = most if total is None else F.least(most, F.lit(float(total)))
    wanted = F.when(F.col("available") > 0, F.col("target_share") * size).otherwise(F.lit(0.0))
    return plan.withColumn("wanted", F.coalesce(wanted, F.lit(0.0))).withColumn("expected", F.when(F.col("available") > 0, _whole(F.least(F.col("wanted") / F.col("available"), F.col("max_repeats").cast("double")))).otherwise(F.lit(0.0)))


def _whole(value: Column) -> Column:
    """``value``, as a whole number where it differs from one by rounding only."""
    return F.when(F.abs(value - F.round(value)) < 1e-9, F.round(value)).otherwise(value)


def sampled(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` (doc_id, source, size, expected, documents) with ``copies``: systematic sampling along the order of sizes.

    ``expected`` is the same for all documents of a source. The prefix sums run in two levels, over groups of (source,
    step of size, hash part) and within each group, so no task ever holds a source.
    """
    parts = F.greatest(F.ceil(F.col("documents") / PART), F.lit(1))
    placed = docs.withColumn("step", F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * STEPS)).otherwise(-1).cast("int")).withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), parts).cast("int"))
    group = ["source", "step", "part"]
    before = Window.partitionBy("source").orderBy("step", "part").rowsBetween(Window.unboundedPreceding, -1)
    groups = placed.groupBy(*group).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy(*group).orderBy("size", F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id")
    offset = F.pmod(F.xxhash64(F.lit(seed + 2), "source"), F.lit(1 << 30)) / float(1 << 30)
    rank = F.col("before") + F.col("within")
    ranked = placed.withColumn("within", F.row_number().over(within)).join(groups, group)
    until = lambda r: F.floor(r * F.col("expected") + offset)
    return ranked.withColumn("copies", (until(rank) - until(rank - 1)).cast("int")).drop("step", "part", "before", "within")


def feasible(large: DataFrame) -> DataFrame:
    """The large documents with copies from which the others can reach what is wanted.

    If the others fall short even at max_repeats, the smallest large documents that were rounded down are rounded up until
    they do not; if the large ones alone exceed what is wanted, the smallest that were rounded up are rounded down.
    """
    of = Window.partitionBy("source")
    drawn, size = F.sum(F.col("size") * F.col("copies")).over(of), F.sum("size").over(of)
    missing = F.col("wanted") - drawn - (F.col("available") - size) * F.col("max_repeats")
    upwards = of.orderBy("size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    low, high = F.col("copies") < F.ceil("expected"), F.col("copies") > F.floor("expected")
    rows = large.withColumns({"missing": missing, "over": drawn - F.col("wanted")})
    rows = rows.withColumns({"up": F.coalesce(F.sum(F.when(low, F.col("size"))).over(upwards), F.lit(0)), "down": F.coalesce(F.sum(F.when(high, F.col("size"))).over(upwards), F.lit(0))})
    change = F.when(low & (F.col("up") < F.col("missing")), 1).when(high & (F.col("down") < F.col("over")), -1).otherwise(0)
    return rows.withColumn("copies", F.col("copies") + change).drop("missing", "over", "up", "down")


def mixed(sized: DataFrame, targets: DataFrame, seed: int = 17, total: float | None = None) -> DataFrame:
    """doc_id, source, size, copy: the mix, one row per copy (copies of a document count from 1).

    ``sized`` has doc_id, source and size. Documents without a source, or of a source that no target names, are not
    mixed; documents of size 0 are sampled like others. Ties of size are ordered by a hash of the id, repeated rows of one
    id are separate documents. No document has more than max_repeats copies, since the number of copies is the
    expectation rounded up or down, and no expectation exceeds max_repeats. Empty tables and targets give an empty mix.
    """
    plan = sampling_plan(sized, targets, total).where("expected > 0").select("source", "expected", "wanted", "available", "max_repeats", "documents")
    docs = sized.select("doc_id", "source", "size").where("source is not null").join(plan, "source")
    large = F.coalesce(F.col("size") * LARGE > F.col("wanted"), F.lit(False))
    first = checkpointed(feasible(sampled(docs.where(large), seed + 10)).select("doc_id", "source", "size", "copies"))
    drawn = first.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("drawn"), F.sum("size").alias("large"))
    left = docs.where(~large).join(drawn, "source", "left").na.fill(0, ["drawn", "large"])
    still = (F.col("wanted") - F.col("drawn")) / (F.col("available") - F.col("large"))
    # without large documents the expectation stays as it is; a rest without any size keeps it too
    expected = F.when((F.col("large") == 0) | (F.col("available") <= F.col("large")), F.col("expected")).otherwise(_whole(F.least(F.greatest(still, F.lit(0.0)), F.col("max_repeats").cast("double"))))
    rest = sampled(left.select("doc_id", "source", "size", expected.alias("expected"), "documents"), seed).select("doc_id", "source", "size", "copies")
    return first.unionByName(rest).where("copies > 0").select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))


def actual_shares(mix: DataFrame, sized: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """source, target_share, actual_share, miss, size, documents, copies, most_copies: what the mix holds of each target.

    ``miss`` is the difference of the shares, by the target. Sources that gave nothing have share 0; the shares of a mix of no size are 0.
    """
    got = (
        mix.groupBy("source", "doc_id").agg(F.sum("size").alias("size"), F.count("*").alias("copies"))
        .groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"))
    )
    plan = sampling_plan(sized, targets, total).select("source", "target_share")
    joined = plan.join(got, "source", "left").na.fill(0, ["size", "documents", "copies", "most_copies"])
    whole = F.sum("size").over(Window.partitionBy(F.lit(1)))
    actual = F.when(whole > 0, F.col("size") / whole).otherwise(F.lit(0.0))
    return joined.select("source", "target_share", actual.alias("actual_share"), F.when(F.col("target_share") > 0, actual / F.col("target_share") - 1).alias("miss"), "size", "documents", "copies", "most_copies")
