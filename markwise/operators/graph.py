"""Graph of question similarity by shared tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markwise.functions.numeric import percentage

# The weight of each dimension in the similarity.
WEIGHTS = {"knowledge": 0.55, "cognitive": 0.28, "error": 0.17}


def node_statistics(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """Per question: responses, scored, correct (marked so, scored or not), correct_rate (null where none is scored), review_count, lost_score, size, grp.

    ``size`` is 8 and twice the lost score, at least 8. ``grp`` is the knowledge tag of the highest confidence, the
    first of equals, else unclassified.
    """
    lost = F.coalesce(F.sum(F.when(F.col("score_u").isNotNull(), F.col("max_u") - F.col("score_u"))), F.lit(0))
    got = rows.groupBy("question_id").agg(
        F.count("*").alias("responses"), F.count_if(F.col("score_u").isNotNull()).alias("scored"), F.count_if(F.col("is_correct").eqNullSafe(F.lit(True))).alias("correct"),
        F.count_if(F.col("review_status").isin("needs_review", "provisional")).alias("review_count"), lost.alias("lost_u"),
    )
    top = F.expr("array_sort(transform(filter(tags, t -> t.dimension = 'knowledge'), (t, i) -> struct(-coalesce(t.confidence, 1.0) as c, i, t.name as name)))[0].name")
    all_ = questions.select("question_id", F.coalesce(top, F.lit("unclassified")).alias("grp")).join(got, "question_id", "left").na.fill(0, ["responses", "scored", "correct", "review_count"])
    points = (F.coalesce("lost_u", F.lit(0)).cast("decimal(38,0)") / 1_000_000).cast("double")
    return all_.select("question_id", "grp", "responses", "scored", "correct", F.when(F.col("scored") > 0, percentage(F.col("correct"), F.col("scored"))).alias("correct_rate"), "review_count", points.alias("lost_score"), F.greatest(F.lit(8.0), 8 + 2 * points).alias("size"))


def tag_weights(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """question_id, dimension, name, weight: question tags (a later duplicate wins) and the highest confidence of each error tag."""
    own = (
        questions.select("question_id", F.posexplode("tags").alias("at", "t")).where("t.dimension in ('knowledge', 'cognitive') and t.name is not null")
        .groupBy("question_id", F.col("t.dimension").alias("dimension"), F.col("t.name").alias("name")).agg(F.max(F.struct("at", F.coalesce("t.confidence", F.lit(1.0)).alias("w"))).alias("m"))
        .select("question_id", "dimension", "name", F.col("m.w").alias("weight"))
    )
    errors = rows.select("question_id", F.explode("error_tags").alias("t")).where("t.name is not null").groupBy("question_id", F.lit("error").alias("dimension"), F.col("t.name").alias("name")).agg(F.max(F.coalesce("t.confidence", F.lit(1.0))).alias("weight"))
    return own.unionByName(errors)


def edges(weights: DataFrame, threshold: float = 0.2) -> DataFrame:
    """source, target (source < target), weight and one column per dimension: weighted Jaccard per dimension (null where both
    questions lack it), averaged over the dimensions present.

    Pairs come from an inverted index on shared tags, which finds every pair above 0; ``threshold`` must be positive.
    The sum of the greater weights follows from the two totals less the shared lesser ones, so only shared tags are
    joined. Dimensions that both questions lack do not count; one that a single question has counts as 0.
    """
    if threshold <= 0:
        raise ValueError("threshold must be above 0: pairs that share no tag have weight 0")
    totals = weights.groupBy("question_id").agg(*[F.coalesce(F.sum(F.when(F.col("dimension") == d, F.col("weight"))), F.lit(-1.0)).alias(d) for d in WEIGHTS])
    left = weights.select("dimension", "name", F.col("question_id").alias("source"), F.col("weight").alias("a"))
    right = weights.select("dimension", "name", F.col("question_id").alias("target"), F.col("weight").alias("b"))
    shared = left.join(right, ["dimension", "name"]).where("source < target").groupBy("source", "target").agg(*[F.coalesce(F.sum(F.when(F.col("dimension") == d, F.least("a", "b"))), F.lit(0.0)).alias(f"{d}_lo") for d in WEIGHTS])
    side = lambda name: totals.select(F.col("question_id").alias(name), *[F.col(d).alias(f"{d}_{name}") for d in WEIGHTS])
    both = shared.join(side("source"), "source").join(side("target"), "target")
    top, bottom = F.lit(0.0), F.lit(0.0)
    parts = {}
    for d, w in WEIGHTS.items():
        s, t, lo = F.col(f"{d}_source"), F.col(f"{d}_target"), F.col(f"{d}_lo")
        present = (s >= 0) | (t >= 0)
        high = F.greatest(s, F.lit(0.0)) + F.greatest(t, F.lit(0.0)) - lo
        parts[d] = F.when(present, F.when(high > 0, lo / high).otherwise(0.0))
        top = top + F.when(present & (high > 0), w * lo / high).otherwise(0.0)
        bottom = bottom + F.when(present, w).otherwise(0.0)
    rounded = lambda value: F.round(value.cast("decimal(18,9)"), 4).cast("double")
    return both.withColumn("weight", top / bottom).where(F.col("weight") >= threshold).select("source", "target", rounded(F.col("weight")).alias("weight"), *[rounded(part).alias(d) for d, part in parts.items()])


def legend(nodes: DataFrame) -> DataFrame:
    """grp, nodes, responses, review_count of every group of nodes: what a viewer can filter by, with its size."""
    return nodes.groupBy("grp").agg(F.count("*").alias("nodes"), F.sum("responses").alias("responses"), F.sum("review_count").alias("review_count"))
