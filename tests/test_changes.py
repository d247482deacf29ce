from pyspark.sql import functions as F

from markwise.operators import changes


def test_traced_applied_and_unmatched(spark):
    news = spark.createDataFrame([("a", 1, 10), ("a", 2, None), ("a", 3, 30), ("b", 1, 5), ("x", 1, 9)], "k string, at int, v int")
    base = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    assert sorted((r["k"], r["at"], r["before"]) for r in changes.traced(news, ["k"], ["at"], "v", base).collect()) == [("a", 1, 1), ("a", 2, 10), ("a", 3, None), ("b", 1, 2), ("x", 1, None)]
    assert sorted((r["k"], r["before"] or 0) for r in changes.traced(news, ["k"], ["at"], "v").collect()) == [("a", 0), ("a", 0), ("a", 10), ("b", 0), ("x", 0)]
    assert sorted(map(tuple, changes.applied(base, news, ["k"], ["at"], "v").collect())) == [("a", 30, 3), ("b", 5, 1), ("c", 3, 0)]
    assert [r[0] for r in changes.unmatched(news, base, ["k"]).collect()] == ["x"]
    assert changes.applied(base, news.limit(0), ["k"], ["at"], "v").where("changed > 0").count() == 0


def test_arrays(spark):
    row = spark.createDataFrame([(["a", "b"], ["b"], [("e", "x", 0.5), ("e", "y", None)])], "ids array<string>, known array<string>, t array<struct<dimension:string,name:string,confidence:double>>")
    got = row.select(changes.dangling(F.col("ids"), F.col("known")), changes.dangling(F.lit(None).cast("array<string>"), F.col("known")), changes.least_confidence(F.col("t"))).first()
    assert tuple(got) == (["a"], [], 0.5)


def test_old_tags_and_evidence(spark):
    from markwise.operators import migration

    tags = "array<struct<dimension:string,name:string,confidence:double>>"
    old = "array<struct<observed:string,explanation:string,step:string,confidence:double>>"
    frame = spark.createDataFrame([("q", [("error", "e", 0.5), ("knowledge", "k", None), (None, "x", None)], [("saw", None, "2", 0.9), (None, "so", "2.5", None)]), ("r", None, None)], f"question_id string, tags {tags}, evidence {old}")
    own, errors = migration.split_tags(F.col("tags"))
    rows = frame.select(own.alias("own"), errors.alias("errors"), migration.migrated_evidence(F.col("question_id"), F.col("evidence")).alias("evidence")).collect()
    assert [t["name"] for t in rows[0]["own"]] == ["k"] and [t["name"] for t in rows[0]["errors"]] == ["e"] and rows[1]["own"] == rows[1]["evidence"] == []
    assert [tuple(e) for e in rows[0]["evidence"]] == [("ev-q-1", "saw", "", "causal", 2, 0.9), ("ev-q-2", "", "so", "consequential", None, None)]
