import pytest

from markwise.llm import mix

SIZED = "doc_id long, source string, size long, expected int, copies int, part int"
TARGETS = "source string, target_share double, max_repeats int, size int"


def sized(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, 1) for r in rows], SIZED)


def test_shares_caps_and_integer_boundaries(spark):
    docs = sized(spark, [(i, "a", 100 + i % 50) for i in range(3000)] + [(10_000 + i, "b", 80 + i % 90) for i in range(400)] + [(20_000, None, 50), (20_001, "other", 50)])
    targets = spark.createDataFrame([("a", 0.5, 1, 0), ("b", 0.5, 4, 0)], TARGETS)
    rows = mix.mixed(docs, targets).collect()
    copies = {}
    for r in rows:
        copies.setdefault((r["source"], r["doc_id"]), []).append(r["copy"])
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in copies.values())
    plan = {r["source"]: r for r in mix.sampling_plan(docs, targets).collect()}
    for source, cap in (("a", 1), ("b", 4)):
        counts = [len(c) for (s, _), c in copies.items() if s == source]
        expected = plan[source]["expected"]
        assert max(counts) <= cap and abs(sum(counts) - expected * plan[source]["documents"]) <= 1 and set(counts) <= {int(expected), int(expected) + 1}
    shares = {r["source"]: r for r in mix.actual_shares(mix.mixed(docs, targets), docs, targets).collect()}
    assert all(abs(s["actual_share"] - 0.5) < 0.005 for s in shares.values()) and shares["b"]["most_copies"] <= 4
    assert {r["source"] for r in rows} == {"a", "b"}


def test_the_mix_is_the_same_however_the_rows_are_split(spark):
    docs = sized(spark, [(i, "ab"[i % 2], i % 30) for i in range(500)])
    targets = spark.createDataFrame([("a", 0.7, 2, 0), ("b", 0.3, 3, 0)], TARGETS)
    assert sorted(mix.mixed(docs.repartition(7), targets).collect()) == sorted(mix.mixed(docs.coalesce(1), targets).collect())


def test_total_size_nulls_empties_and_repeated_rows(spark):
    docs = sized(spark, [(1, "a", 10), (1, "a", 10), (2, "a", 0), (3, "a", 0), (None, "a", 10), (4, "b", 0)])
    targets = spark.createDataFrame([("a", 0.6, 2, 0), ("b", 0.2, 2, 0), ("gone", 0.2, 5, 0), (None, 0.1, 1, 0)], TARGETS)
    assert mix.mixed(docs, targets).groupBy("source").count().collect()[0][1] == 10
    shares = {r["source"]: r["actual_share"] for r in mix.actual_shares(mix.mixed(docs, targets), docs, targets).collect()}
    assert shares == {"a": 1.0, "b": 0.0, "gone": 0.0}
    assert mix.mixed(docs, targets, total=25.0).count() in (2, 3)  # 15 of 30 units: half a copy of each of five documents
    assert mix.mixed(docs.limit(0), targets).count() == 0 and mix.mixed(docs, targets.limit(0)).count() == 0


def test_query_over_the_test_data(spark, data):
    from markwise.llm import queries as q

    shares = q.p7_shares(spark, data).collect()
    caps = {r["source"]: r["max_repeats"] for r in spark.read.parquet(f"{data}/mix_targets.parquet").collect()}
    assert len(shares) == len(caps) and sum(r["actual_share"] for r in shares) == pytest.approx(1.0)
    assert all(r["most_copies"] <= caps[r["source"]] for r in shares)
    assert q.p7_mix(spark, data).select("doc_id", "copy").distinct().count() == q.p7_mix(spark, data).count()


def test_shares_where_no_text_is_a_hundredth_of_its_source(spark):
    import random

    rng = random.Random(3)
    sized = spark.createDataFrame([(i, "abc"[i % 3], int(rng.paretovariate(1.6) * 40) % 2000) for i in range(9000)], "doc_id long, source string, size long")
    targets = spark.createDataFrame([("a", 0.6, 2), ("b", 0.3, 3), ("c", 0.1, 4)], "source string, target_share double, max_repeats int")
    shares = mix.actual_shares(mix.mixed(sized, targets), sized, targets).collect()
    assert len(shares) == 3 and all(abs(r["miss"]) < 0.02 and r["most_copies"] <= {"a": 2, "b": 3, "c": 4}[r["source"]] for r in shares)


def test_a_text_of_a_fifth_of_its_source_is_made_up_for(spark):
    rows = [(i, "a", 10) for i in range(800)] + [(900, "a", 2000)] + [(1000 + i, "b", 10) for i in range(500)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long")
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    for seed in range(4):
        got = mix.mixed(sized, targets, seed).groupBy("source").sum("size").collect()
        assert {r[0] for r in got} == {"a", "b"} and abs(got[0][1] - got[1][1]) <= 20
