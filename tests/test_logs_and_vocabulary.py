import json

from pyspark.sql import functions as F

from markwise.functions.hashing import digest
from markwise.operators import audit, documents, statistics, validation, vocabulary
from markwise.plans.exam_views import joined
from markwise.sources.registry import SCHEMA


def test_chain_breaks_where_it_was_changed(spark):
    events = spark.createDataFrame([("a", i, f"h{i}") for i in range(5)] + [("b", 0, "h"), (None, 0, "h")], "c string, i int, payload_hash string")
    log = audit.chained(events, "c", ["i"])
    assert log.count() == 6 and audit.broken(log, "c").count() == 0
    changed = log.withColumn("payload_hash", F.when((F.col("c") == "a") & (F.col("event_pos") == 3), "x").otherwise(F.col("payload_hash")))
    assert [tuple(r) for r in audit.broken(changed, "c").collect()] == [("a", 3, "event_hash")]
    cut = log.where("not (c = 'a' and event_pos = 3)")
    assert [tuple(r) for r in audit.broken(cut, "c").collect()] == [("a", 4, "previous_hash")]
    longer = audit.appended(log, spark.createDataFrame([("a", 9, "n1"), ("a", 10, "n2"), ("d", 1, "n")], "c string, i int, payload_hash string"), "c", ["i"])
    assert longer.count() == 9 and audit.broken(longer, "c").count() == 0
    assert audit.chained(events.limit(0), "c", ["i"]).count() == 0


def test_document_logs(spark):
    base = {"x": 1.0, "audit_log": [{"event_id": "e1", "event_type": "t", "payload_hash": "p", "timestamp": "2026"}]}
    bare = spark.createDataFrame([("ok", json.dumps(base))], "doc_id string, payload string")
    fixed = json.loads(documents.repaired(bare, "2026-01-01T00:00:00Z").first()["payload"])
    assert documents.verified(bare).count() == 2 and len(fixed["audit_log"]) == 2
    assert documents.verified(spark.createDataFrame([("ok", json.dumps(documents.with_event(fixed, {"event_id": "e3"})))], "doc_id string, payload string")).count() == 0
    odd = fixed | {"audit_log": [fixed["audit_log"][0], 5, fixed["audit_log"][1]]}
    assert {r["fault"] for r in documents.verified(spark.createDataFrame([("odd", json.dumps(odd))], "doc_id string, payload string")).collect()} == {"audit_log[1]: no object"}
    frame = spark.createDataFrame([("ok", json.dumps(fixed)), ("state", json.dumps(fixed | {"x": 2})), ("none", "{}"), ("broken", "{"), ("null", None)], "doc_id string, payload string")
    got = {(r["doc_id"], r["fault"]) for r in documents.verified(frame).collect()}
    assert got == {("state", "audit_log: state differs"), ("none", "audit_log: empty"), ("broken", "payload: no JSON object"), ("null", "payload: no JSON object")}
    again = documents.repaired(frame.where("doc_id in ('state', 'none')"), "2026-01-01T00:00:00Z")
    assert documents.verified(again).count() == 0
    assert digest({"b": 1, "a": 2}) == digest({"a": 2, "b": 1})


def test_vocabulary_life_cycle(spark):
    tags = spark.createDataFrame(
        [("error", "New  Slip", None, 2, "q1", "s1"), ("error", "new slip", "First", 1, "q1", "s1"), ("error", "new slip", "", 3, "q2", "s1"), ("cognitive", "x", None, 1, "q", "s"), ("error", " ", None, 1, "q", "s"), (None, None, None, None, None, None)],
        "dimension string, name string, display_name string, at long, question_id string, student_ref string",
    )
    found = vocabulary.candidates(tags)
    row = found.collect()
    assert len(row) == 1 and (row[0]["name"], row[0]["display_name"], row[0]["evidence"]) == ("new slip", "First", 2)
    registry = vocabulary.merged(spark.createDataFrame([], SCHEMA), found, at="2026-01-01")
    assert (registry.first()["status"], registry.first()["created_at"]) == ("pending", "2026-01-01")
    pairs = vocabulary.evidence(tags)
    more = tags.unionByName(spark.createDataFrame([("error", "NEW SLIP", None, 9, "q3", "s9")], tags.schema))
    once = vocabulary.merged(registry, vocabulary.candidates(more), pairs, vocabulary.evidence(more))
    assert once.first()["evidence"] == 3 == vocabulary.merged(once, vocabulary.candidates(more), vocabulary.evidence(more), vocabulary.evidence(more)).first()["evidence"]
    item = row[0]["id"]
    decisions = spark.createDataFrame([(item, 1, "later", "?"), (item, 2, "approve", "Renamed"), (item, 3, "reject", ""), ("x", 1, "approve", "")], "id string, at long, decision string, display_name string")
    done = vocabulary.decided(registry, decisions)
    assert (done.first()["status"], done.first()["display_name"]) == ("approved", "Renamed")
    assert vocabulary.decided(done, decisions.where("decision = 'reject'")).first()["status"] == "approved"
    assert vocabulary.merged(done, found).first()["evidence"] == 2
    assert tuple(vocabulary.decision_counts(registry, decisions).first()) == (1, 3)
    assert [tuple(r) for r in vocabulary.approved(done).collect()] == [("error", "new slip", "Renamed")] and vocabulary.approved(registry).count() == 0


def test_statistics_of_nothing(spark, data):
    rows = joined(spark, data).limit(0)
    assert tuple(statistics.overall(rows).first()) == (0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0)
    assert statistics.error_pairs(rows).count() == 0
    assert statistics.tag_distribution(rows, "knowledge").count() == 0


def test_missing_references(spark):
    child = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    assert [r[0] for r in validation.missing_references(child, spark.createDataFrame([("a",)], "k string"), "k").collect()] == ["b"]
