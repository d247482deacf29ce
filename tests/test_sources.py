import json

import pytest

from markwise import cli
from markwise.plans.class_report import report_model
from markwise.plans.exam_views import placed
from markwise.sources import exports, json_documents, registry, report
from markwise.streaming import deliveries


def test_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"attempts": [{"attempt_id": "x"}, {"attempt_id": "y"}]}')
    (tmp_path / "b.json").write_text("{")
    (tmp_path / "c.json").write_text("[1]")
    (tmp_path / "d.json").write_text('{"x": "' + "y" * 500 + '"}')
    docs = json_documents.read_documents(spark, str(tmp_path), largest=200)
    assert {r["doc_id"][-6:]: r["fault"] for r in docs.collect()} == {"a.json": None, "b.json": "not JSON", "c.json": "no object", "d.json": "too large"}
    assert json_documents.document_table(docs, "attempts", ["attempts"], {}, ["attempt_id"], ["pos"]).count() == 2
    with pytest.raises(ValueError, match="too large"):
        json_documents.require_sound(docs)


def test_registry_round_trip(spark, tmp_path):
    path = str(tmp_path / "registry")
    assert registry.load_registry(spark, path).count() == 0
    items = spark.createDataFrame([("error-1", "error", "n", "d", None, "pending", 1, "2026", "2026", None, None)], registry.SCHEMA)
    registry.save_registry(items, path)
    registry.save_registry(items.unionByName(spark.createDataFrame([("error-2", "error", "m", "d", "x", "approved", 1, "2026", "2026", "2026", "teacher")], registry.SCHEMA)), path)
    assert registry.load_registry(spark, path).count() == 2
    with pytest.raises(ValueError, match="id repeated"):
        registry.save_registry(items.unionByName(items), path)
    assert registry.load_registry(spark, path).count() == 2


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("=1+1", 1), ('a"b', 2)], "name string, n int")
    exports.write_csv(rows, ["name", "n"], str(tmp_path / "csv"))
    text = "".join(p.read_bytes().decode() for p in (tmp_path / "csv").glob("part-*"))
    assert '"name","n"\r\n' in text and "\"'=1+1\",\"1\"\r\n" in text and '"a""b","2"\r\n' in text
    decisions = spark.createDataFrame([("x", 2, "b"), ("x", 1, "a")], "analysis string, pos int, decision string")
    assert json.loads(exports.decision_documents(decisions, ["analysis"], ["pos"], ["decision"]).first()["document"])["decisions"] == [{"pos": 1, "decision": "a"}, {"pos": 2, "decision": "b"}]


def test_report(spark, data, tmp_path):
    chosen = placed(spark, data).where("class_id is not null").first()["class_id"]
    model = report_model(spark, data, chosen)
    assert report.faults(model) == [] and model["student_count"] > 0
    page = report.render(model | {"title": "</script><b>&"})
    assert "</script><b>" not in page and page == report.render(dict(reversed((model | {"title": "</script><b>&"}).items())))
    assert report.write(page, str(tmp_path / "x" / "r.html"))["output_sha256"]
    with pytest.raises(ValueError, match="unknown"):
        report.render(model | {"more": 1})
    with pytest.raises(ValueError, match="locked"):
        report.render(model, report.TEMPLATE + " ")


def test_report_lists_are_whole(spark, data, tmp_path):
    rows = placed(spark, data).where("class_id is not null").select("class_id", "question_id", "student_ref", "response_id", "review_status").toPandas()
    chosen = rows.groupby("class_id")["question_id"].nunique().idxmax()
    mine = rows[rows["class_id"] == chosen]
    waiting = mine[mine["review_status"].isin(["needs_review", "provisional"])]
    model = report_model(spark, data, chosen)
    assert len(model["priority_questions"]) == mine["question_id"].nunique() > 50
    assert len(model["student_summaries"]) == mine["student_ref"].fillna("").nunique()
    assert {x["response_id"] for x in model["review_items"]} == set(waiting["response_id"]) and len(model["review_items"]) == len(waiting)
    paged = report_model(spark, data, chosen, rows_to=str(tmp_path / "rows"), page=50)
    assert paged["priority_questions"] == model["priority_questions"][:50] and any("priority_questions" in note for note in paged["notes"])
    assert spark.read.parquet(str(tmp_path / "rows" / "priority_questions")).count() == len(model["priority_questions"])
    assert report.faults(paged) == report.faults(model) == [] and report.render(model)


def test_command_line(spark, data, tmp_path, capsys):
    assert cli.main(["query", data, "class_summary", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
    assert cli.main(["query", data, "nothing", str(tmp_path / "out")]) == 2 and "no query" in capsys.readouterr().err


def test_command_line_of_the_vocabulary(spark, tmp_path, capsys):
    path = str(tmp_path / "registry")
    registry.save_registry(spark.createDataFrame([("error-1", "error", "n", "d", None, "pending", 1, "2026", "2026", None, None)], registry.SCHEMA), path)
    (tmp_path / "d.json").write_text(json.dumps({"decisions": [{"id": "error-1", "action": "approve", "display_name": "New", "definition": "x"}, {"id": "error-1", "action": "reject"}, {"id": "zz", "action": "approve"}]}))
    assert cli.main(["vocabulary", path, str(tmp_path / "d.json")]) == 0 and json.loads(capsys.readouterr().out) == {"applied": 1, "ignored": 2}
    item = registry.load_registry(spark, path).first()
    assert (item["status"], item["display_name"], item["definition"], item["review_source"]) == ("approved", "New", "x", "teacher") and item["reviewed_at"]


def test_streams(spark, data, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "attempts.parquet").symlink_to(f"{data}/attempts.parquet")
    batch = spark.read.parquet(str(source))
    stream = lambda: spark.readStream.schema(batch.schema).parquet(str(source))
    deliveries.drained(deliveries.first_deliveries(stream(), "100000 hours"), "once", str(tmp_path / "c1"))
    assert spark.table("once").count() == batch.select("attempt_id", "submitted_at").distinct().count()
    deliveries.drained(deliveries.with_moment(stream(), spark.read.parquet(f"{data}/org_settings.parquet")), "moments", str(tmp_path / "c2"))
    assert spark.table("moments").where("submitted_us is not null").count() > 0.8 * batch.count()
    deliveries.drained(deliveries.deliveries_by_window(stream(), "1 day", "100000 hours"), "windows", str(tmp_path / "c3"), "complete")
    assert sum(r["deliveries"] for r in spark.table("windows").collect()) == batch.count()
