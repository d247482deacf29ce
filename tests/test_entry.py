import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_core_stands_without_the_language_model_package():
    code = "import sys; sys.modules['markwise.llm'] = None\nimport __spark_entry__ as e\nassert 'p1_found' in e.queries() and 'p6_ids' not in e.queries()\nassert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_outside_imports_it():
    for file in (ROOT / "markwise").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT).parts:
            assert "markwise.llm" not in file.read_text()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    workers = spark.range(2).select("id").mapInPandas(lambda batches: (b.assign(id=len(__import__("markwise.operators.nested").__name__)) for b in batches), "id long")
    assert {r["id"] for r in workers.collect()} == {len("markwise")}
