"""Command line: ``python -m markwise.cli report FOLDER CLASS OUT.html``, ``query FOLDER NAME OUT`` (Parquet) and
``vocabulary REGISTRY DECISIONS.json``, which applies decisions to a stored registry."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from markwise.operators import vocabulary
from markwise.plans import class_report, data_queries, exam_queries, review_queries, rule_queries
from markwise.sources import registry, report


def main(arguments: list[str]) -> int:
    """0 when done; 2, with a line on stderr, where the input is at fault."""
    parser = argparse.ArgumentParser(prog="markwise")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("report")
    for name in ("folder", "class_id", "out"):
        one.add_argument(name)
    two = commands.add_parser("query")
    for name in ("folder", "name", "out"):
        two.add_argument(name)
    three = commands.add_parser("vocabulary")
    for name in ("registry", "decisions"):
        three.add_argument(name)
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("markwise").getOrCreate()
    try:
        if given.command == "report":
            print(report.write(report.render(class_report.report_model(spark, given.folder, given.class_id, rows_to=f"{given.out}.rows")), given.out)["report"])
        elif given.command == "vocabulary":
            items = registry.load_registry(spark, given.registry)
            read = spark.read.option("multiLine", True).schema("decisions array<struct<id:string,action:string,display_name:string,definition:string>>").json(given.decisions)
            decisions = read.select(F.posexplode("decisions").alias("at", "d")).select("d.id", "at", F.col("d.action").alias("decision"), "d.display_name", "d.definition")
            counts = vocabulary.decision_counts(items, decisions).first().asDict()
            registry.save_registry(vocabulary.decided(items, decisions, datetime.now(timezone.utc).isoformat(timespec="seconds")), given.registry)
            print(json.dumps(counts))
        else:
            known = exam_queries.queries() | data_queries.queries() | review_queries.queries() | rule_queries.queries()
            if given.name not in known:
                raise ValueError(f"no query {given.name}")
            known[given.name](spark, given.folder).write.mode("overwrite").parquet(given.out)
    except (ValueError, OSError) as fault:
        print(f"ERROR: {fault}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
