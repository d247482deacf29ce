"""Queries of the rules over class records, with their SQL, which is built from the same table of rules but tests fields by JSON types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from markwise.operators import document_rules as rules
from markwise.plans.review_queries import REVIEW, Records
from markwise.sources.tables import table


def record_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every rule of shape, type and value that a class record breaks."""
    return rules.all_violations(rules.documents(table(spark, folder, "class_records")))


def record_links(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated ids, unknown questions, scores outside their range and evidence that is not there in the class records."""
    t = Records(spark, folder)
    return rules.broken_links(t.attempts, t.responses, t.evidence, t.tags, t.questions)


def _holds(test: str, key: str, values: tuple[str, ...] = ()) -> str:
    kind, text, part = f"json_type(x, '$.{key}')", f"(x ->> '$.{key}')", f"(x -> '$.{key}')"
    null = f"({kind} IS NULL OR {kind} = 'NULL')"
    if test.endswith("_or_null"):
        return f"({null} OR {_holds(test[:-8], key, values)})"
    is_text, number = f"{kind} = 'VARCHAR'", f"{kind} IN ('BIGINT', 'UBIGINT', 'DOUBLE')"
    entries = f"TRY_CAST({part} AS JSON[])"
    scalar = "json_type(i) IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN', 'NULL')"
    values_sql = ", ".join(f"'{v}'" for v in values)
    return {
        "id": f"({is_text} AND regexp_full_match({text}, '[A-Za-z0-9][A-Za-z0-9._-]{{0,127}}'))",
        "text": f"({is_text} AND trim({text}) <> '')",
        "long": f"({is_text} AND length({text}) <= 100000)",
        "name": f"({is_text} AND trim({text}) <> '' AND length({text}) <= 100 AND NOT regexp_matches({text}, '[\\x00-\\x1f]'))",
        "one_of": f"({is_text} AND {text} IN ({values_sql}))",
        "score": f"({kind} IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'VARCHAR') AND TRY_CAST({text} AS DECIMAL(20,6)) >= 0)",
        "number": f"({kind} IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'VARCHAR') AND TRY_CAST({text} AS DECIMAL(20,6)) IS NOT NULL)",
        "confidence": f"({null} OR ({number} AND CAST({text} AS DOUBLE) BETWEEN 0 AND 1))",
        "positive": f"({kind} IN ('BIGINT', 'UBIGINT') AND CAST({text} AS DOUBLE) >= 1)",
        "list": f"{kind} = 'ARRAY'",
        "list_or_none": f"({kind} IS NULL OR {kind} = 'ARRAY')",
        "filled": f"({kind} = 'ARRAY' AND json_array_length(x, '$.{key}') > 0)",
        "texts": f"({kind} = 'ARRAY' AND len(list_filter({entries}, lambda i: json_type(i) <> 'VARCHAR')) = 0)",
        "answer": f"({null} OR {is_text} OR {number} OR {kind} = 'BOOLEAN' OR ({kind} = 'ARRAY' AND len(list_filter({entries}, lambda i: NOT {scalar})) = 0))",
        "moment": f"({is_text} AND regexp_full_match({text}, '\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}(:\\d{{2}}([.,]\\d{{1,6}})?)?(Z|[+-]\\d{{2}}:?\\d{{2}}(:?\\d{{2}})?)') AND TRY_CAST(replace({text}, ',', '.') AS TIMESTAMPTZ) IS NOT NULL)",
        "digest": f"({is_text} AND regexp_full_match({text}, 'sha256:[0-9a-f]{{64}}'))",
        "box": f"({kind} = 'ARRAY' AND json_array_length(x, '$.{key}') = 4 AND len(list_filter({entries}, lambda i: json_type(i) NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE'))) = 0 AND CAST(x ->> '$.{key}[2]' AS DOUBLE) >= CAST(x ->> '$.{key}[0]' AS DOUBLE) AND CAST(x ->> '$.{key}[3]' AS DOUBLE) >= CAST(x ->> '$.{key}[1]' AS DOUBLE))",
    }[test]


def _rules_sql() -> str:
    parts = ["WITH root AS (SELECT record_id, 'root' AS location, CAST(payload AS JSON) AS x FROM class_records WHERE record_id IS NOT NULL AND json_valid(payload) QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY loaded_at DESC, payload DESC) = 1)"]
    found = []
    for name, k in rules.KINDS.items():
        if k.parent:
            at = f"CASE WHEN location = 'root' THEN '{k.step}' ELSE location || '.{k.step}' END"
            if k.many:
                inner = f"(SELECT record_id, {at} AS at_, CASE WHEN json_type(x, '$.{k.step}') = 'ARRAY' THEN CAST(x -> '$.{k.step}' AS JSON[]) ELSE [] END AS l FROM {k.parent})"
                parts.append(f"{name} AS (SELECT record_id, at_ || '[' || i || ']' AS location, x FROM (SELECT record_id, at_, unnest(l) AS x, unnest(range(len(l))) AS i FROM {inner}))")
            else:
                parts.append(f"{name} AS (SELECT record_id, {at} AS location, x -> '$.{k.step}' AS x FROM {k.parent} WHERE json_type(x, '$.{k.step}') IS NOT NULL)")
        names = lambda keys: "[" + ", ".join(f"'{n}'" for n in keys) + "]"
        tests = ", ".join(f"CASE WHEN NOT coalesce({_holds(*rule)}, false) THEN '{rule[1]}: {rule[0]}' END" for rule in k.rules)
        wrong = (
            f"list_transform(list_filter(CAST({names(k.required)} AS VARCHAR[]), lambda n: NOT list_contains(json_keys(x), n)), lambda n: 'missing ' || n) || "
            f"list_transform(list_filter(json_keys(x), lambda n: NOT list_contains({names((*k.required, *k.optional))}, n)), lambda n: 'unsupported ' || n) || list_filter(CAST([{tests}] AS VARCHAR[]), lambda t: t IS NOT NULL)"
        )
        keep = "json_type(x) <> 'NULL'" if name in rules.NULLABLE else "true"
        found.append(f"SELECT record_id, location, unnest(CASE WHEN json_type(x) = 'OBJECT' THEN {wrong} ELSE ['no object'] END) AS rule FROM {name} WHERE {keep}")
    return ",\n".join(parts) + "\n" + "\nUNION ALL ".join(found)


LINKS = (
    REVIEW
    + """, ids AS (SELECT record_id, attempt_pos, response_pos, list(x ->> '$.evidence_id') AS own FROM e GROUP BY ALL),
named AS (SELECT t.record_id, t.attempt_pos, t.response_pos, tag_pos, CAST(CAST(x -> '$.evidence_ids' AS JSON) AS VARCHAR[]) AS wanted, coalesce(own, []) AS own FROM t LEFT JOIN ids USING (record_id, attempt_pos, response_pos) WHERE json_type(x, '$.evidence_ids') = 'ARRAY'),
spots AS (SELECT record_id, 'attempts[' || attempt_pos || ']' AS location, 'attempt_id: repeated' AS rule FROM a WHERE attempt_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record_id, attempt_id ORDER BY attempt_pos) > 1
UNION ALL SELECT record_id, 'paper.questions[' || question_pos || ']', 'question_id: repeated' FROM q WHERE question_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record_id, question_id ORDER BY question_pos) > 1
UNION ALL SELECT record_id, 'attempts[' || attempt_pos || '].responses[' || response_pos || ']', 'question_id: repeated' FROM r WHERE question_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record_id, attempt_pos, question_id ORDER BY response_pos) > 1
UNION ALL SELECT record_id, 'attempts[' || attempt_pos || '].responses[' || response_pos || '].evidence[' || evidence_pos || ']', 'evidence_id: repeated' FROM e WHERE x ->> '$.evidence_id' IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record_id, attempt_pos, response_pos, x ->> '$.evidence_id' ORDER BY evidence_pos) > 1
UNION ALL SELECT record_id, 'attempts[' || attempt_pos || '].responses[' || response_pos || ']', 'question_id: unknown' FROM r WHERE NOT EXISTS (FROM n WHERE n.record_id = r.record_id AND n.question_id = r.question_id)
UNION ALL SELECT s.record_id, 'attempts[' || attempt_pos || '].responses[' || response_pos || ']', 'score: outside the range' FROM s JOIN n USING (record_id, question_id) WHERE own < 0 OR own > coalesce(top, 0)
UNION ALL SELECT record_id, 'attempts[' || attempt_pos || '].responses[' || response_pos || '].error_tags[' || tag_pos || ']', 'evidence_ids: unknown evidence' FROM named WHERE len(list_filter(wanted, lambda i: NOT list_contains(own, i))) > 0
UNION ALL SELECT record_id, 'attempts[' || attempt_pos || '].responses[' || response_pos || '].error_tags[' || tag_pos || ']', 'evidence_ids: none' FROM t WHERE json_array_length(x, '$.evidence_ids') = 0 AND json_type(x, '$.evidence_ids') = 'ARRAY' AND coalesce(x ->> '$.name', '') <> 'unclassified')
SELECT * FROM spots"""
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    return {f.__name__: f for f in (record_rules, record_links)}


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return {"record_rules": _rules_sql(), "record_links": LINKS}
