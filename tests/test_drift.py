import json
from collections import Counter, defaultdict

from markwise.operators import drift
from markwise.sources.tables import table

SCHEMA = "line_id long, file_id long, feed string, kind string, seq int, payload string, item string, path string"


def lines(spark, files, extra=()):
    """files: {(feed, seq): [object or text]}; file_id is ten times the feed's number and seq."""
    rows, n = [], 0
    for (feed, seq), items in files.items():
        for x in items:
            n += 1
            rows.append((n, int(feed) * 10 + seq, feed, "v2", seq, x if isinstance(x, str) else json.dumps(x), "clash", "clash"))
    return spark.createDataFrame(rows + list(extra), SCHEMA)


def found(spark, frame):
    return sorted(map(tuple, drift.changes(drift.delivered(frame)).collect()))


def item(i, **fields):
    return {"attempt_id": f"a{i}", "question_id": "q"} | fields


def test_renamed_retyped_removed_added(spark):
    one = [item(i, ocr=0.5 + i / 100, old="x", keep=i, flag=i % 2 == 0) for i in range(30)]
    two = [item(i, conf={"ocr": str(0.5 + i / 100)}, new=i * 7, keep=[i], flag=int(i % 2 == 0)) for i in range(10, 40)]
    want = [(12, "added", "", "new"), (12, "removed", "old", ""), (12, "renamed", "ocr", "conf.ocr"), (12, "retyped", "flag", "flag"), (12, "retyped", "keep", "keep"), (12, "retyped", "ocr", "conf.ocr")]
    assert found(spark, lines(spark, {("1", 1): one, ("1", 2): two})) == want


def test_rare_broken_repeated_and_odd_lines(spark):
    one = [item(i, v=i) for i in range(40)]
    two = [item(i, v=i) for i in range(20, 58)] + [item(58, v=58, stray=1), '{"attempt_id": "a1", "v', "[1]", "null", ""]
    frame = lines(spark, {("1", 1): one, ("1", 2): two})
    frame = frame.unionByName(frame).unionByName(spark.createDataFrame([(None, 12, "1", "v2", 2, '{"z": 1}', "", ""), (999, None, "1", "v2", 2, '{"z": 1}', "", ""), (998, 12, "1", "v2", 2, None, "", ""), (997, 12, None, "v2", 2, '{"z": 1}', "", ""), (996, 12, "1", "v2", None, '{"z": 1}', "", "")], SCHEMA))
    assert found(spark, frame) == []


def test_null_values_count_as_held_and_ties_have_a_result(spark):
    one = [item(i, a=None, b=1 if i % 2 else "1") for i in range(20)]
    two = [item(i, a=None, b="1") for i in range(20)]
    assert found(spark, lines(spark, {("1", 1): one, ("1", 2): two, ("2", 1): one})) == [(12, "retyped", "b", "b")]


def test_nulls_move_along_with_a_rename(spark):
    one = [item(i, a=None if i % 3 else i) for i in range(30)]
    two = [item(i, b=None if i % 3 else i) for i in range(30)]
    assert found(spark, lines(spark, {("1", 1): one, ("1", 2): two})) == [(12, "renamed", "a", "b")]


def test_empty_table(spark):
    assert found(spark, spark.createDataFrame([], SCHEMA)) == []


def brute(rows):
    """Changes by plain loops over whole files."""
    files = defaultdict(dict)
    info = {}
    for line, file, feed, seq, payload in rows:
        try:
            node = json.loads(payload)
        except ValueError:
            continue
        files[file][line] = dict(drift._leaves(node))
        info[file] = (feed, seq, {})
    out = set()
    at = {(f, s): k for k, (f, s, _) in info.items()}

    def fields(file):
        held = defaultdict(Counter)
        for leaf in files[file].values():
            for path, value in leaf.items():
                held[path][drift.type_of(value)] += 1
        kept = {p: c for p, c in held.items() if sum(c.values()) * 20 >= len(files[file])}
        return {p: min(((-n, t) for t, n in c.items() if t != "null"), default=(0, None))[1] for p, c in kept.items()}

    def values(file, path):
        return {(x.get("attempt_id"), x.get("question_id"), x.get("id")): drift.comparable(x[path]) for x in files[file].values() if path in x}

    for file, (feed, seq, _) in info.items():
        before = at.get((feed, max((s for f, s in at if f == feed and s < seq), default=None)))
        if before is None:
            continue
        now, old = fields(file), fields(before)
        gone, new = set(old) - set(now), set(now) - set(old)
        for g in sorted(gone):
            for n in sorted(new):
                a, b = values(before, g), values(file, n)
                both = [(a[k], b[k]) for k in a.keys() & b.keys() if a[k] is not None or b[k] is not None]
                if both and sum(x == y for x, y in both) >= 0.8 * len(both):
                    out.add((file, "renamed", g, n))
                    if old[g] != now[n]:
                        out.add((file, "retyped", g, n))
        taken = {r[2] for r in out if r[0] == file and r[1] == "renamed"}, {r[3] for r in out if r[0] == file and r[1] == "renamed"}
        out |= {(file, "removed", g, "") for g in gone - taken[0]} | {(file, "added", "", n) for n in new - taken[1]}
        out |= {(file, "retyped", p, p) for p in set(old) & set(now) if old[p] != now[p] and None not in (old[p], now[p])}
    return out


def test_the_test_data_by_brute_force(spark, data):
    rows = table(spark, data, "export_lines").select("line_id", "file_id", "feed", "seq", "payload").distinct().collect()
    got = found(spark, table(spark, data, "export_lines"))
    assert set(got) == brute(rows) and len(got) == len(set(got)) > 10


def test_consistent_table_and_replay(spark):
    one = [item(i, confidence={"ocr": 0.5 + i / 100}, score="3", scanner="SX") for i in range(30)]
    two = [item(i, ocr_conf=str(0.5 + i / 100), score=4 if i != 12 else "none", scanner="SX") for i in range(10, 40)]
    lines_ = drift.delivered(lines(spark, {("1", 1): one, ("1", 2): two}))
    items = drift.consistent(lines_, drift.changes(lines_))
    rows = {r["attempt_id"]: r for r in items.collect()}
    assert len(rows) == 40 and rows["a35"]["ocr_confidence"] == 0.85 and rows["a5"]["ocr_confidence"] == 0.55
    assert rows["a5"]["score"] == 3.0 and rows["a11"]["score"] == 4.0 and rows["a12"]["score"] is None
    assert rows["a12"]["rescued"] == {"scanner": '"SX"', "score": '"none"'}
    again = {r["attempt_id"]: r for r in drift.replay(items, "scanner", "string", ("scanner",)).collect()}
    assert again["a12"]["scanner"] == "SX" and again["a12"]["rescued"] == {"score": '"none"'} and again["a5"]["rescued"] == {}


def test_values_compare_across_types():
    same = drift.comparable
    assert same(5) == same(5.0) == same("5") == same([5]) == same("5.00") and same(True) == same("true") == same(1)
    assert same(None) is None and same([]) == "[]" and same("x") != same("X") and same("1e400") == "1e400"


def test_nothing_is_lost_where_paths_of_one_column_meet(spark):
    one = [item(1, confidence={"ocr": 0.9}, ocr_confidence=0.2, normalized_answer="A", student_answer="B"), item(2, score=3, is_correct="maybe"), item(3, score=[7])]
    two = [item(1, confidence={"ocr": None}), item(2, score=None), item(3, score="1e999")]
    lines_ = drift.delivered(lines(spark, {("1", 1): one, ("1", 2): two}))
    rows = {r["attempt_id"]: r for r in drift.consistent(lines_, spark.createDataFrame([], "file_id long, change string, old_path string, new_path string")).collect()}
    assert (rows["a1"]["ocr_confidence"], rows["a1"]["answer"], rows["a1"]["rescued"]) == (0.9, "A", {"ocr_confidence": "0.2", "student_answer": '"B"'})
    assert (rows["a2"]["score"], rows["a2"]["is_correct"], rows["a2"]["rescued"]) == (3.0, None, {"is_correct": '"maybe"'})
    assert (rows["a3"]["score"], rows["a3"]["rescued"]) == (None, {"score": '"1e999"'})
