"""Schemas that drift between files: one consistent table, a rescue column, and a list of every change.

Rescue-column ingestion. Every file is taken in under a schema, and values at paths that the schema does not know are
rescued instead of dropped:

* under the schema of the file before it (:func:`changes`): what is rescued is new, what the schema names and the file
  lacks is gone, and the rescued values are replayed into the columns that went empty. Where they carry the values of the
  items that both files hold, the field was renamed; other rescued fields were added, other empty columns removed;
* under the target schema (:func:`consistent`): paths are translated back by those renames and cast; what no target names,
  what cannot be cast, and what another path of the same column outdid, stays as JSON in ``rescued``, from which
  :func:`replay` promotes a field later.

Lines are parsed in Arrow batches; what leaves Python is counts per file, hashes of the few values that moved, or one
finished row per line.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markwise.operators.nested import complete, spelled
from markwise.session import checkpointed, stored

#: A file has a field if at least one in so many of its lines holds it.
ONE_IN = 20
#: Share of equal values among the items of both files from which a field counts as carried on.
CARRIED = 0.8


def _leaves(node: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    stack = [(node, prefix)]
    while stack:
        part, at = stack.pop()
        for key, value in part.items():
            if isinstance(value, dict):
                stack.append((value, f"{at}{key}."))
            else:
                yield at + key, value


def type_of(value: object) -> str:
    """string, number, boolean, array or null."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int | float):
        return "number"
    return "array" if isinstance(value, list) else "string"


def unwrapped(value: object) -> object:
    """The lone entry of a list of one, at any depth; other values as they are."""
    while isinstance(value, list) and len(value) == 1:
        value = value[0]
    return value


def comparable(value: object) -> str | None:
    """One spelling for a value whatever its type: lone list entries unwrapped, numbers and truth values by meaning.

    ``[5]``, ``5``, ``5.0`` and ``"5"`` are alike; so are ``true``, ``1`` and ``"True"``. None for null.
    """
    value = unwrapped(value)
    if value is None:
        return None
    if isinstance(value, bool):
        return "1" if value else "0"
    text = spelled(value).strip()
    if text.lower() in ("true", "false"):
        return "1" if text.lower() == "true" else "0"
    if len(text) < 40 and (text[:1].isdigit() or text[:1] in ("+", "-", ".")):
        try:
            number = Decimal(text)
            if number.is_finite() and abs(number.adjusted()) < 40:
                return format(number.normalize() if number else Decimal(0), "f")
        except InvalidOperation:
            pass
    return text


def _whole(text: str) -> tuple[bool, object]:
    """Whether a text is complete JSON, and its value."""
    node = complete(text)
    return node is not None or text.strip() == "null", node


def _item(node: dict) -> str | None:
    """What a line is about: the attempt and question id, or the id of an extension; None where it names none."""
    keys = [node.get(k) for k in KEYS]
    return spelled([spelled(k) for k in keys]) if any(k is not None for k in keys) else None


def delivered(lines: DataFrame) -> DataFrame:
    """Each line once, as feed, seq, file_id, kind, line_id, payload, kept as a table in the shared folder.

    Lines without line_id, file_id, feed, seq or payload cannot be told apart or placed and are left out. Of different
    lines of one line_id the least by feed, seq, file_id, kind and payload counts.
    """
    named = lines.where(" and ".join(f"{c} is not null" for c in ("line_id", "file_id", "feed", "seq", "payload")))
    order = Window.partitionBy("line_id").orderBy("feed", "seq", "file_id", "kind", "payload")
    columns = ("feed", "seq", "file_id", "kind", "line_id", "payload")
    return stored(named.select(*columns).withColumn("nth", F.row_number().over(order)).where("nth = 1").select(*columns))


_KINDS = {str: "string", int: "number", float: "number", bool: "boolean", list: "array", type(None): "null"}


def _shape(node: dict) -> tuple[str, ...]:
    """Paths and types of an object's leaves in turn."""
    out: list[str] = []
    stack = [(node, "")]
    while stack:
        part, at = stack.pop()
        for key, value in part.items():
            if isinstance(value, dict):
                stack.append((value, f"{at}{key}."))
            else:
                out += (at + key if at else key, _KINDS[type(value)])
    return tuple(out)


def field_counts(lines: DataFrame) -> DataFrame:
    """feed, seq, file_id, path, type, n: how many lines of a file hold a path with a type; a null path counts the lines.

    Only complete JSON counts; a complete value that is no object has no fields. Counts are added up inside each
    task, so a few rows per file leave a partition.
    """

    def flushed(seen: Counter) -> pa.RecordBatch:
        rows: Counter = Counter()
        for (feed, seq, file_id, shape), n in seen.items():  # few shapes of lines per file
            for path, kind in ((None, None),) if shape is None else zip(shape[::2], shape[1::2], strict=True):
                rows[feed, seq, file_id, path if path is None else spelled(path), kind] += n
        columns = [*zip(*rows, strict=True), list(rows.values())] if rows else [[]] * 6
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["feed", "seq", "file_id", "path", "type", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for feed, seq, file_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole, node = _whole(text)
                if whole:
                    seen[feed, seq, file_id, None] += 1
                    if isinstance(node, dict):
                        seen[feed, seq, file_id, _shape(node)] += 1
            if len(seen) > 50_000:  # of this size at most is the memory of a task
                yield flushed(seen)
                seen = Counter()
        yield flushed(seen)

    rows = lines.select("feed", "seq", "file_id", "payload").mapInArrow(run, "feed string, seq int, file_id bigint, path string, type string, n bigint")
    return rows.groupBy("feed", "seq", "file_id", "path", "type").agg(F.sum("n").alias("n"))


def file_fields(counts: DataFrame) -> DataFrame:
    """feed, seq, file_id, path, type of every field that a file has; ties between types go to the first by name.

    The type is null for a field that holds nulls only.
    """
    files = counts.where("path is null").select("feed", "seq", "file_id", F.col("n").alias("lines"))
    held = counts.where("path is not null").groupBy("feed", "seq", "file_id", "path").agg(F.sum("n").alias("n"), F.min(F.when(F.col("type") != "null", F.struct(-F.col("n"), F.col("type").alias("type")))).alias("top"))
    return held.join(files, ["feed", "seq", "file_id"]).where(F.col("n") * ONE_IN >= F.col("lines")).select("feed", "seq", "file_id", "path", F.col("top.type").alias("type"))


def _pairs_of_files(counts: DataFrame) -> DataFrame:
    """Each file with the one before it in its feed: feed, seq, file_id, before."""
    files = counts.where("path is null").select("feed", "seq", "file_id")
    order = Window.partitionBy("feed").orderBy("seq", "file_id")
    return files.withColumn("before", F.lag("file_id").over(order)).where("before is not null").select("feed", "seq", "file_id", "before")


def moved_values(lines: DataFrame, moved: DataFrame) -> DataFrame:
    """file_id, item, path, rescued, same: the values of the paths that ``moved`` names, for every line that names an item.

    ``moved`` has at (the file whose lines hold the path), file_id (the file whose change it belongs to), path and rescued
    (the path is unknown to the schema of the file before). Items and values are 64-bit hashes; a null value is null.
    """
    wanted = moved.groupBy("at").agg(F.to_json(F.collect_list(F.struct("file_id", "path", "rescued"))).alias("wanted"))  # the fields of one file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for wanted, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                node = complete(text)
                item = _item(node) if isinstance(node, dict) else None
                if item is None:
                    continue
                key, paths = _digest(item), _by_path(wanted)
                for path, value in _leaves(node):
                    for file_id, rescued in paths.get(spelled(path), ()):
                        same = comparable(value)
                        out.append((file_id, key, path, rescued, None if same is None else _digest(same)))
            if out:
                columns = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["file_id", "item", "path", "rescued", "same"])

    held = lines.select(F.col("file_id").alias("at"), "payload").join(wanted, "at").select("wanted", "payload")
    return held.mapInArrow(run, "file_id bigint, item bigint, path string, rescued boolean, same bigint")


@lru_cache(maxsize=1000)
def _by_path(text: str) -> dict[str, list[tuple[int, bool]]]:
    out: dict[str, list[tuple[int, bool]]] = {}
    for w in json.loads(text):
        out.setdefault(w["path"], []).append((w["file_id"], w["rescued"]))
    return out


@lru_cache(maxsize=1000)
def _roots(text: str) -> dict[str, str]:
    return json.loads(text)


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def changes(lines: DataFrame) -> DataFrame:
    """Every change of every file against the one before it in its feed: file_id, change, old_path, new_path.

    ``lines`` come from :func:`delivered`. ``renamed``, ``removed`` (no new path), ``added`` (no old path) and
    ``retyped`` (both). Of the possible renames of a file the one that carries the most values is taken first; each path
    is used once. A file without a predecessor has no change; a field of nulls only has no type and is not retyped.
    """
    counts = checkpointed(field_counts(lines))
    fields, steps = file_fields(counts), _pairs_of_files(counts)
    now = steps.join(fields.select("file_id", "path", "type"), "file_id")
    schema = steps.join(fields.select(F.col("file_id").alias("before"), "path", F.col("type").alias("old_type")), "before")
    both = now.select("file_id", "before", "path", "type", F.lit(True).alias("has")).join(schema.select("file_id", F.col("before").alias("at"), "path", "old_type", F.lit(True).alias("knows")), ["file_id", "path"], "full_outer")
    state = checkpointed(both.select("file_id", F.coalesce("before", "at").alias("before"), "path", "type", "old_type", F.when(F.col("knows").isNull(), "rescued").when(F.col("has").isNull(), "empty").otherwise("known").alias("state")))

    # the rescued values of a file, and the last values of the columns that it leaves empty
    rescued = F.col("state") == "rescued"
    moved = state.where("state <> 'known'").select(F.when(rescued, F.col("file_id")).otherwise(F.col("before")).alias("at"), "file_id", "path", rescued.alias("rescued"))
    values = moved_values(lines, moved).groupBy("file_id", "item", "path", "rescued").agg(F.min("same").alias("same"))
    side = lambda mine: F.collect_list(F.when(mine, F.struct("path", "same")))
    of_item = values.groupBy("file_id", "item").agg(side(~F.col("rescued")).alias("last"), side(F.col("rescued")).alias("came"))  # the moved fields of one item
    matches = (
        of_item.select("file_id", "came", F.explode("last").alias("o")).select("file_id", "o", F.explode("came").alias("n"))
        .select("file_id", F.col("o.path").alias("old_path"), F.col("o.same").alias("a"), F.col("n.path").alias("new_path"), F.col("n.same").alias("b"))
        .groupBy("file_id", "old_path", "new_path")
        .agg(
            F.count_if(F.col("a").isNotNull() | F.col("b").isNotNull()).alias("valued"),
            F.count_if(F.col("a") == F.col("b")).alias("equal"),
            F.count_distinct(F.when(F.col("a") == F.col("b"), F.col("a"))).alias("kinds"),
        )
        .where(F.col("equal") >= F.col("valued") * CARRIED)
        .where("equal > 0")
    )
    ranked = matches.repartition("file_id").sortWithinPartitions("file_id", F.desc("kinds"), F.desc(F.col("equal") / F.col("valued")), F.desc("equal"), "old_path", "new_path")
    renamed = checkpointed(ranked.select("file_id", "old_path", "new_path").mapInPandas(_assign, "file_id long, old_path string, new_path string"))

    was = state.where("state = 'empty'").select("file_id", F.col("path").alias("old_path"), "old_type")
    new = state.where("state = 'rescued'").select("file_id", F.col("path").alias("new_path"), "type")
    named = renamed.join(was, ["file_id", "old_path"]).join(new, ["file_id", "new_path"])
    rest = lambda side, name: side.join(renamed.select("file_id", name), ["file_id", name], "left_anti")
    known = state.where("state = 'known'").select("file_id", F.col("path").alias("old_path"), F.col("path").alias("new_path"), "old_type", "type")
    retyped = known.unionByName(named.select("file_id", "old_path", "new_path", "old_type", "type")).where(F.col("type") != F.col("old_type"))
    row = lambda df, change, a, b: df.select("file_id", F.lit(change).alias("change"), a.alias("old_path"), b.alias("new_path"))
    return (
        row(named, "renamed", F.col("old_path"), F.col("new_path"))
        .unionByName(row(rest(was, "old_path"), "removed", F.col("old_path"), F.lit("")))
        .unionByName(row(rest(new, "new_path"), "added", F.lit(""), F.col("new_path")))
        .unionByName(row(retyped, "retyped", F.col("old_path"), F.col("new_path")))
    )


def _assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One-to-one choice among the pairs of each file, which come together and best first."""
    at, old, new = None, set(), set()
    for batch in batches:
        out = []
        for file_id, old_path, new_path in zip(batch["file_id"], batch["old_path"], batch["new_path"], strict=True):
            if file_id != at:
                at, old, new = file_id, set(), set()
            if old_path not in old and new_path not in new:
                old.add(old_path)
                new.add(new_path)
                out.append((file_id, old_path, new_path))
        yield pd.DataFrame(out, columns=["file_id", "old_path", "new_path"])


#: Approved fields of the target table: column, type, and the first paths it may have in a feed.
TARGETS: dict[str, tuple[str, tuple[str, ...]]] = {
    "schema_version": ("string", ("schema_version",)),
    "ocr_confidence": ("double", ("confidence.ocr", "ocr_confidence")),
    "grading_confidence": ("double", ("confidence.grading", "grading_confidence")),
    "tagging_confidence": ("double", ("confidence.tagging",)),
    "score": ("double", ("score",)),
    "max_score": ("double", ("max_score",)),
    "is_correct": ("boolean", ("is_correct",)),
    "review_status": ("string", ("review_status",)),
    "answer": ("string", ("normalized_answer", "student_answer")),
    "corrected_text": ("string", ("corrected_text",)),
    "difficulty": ("string", ("difficulty",)),
    "first_error_step": ("int", ("first_error_step",)),
    "source_document_id": ("string", ("source.document_id",)),
    "source_page": ("int", ("source.page",)),
    "dimension": ("string", ("dimension",)),
    "display_name": ("string", ("display_name",)),
    "definition": ("string", ("definition",)),
    "status": ("string", ("status",)),
    "created_at": ("string", ("created_at",)),
}
KEYS = ("attempt_id", "question_id", "id")


def first_paths(lines: DataFrame, found: DataFrame) -> DataFrame:
    """file_id, path, root: what each renamed path was called in the first file of its feed that held it.

    Paths that never were renamed are left out. One task handles the change rows (not the lines) of one feed.
    """
    order = lines.select("feed", "seq", "file_id").distinct()
    news = found.where("change <> 'retyped'").select("file_id", F.struct("change", "old_path", "new_path").alias("c")).groupBy("file_id").agg(F.collect_list("c").alias("cs"))

    def follow(files: pd.DataFrame) -> pd.DataFrame:
        now: dict[str, str] = {}
        out = []
        for r in files.sort_values(["seq", "file_id"]).itertuples():
            before = dict(now)
            for c in r.cs if r.cs is not None else ():
                if c["change"] == "added":
                    now.pop(c["new_path"], None)
                else:
                    now.pop(c["old_path"], None)
            for c in r.cs if r.cs is not None else ():
                if c["change"] == "renamed":
                    now[c["new_path"]] = before.get(c["old_path"], c["old_path"])
            out += [(r.file_id, path, root) for path, root in now.items()]
        return pd.DataFrame(out, columns=["file_id", "path", "root"])

    return order.join(news, "file_id", "left").select("feed", "seq", "file_id", "cs").groupBy("feed").applyInPandas(follow, "file_id long, path string, root string")


_NUMBER = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?")
#: A singleton that stays itself when functions are sent to the workers.
_FAILED = NotImplemented


def cast(kind: str, value: object) -> object:
    """A JSON value as string, boolean, double or int; None for a null (also in a list of one); ``_FAILED`` if it does not fit."""
    value = unwrapped(value)
    if value is None:
        return None
    if kind == "string":
        return spelled(value)
    same = comparable(value)
    if kind == "boolean":
        return {"1": True, "0": False}.get(same, _FAILED)
    if not _NUMBER.fullmatch(same):
        return _FAILED
    number = float(same)
    if abs(number) == float("inf"):
        return _FAILED
    if kind == "double":
        return number
    return int(number) if number.is_integer() and abs(number) < 1 << 31 else _FAILED


_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32()}


def enforced(lines: DataFrame, found: DataFrame, targets: dict[str, tuple[str, tuple[str, ...]]]) -> DataFrame:
    """One row per line: feed, kind, seq, line_id, item, its ids, one typed column per target, ``failed``, ``rescued``.

    Paths are translated by the renames in ``found``. Of several paths of one target the first, in the target's order,
    that holds a castable value gives the column; the values of the others are rescued, each under its own first path. ``failed`` names the columns for
    which a line holds only values that cannot be cast.
    """
    roots = first_paths(lines, found).groupBy("file_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("path", "root")))).alias("roots"))  # the fields of one file
    place = {path: (name, kind, rank) for name, (kind, paths) in targets.items() for rank, path in enumerate(paths)}
    names = ["feed", "kind", "seq", "line_id", "item", *KEYS, *targets, "failed", "rescued"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), *[pa.string()] * len(KEYS), *[_ARROW[k] for k, _ in targets.values()], pa.list_(pa.string()), pa.map_(pa.string(), pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for feed, kind_, seq, line_id, text, roots in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole, node = _whole(text)
                if not whole:
                    continue
                node = node if isinstance(node, dict) else {}
                translate = _roots(roots) if roots else {}
                own: dict[str, tuple] = {}
                kept: dict[str, object] = {}
                failed = set()
                for path, value in sorted(_leaves(node), key=lambda x: x[0]):
                    path = spelled(path)
                    root = translate.get(path, path)
                    if root in KEYS:
                        own.setdefault(root, (0, spelled(unwrapped(value)), root, value))
                    elif root not in place:
                        kept[root] = value
                    else:
                        name, kind, rank = place[root]
                        fit = cast(kind, value)
                        if fit is _FAILED:
                            kept[root] = value
                            failed.add(name)
                        elif fit is not None:
                            held = own.get(name)
                            if held is None or rank < held[0]:
                                own[name] = (rank, fit, root, value)
                                lost = held
                            else:
                                lost = (rank, fit, root, value)
                            if lost is not None:
                                kept[lost[2]] = lost[3]
                values = [own[c][1] if c in own else None for c in (*KEYS, *targets)]
                rescue = [(path, json.dumps(value, ensure_ascii=True, separators=(",", ":"))) for path, value in kept.items()]
                rows.append((feed, kind_, seq, line_id, _item(node) or f"line {line_id}", *values, sorted(failed.difference(own)), rescue))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    held = lines.join(roots, "file_id", "left").select("feed", "kind", "seq", "line_id", "payload", "roots")
    schema = "feed string, kind string, seq int, line_id bigint, item string, " + ", ".join(f"{k} string" for k in KEYS) + ", " + ", ".join(f"{n} {k}" for n, (k, _) in targets.items()) + ", failed array<string>, rescued map<string,string>"
    return held.mapInArrow(run, schema)


def consistent(lines: DataFrame, found: DataFrame, targets: dict[str, tuple[str, tuple[str, ...]]] | None = None) -> DataFrame:
    """One row per item of a feed: feed, kind, item, its ids, one typed column per target, and ``rescued``.

    Where files disagree, the latest one that holds a value (not null) wins, within a file the line of the greatest id; a
    latest value that cannot be cast leaves the column null.
    ``rescued`` maps every other path (under its first name) to its latest JSON text: fields that no target names, values
    that cannot be cast, and values that another path of the same column outdid. A line that names no item is an item of
    its own. Lines are reduced per column before the shuffle, so an item of a third of all lines costs no more.
    """
    targets = targets or TARGETS
    rows = stored(enforced(lines, found, targets))
    latest = [F.max(F.when(F.col(c).isNotNull() | F.array_contains("failed", c), F.struct("seq", "line_id", c))).alias(c) for c in (*KEYS, *targets)]
    typed = rows.groupBy("feed", "kind", "item").agg(*latest).select("feed", "kind", "item", *[F.col(f"{c}.{c}").alias(c) for c in (*KEYS, *targets)])
    cells = rows.select("feed", "kind", "item", "seq", "line_id", F.explode("rescued").alias("path", "value"))
    cells = cells.groupBy("feed", "kind", "item", "path").agg(F.max(F.struct("seq", "line_id", "value")).alias("v"))
    rescued = cells.groupBy("feed", "kind", "item").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "v.value")))).alias("rescued"))  # the paths of one item
    same = F.lit(True)
    for c in ("feed", "kind", "item"):
        same = same & typed[c].eqNullSafe(rescued[c])
    none = F.expr("cast(map() as map<string,string>)")
    return typed.join(rescued, same, "left").select(*[typed[c] for c in ("feed", "kind", "item", *KEYS, *targets)], F.coalesce(rescued["rescued"], none).alias("rescued"))


def _typed(kind: str, plain, same):
    if kind == "boolean":
        return F.when(same == "1", True).when(same == "0", False)
    if kind == "string":
        return plain
    number = same.try_cast("double")
    return number if kind == "double" else F.when(number == F.floor(number), number.try_cast(kind))


def replay(items: DataFrame, column: str, kind: str, paths: tuple[str, ...]) -> DataFrame:
    """``items`` with ``column`` promoted: values of ``paths`` move from ``rescued`` into the typed column.

    The first path that holds a castable value wins; what cannot be cast stays rescued. An existing column keeps
    its values and is filled only where it is null.
    """
    raw = [F.try_element_at(F.col("rescued"), F.lit(p)) for p in paths]
    text = [F.when(r != "null", F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), r, F.lit("}")), "$.v"), r)) for r in raw]
    bare = [F.regexp_replace(t, r'^\["?|"?\]$', "") for t in text]
    same = [F.when(F.lower(b) == "true", "1").when(F.lower(b) == "false", "0").otherwise(b) for b in bare]
    values = [_typed(kind, b, s) for b, s in zip(bare, same, strict=True)]
    filled = F.coalesce(*([F.col(column)] if column in items.columns else []), *values)
    gone = F.array(*[F.when(v.isNotNull() | (r == "null"), F.lit(p)) for p, v, r in zip(paths, values, raw, strict=True)])
    return items.withColumns({column: filled, "rescued": F.map_filter("rescued", lambda k, _: ~F.coalesce(F.array_contains(gone, k), F.lit(False)))})
