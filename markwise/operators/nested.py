"""Nested JSON records to related flat tables.

Each record is parsed as a stream: the reader follows the text along the repeated parts and decodes one value at a time,
so that no tree of the record is built, and emits (path, ordinals, value) triples. Paths are grouped by their deepest
repeated ancestor, and each group is pivoted into one table by a single aggregation on the record and its ordinals. Key
fields of the ancestors travel with every group, so no join is needed to keep the parent-child links.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from json.decoder import scanstring

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markwise.session import shipped, stored

#: The field that takes what a group holds beside its wanted fields, as one JSON object.
REST = "(rest)"
TRIPLE = "record string, loaded bigint, version bigint, grp string, ordinals array<int>, field string, value string"


def complete(text: object) -> object | None:
    """The value of a complete JSON text, else None. NaN and Infinity are no JSON; too deep nesting counts as incomplete."""
    try:
        return _DECODER.decode(text)
    except (ValueError, RecursionError, TypeError):
        return None


def _refuse(name: str) -> object:
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_constant=_refuse)
_COMPACT = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


def spelled(value: object) -> str | None:
    """A leaf as text: strings as they are, everything else as compact JSON; None for null. Half surrogate pairs become U+FFFD."""
    if value is None:
        return None
    text = value if isinstance(value, str) else _COMPACT(value)
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class Raw(str):
    """The text of a value that is nested too deeply to be decoded."""


_BLANK = re.compile(r"[ \t\n\r]*").match


def _key(text: str, i: int) -> tuple[str, int]:
    """The key that begins at ``i`` and where its value begins."""
    if text[i : i + 1] != '"':
        raise ValueError("no key")
    key, i = scanstring(text, i + 1, True)
    i = _BLANK(text, i).end()
    if text[i : i + 1] != ":":
        raise ValueError("no colon")
    return key, _BLANK(text, i + 1).end()


def _skipped(text: str, i: int) -> int:
    """Where the value that begins at ``i`` ends, at any depth; ValueError if it is no complete JSON."""
    open_: list[str] = []
    while True:
        char = text[i : i + 1]
        if char in ("{", "["):
            inner = _BLANK(text, i + 1).end()
            close = "}" if char == "{" else "]"
            if text[inner : inner + 1] != close:
                open_.append(close)
                i = _key(text, inner)[1] if char == "{" else inner
                continue
            i = inner + 1
        else:
            _, i = _DECODER.raw_decode(text, i)
        while open_:
            i = _BLANK(text, i).end()
            char = text[i : i + 1]
            i = _BLANK(text, i + 1).end() if char == "," else i + 1
            if char == ",":
                i = _key(text, i)[1] if open_[-1] == "}" else i
                break
            if char != open_[-1]:
                raise ValueError("not closed")
            open_.pop()
        else:
            return i


class Stream:
    """Triples of one record, read from its text in one pass.

    What it keeps are the finished triples, since a text that is cut off gives none; key fields may stand behind the
    lists that inherit them, so objects of repeated parts share their parent's dict of keys until the text has ended.
    """

    def __init__(self, repeated: frozenset[str], keys: dict[str, tuple[str, ...]], wanted: dict[str, frozenset[str]] | None):
        self.repeated, self.keys, self.wanted = repeated, keys, wanted
        #: Paths of plain objects that hold repeated parts.
        self.leading = frozenset(p[:i] for p in repeated for i, c in enumerate(p) if c == ".")
        self.rows: list[tuple | None] = []

    def triples(self, text: object) -> list[tuple]:
        """(group, ordinals, field, value) of every object; nothing if the text is null or not one complete JSON object.

        Every object of a repeated part gives a triple with an empty field, so that objects without fields stay rows.
        """
        self.rows = []
        try:
            i = _BLANK(text, 0).end()
            if text[i : i + 1] != "{" or _BLANK(text, self.row(text, i, "", (), ())).end() != len(text):
                return []
        except (ValueError, TypeError, RecursionError, StopIteration):
            return []
        out = []
        for path, ordinals, held, fields, rest in filter(None, self.rows):
            out.append((path, ordinals, "", None))
            mine = None if self.wanted is None else self.wanted[path]
            out += [(path, ordinals, k, v) for d in held for k, v in d.items() if mine is None or k in mine]
            out += [(path, ordinals, k, spelled(v)) for k, v in fields.items()]
            if rest:
                out.append((path, ordinals, REST, "{" + ",".join(f"{_COMPACT(k)}:{v if isinstance(v, Raw) else _COMPACT(v)}" for k, v in sorted(rest.items())) + "}"))
        return [(g, o, f, v if v is None or v.isascii() else spelled(v)) for g, o, f, v in out]

    def row(self, text: str, i: int, path: str, ordinals: tuple[int, ...], held: tuple[dict, ...]) -> int:
        """Reads the object of a repeated part that begins at ``i``; where it ends."""
        mine = self.wanted is None or path in self.wanted
        fields, rest, below = {}, {}, dict.fromkeys(self.keys.get(path, ()))
        if mine:
            self.rows.append((path, ordinals, held, fields, rest))
        return self.object(text, i, path, "", ordinals, (*held, below), fields, rest if mine else {}, below)

    def object(self, text: str, i: int, path: str, prefix: str, ordinals: tuple[int, ...], held: tuple[dict, ...], fields: dict, rest: dict, below: dict) -> int:
        i = _BLANK(text, i + 1).end()
        if text[i : i + 1] == "}":
            return i + 1
        spans: dict[str, tuple[int, int]] = {}
        while True:
            key, i = _key(text, i)
            field = prefix + key
            at = f"{path}.{field}" if path else field
            if at in self.repeated:
                if at in spans:  # of repeated keys the last counts
                    first, last = spans[at]
                    self.rows[first:last] = [None] * (last - first)
                start = len(self.rows)
                i = self.many(text, i, at, ordinals, held)
                spans[at] = (start, len(self.rows))
            elif at in self.leading and text[i : i + 1] == "{":
                i = self.object(text, i, path, f"{field}.", ordinals, held, fields, rest, below)
            else:
                try:
                    value, i = _DECODER.raw_decode(text, i)
                except RecursionError:
                    start, i = i, _skipped(text, i)
                    value = Raw(text[start:i])
                self.leaf(path, field, value, fields, rest, below)
            i = _BLANK(text, i).end()
            if text[i : i + 1] == "}":
                return i + 1
            if text[i : i + 1] != ",":
                raise ValueError("object not closed")
            i = _BLANK(text, i + 1).end()

    def leaf(self, path: str, field: str, value: object, fields: dict, rest: dict, below: dict) -> None:
        """Keeps a value that holds no repeated part; plain objects become dotted fields unless they are wanted themselves."""
        if field in below:
            below[field] = spelled(value)
        wanted = None if self.wanted is None else self.wanted.get(path, frozenset())
        stack = [(field, value)]
        while stack:
            name, value = stack.pop()
            if isinstance(value, dict) and (wanted is None or name not in wanted) and (value or wanted is None or REST not in wanted):
                stack += [(f"{name}.{k}", v) for k, v in value.items()]
            elif wanted is None or name in wanted:
                fields[name] = value
            elif REST in wanted:
                rest[name] = value

    def many(self, text: str, i: int, at: str, ordinals: tuple[int, ...], held: tuple[dict, ...]) -> int:
        """Reads a repeated part as delivered: a list, a lone object, or the JSON text of either; anything else holds nothing."""
        char = text[i : i + 1]
        if char == '"':
            inner, end = scanstring(text, i + 1, True)
            start = len(self.rows)
            try:
                j = _BLANK(inner, 0).end()
                if inner[j : j + 1] in ("[", "{") and _BLANK(inner, self.many(inner, j, at, ordinals, held)).end() != len(inner):
                    raise ValueError("more behind it")
            except (ValueError, StopIteration):
                del self.rows[start:]
            return end
        if char == "{":
            return self.row(text, i, at, (*ordinals, 0), held)
        if char != "[":
            return _skipped(text, i)
        i, n = _BLANK(text, i + 1).end(), 0
        if text[i : i + 1] == "]":
            return i + 1
        while True:
            i = self.row(text, i, at, (*ordinals, n), held) if text[i : i + 1] == "{" else _skipped(text, i)
            n += 1
            i = _BLANK(text, i).end()
            if text[i : i + 1] == "]":
                return i + 1
            if text[i : i + 1] != ",":
                raise ValueError("list not closed")
            i = _BLANK(text, i + 1).end()


def triples(df: DataFrame, record: str, payload: str, repeated: list[str], keys: dict[str, list[str]], wanted: dict[str, list[str]] | None = None, loaded: str | None = None) -> DataFrame:
    """Triples of every record: record, loaded, version, grp (path of the repeated ancestor, '' for the record), ordinals, field, value.

    ``repeated`` are the paths that hold many objects; ``keys`` names per group the fields that all groups below
    inherit; ``wanted`` limits the output to some fields of some groups, of which ``REST`` takes all others. A payload that is null or not one complete
    JSON object gives nothing. Null entries of a list keep their ordinal and give nothing. An object inside a plain
    object is read as dotted fields unless it is a wanted field itself; a list that is not in ``repeated`` is a value, kept as JSON.
    ``loaded`` and ``version`` (a hash of the payload) tell deliveries of one record apart; ``loaded`` names a timestamp.
    """
    shipped(df.sparkSession)
    many, inherit = frozenset(repeated), {k: tuple(v) for k, v in keys.items()}
    only = None if wanted is None else {k: frozenset(v) for k, v in wanted.items()}
    names = ["record", "loaded", "version", "grp", "ordinals", "field", "value"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = Stream(many, inherit, only)
        for batch in batches:
            out = []
            for rid, at, version, text in zip(batch["record"], batch["loaded"], batch["version"], batch["payload"], strict=True):
                out += [(rid, at, version, g, list(o), f, v) for g, o, f, v in stream.triples(text)]
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    moment = F.lit(0).cast("bigint") if loaded is None else F.coalesce(F.unix_micros(F.col(loaded).cast("timestamp")), F.lit(0))
    return df.select(F.col(record).cast("string").alias("record"), moment.alias("loaded"), F.coalesce(F.xxhash64(payload), F.lit(0)).alias("version"), F.col(payload).alias("payload")).mapInPandas(run, TRIPLE)


def pivoted(parts: DataFrame, group: str, levels: list[str], fields: list[str]) -> DataFrame:
    """One table of one group: record, a position per level (from 0), and the ``fields`` as text.

    Of several complete deliveries of a record the latest counts, as a whole; equal ones are one, and of those loaded at the same
    time the one of the greatest hash counts. Partial aggregation runs before the first shuffle; the second one carries
    finished rows.
    """
    value = {f: F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields}
    grouped = parts.where(F.col("grp") == group).groupBy("record", "loaded", "version", "ordinals").agg(*value.values())
    return latest(grouped).select("record", *[F.get("ordinals", F.lit(i)).alias(name) for i, name in enumerate(levels)], *[F.col(f"`{f}`") for f in fields])


def latest(rows: DataFrame) -> DataFrame:
    """The rows of the latest delivery of each record."""
    return rows.withColumn("__last", F.max(F.struct("loaded", "version")).over(Window.partitionBy("record"))).where(F.struct("loaded", "version") == F.col("__last")).drop("__last")


POSITIONS = {"attempts": "attempt_pos", "attempts.responses": "response_pos", "attempts.responses.evidence": "evidence_pos", "attempts.responses.error_tags": "tag_pos", "paper.questions": "question_pos", "review_queue": "review_pos"}
CLASS_LISTS = list(POSITIONS)
CLASS_KEYS = {"attempts": ["attempt_id"], "attempts.responses": ["question_id"]}
CLASS_FIELDS = {
    "": ["schema_version", "organization_id", "analysis_id", "created_at", "paper.paper_id", "paper.subject", REST],
    "attempts": ["attempt_id", "class_id", "student_ref", "submitted_at", REST],
    "attempts.responses": ["attempt_id", "question_id", "raw_ocr_text", "normalized_answer", "score", "confidence.ocr", "confidence.grading", "review_status", "teacher_review", REST],
    "attempts.responses.evidence": ["attempt_id", "question_id", "evidence_id", "observed", "explanation", "causal_role", "step", "confidence", "source.document_id", "source.page", REST],
    "attempts.responses.error_tags": ["attempt_id", "question_id", "dimension", "name", "confidence", "evidence_ids", REST],
    "paper.questions": ["question_id", "max_score", "tags", REST],
    "review_queue": ["attempt_id", "question_id", "reasons", REST],
}


def class_table(records: DataFrame, group: str, fields: list[str] | None = None) -> DataFrame:
    """One flat table of the class records: a group of ``CLASS_FIELDS``, '' being the record itself.

    Rows carry record_id, their positions in the lists as delivered, the ids of their parents and their own fields
    (dots become underscores); ``rest`` holds all fields without a column as a JSON object, null if there are none. The
    evidence_ids of an error tag name evidence of the same response. Snapshots inside teacher_review are not evidence
    of the response and give no row; teacher_review is kept as JSON.
    """
    fields = fields or CLASS_FIELDS[group]
    levels = [name for path, name in POSITIONS.items() if f"{group}.".startswith(f"{path}.")]
    loaded = "loaded_at" if "loaded_at" in records.columns else None
    parts = triples(records.where(F.col("record_id").isNotNull()), "record_id", "payload", CLASS_LISTS, CLASS_KEYS, {group: list(fields)}, loaded)
    return _flat(parts, group, levels, fields)


def _flat(parts: DataFrame, group: str, levels: list[str], fields: list[str]) -> DataFrame:
    flat = pivoted(parts, group, levels, fields)
    return flat.select(F.col("record").cast("bigint").alias("record_id"), *levels, *[F.col(f"`{f}`").alias("rest" if f == REST else f.replace(".", "_")) for f in fields])


def class_tables(records: DataFrame) -> dict[str, DataFrame]:
    """All flat tables of the class records by group, from one pass over the payloads, whose triples are kept in the shared folder.

    For a caller that needs several tables; :func:`class_table` reads the payloads for one.
    """
    loaded = "loaded_at" if "loaded_at" in records.columns else None
    parts = stored(triples(records.where(F.col("record_id").isNotNull()), "record_id", "payload", CLASS_LISTS, CLASS_KEYS, CLASS_FIELDS, loaded))
    return {group: _flat(parts, group, [name for path, name in POSITIONS.items() if f"{group}.".startswith(f"{path}.")], fields) for group, fields in CLASS_FIELDS.items()}
