"""Canonical JSON and hashes over it."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from markwise.session import shipped_here


def canonical(text: str, without: tuple[str, ...] = ()) -> str | None:
    """JSON text with sorted keys, without blanks, numbers spelled as Python does; None if it is not complete JSON."""
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    if without and isinstance(value, dict):
        value = {k: v for k, v in value.items() if k not in without}
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def canonical_json(text: Column, without: tuple[str, ...] = ()) -> Column:
    """Canonical form of a JSON text, null for null and for broken texts; keys in ``without`` are left out at the root.

    Python, since the JVM's writers spell some numbers otherwise; one Arrow batch at a time.
    """

    shipped_here()

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else canonical(t, without) for t in texts.to_pylist()], pa.string())

    return run(text)


def sha256_value(text: Column) -> Column:
    """``sha256:`` and the digest of a JSON text's canonical form."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(text), 256))


def state_hash(text: Column) -> Column:
    """Digest of a document without its audit log."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(text, ("audit_log",)), 256))


def digest(value: object) -> str:
    """The same digest for a Python value."""
    return "sha256:" + hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
