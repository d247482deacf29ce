"""Exact numbers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from markwise.session import shipped_here

SCORE = "decimal(20,6)"


def to_decimal(text: Column) -> Column:
    """A finite decimal number of a text or number, else null: signs, exponents and blanks around are allowed, as are
    single underscores between digits; truth values are no numbers."""
    plain = F.regexp_replace(F.trim(text.cast("string")), r"(?<=\d)_(?=\d)", "")
    number = F.when(plain.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), plain)
    return F.coalesce(number.try_cast(SCORE), number.try_cast("double").try_cast(SCORE))


def units(value: Column) -> Column:
    """A score in millionths, as a whole number."""
    return (value.cast(SCORE) * 1_000_000).cast("decimal(38,0)")


def percentage(part: Column, whole: Column) -> Column:
    """100 * part / whole, rounded half up to two places in exact arithmetic; 0 for a whole of 0, null for a null."""
    p, w = part.cast("decimal(38,0)"), whole.cast("decimal(38,0)")
    hundredths = F.call_function("div", p * 20000 + w, F.nullif(w * 2, F.lit(0).cast("decimal(38,0)")))
    return F.when(w == 0, F.lit(0.0)).otherwise(hundredths.cast("double") / 100.0)


def plain_number(value: Column) -> Column:
    """A decimal as text without trailing zeros, so that whole numbers have no point."""
    text = value.cast("string")
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def py_round(value: Column, digits: int) -> Column:
    """``value`` rounded half to even on its exact binary value, as Python does; Arrow batches, for report tables."""

    shipped_here()

    @F.arrow_udf("double")
    def rounded(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else round(v, digits) for v in values.to_pylist()], pa.float64())

    return rounded(value.cast("double"))

