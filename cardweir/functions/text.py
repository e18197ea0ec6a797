"""Text rules: key and number normalisation, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardweir.functions.scalars import _c, int_div


def normalise_key(key) -> Column:
    """camelCase or dotted key as lower snake case without edge separators."""
    snake = F.regexp_replace(_c(key), "([a-z0-9])([A-Z])", "$1_$2")
    squeezed = F.regexp_replace(F.lower(snake), "[^a-z0-9]+", "_")
    return F.regexp_replace(squeezed, "^_+|_+$", "")


def normalise_number(text) -> Column:
    """Equal numerals compare equal: no grouping commas, no idle zeros at either end."""
    bare = F.trim(F.regexp_replace(_c(text), ",", ""))
    no_tail = F.regexp_replace(bare, r"(\.[0-9]*?)0+$", "$1")
    no_dot = F.regexp_replace(no_tail, r"\.$", "")
    return F.regexp_replace(no_dot, "^0+([0-9])", "$1")


def duration_parts(seconds) -> Column:
    """Exact components a duration may be written with, as text."""
    s = _c(seconds).cast("long")

    def text(value: Column) -> Column:
        return value.cast("string")

    parts = F.array(text(s))
    minutes = F.array(text(int_div(s, F.lit(60))), text(s % 60))
    hours = F.array(text(int_div(s, F.lit(3600))), text(int_div(s % 3600, F.lit(60))))
    none = F.array().cast("array<string>")
    return F.concat(
        parts,
        F.when(s >= 60, minutes).otherwise(none),
        F.when(s >= 3600, hours).otherwise(none),
    )
