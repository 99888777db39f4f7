"""Plain text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the task marker in front of a model's input.
TASK = "normalize: "


def slug(text: Column, default: str, width: int = 48) -> Column:
    """Lower-case name with underscores for everything but ASCII letters and digits."""
    name = F.btrim(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(F.left(F.lower(name), F.lit(width)), F.lit("")), F.lit(default))


def model_input(text: Column) -> Column:
    return F.concat(F.lit(TASK), text)
