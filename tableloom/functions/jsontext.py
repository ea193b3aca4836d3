"""JSON held in text columns (SCA1 to SCA4, JOI7). Row-local, no join."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _text(column: Column) -> Column:
    """Null or blank text reads as null, not as an error."""
    return F.when(F.length(F.trim(column)) > 0, column)


def member(column: Column, name: str) -> Column:
    """One member of a JSON object as text."""
    return F.get_json_object(column, f"$.{name}")


def parse_object(column: Column, schema: str | T.StructType) -> Column:
    """A JSON object as a struct of the declared types; broken text gives null members."""
    return F.from_json(_text(column), schema, {"mode": "PERMISSIVE"})


def parse_array(column: Column, element: str = "string") -> Column:
    """A JSON array as an array of the declared type."""
    return F.from_json(_text(column), f"array<{element}>", {"mode": "PERMISSIVE"})


def array_has(column: Column, value: Any, element: str = "string") -> Column:
    """EXISTS over the elements of a JSON array; unknown arrays have nothing."""
    return F.coalesce(F.array_contains(parse_array(column, element), value), F.lit(False))
