"""Text to typed values: timestamps, dates, durations and sizes (SCA8, SCA9)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed text forms that are taken for a timestamp or a date.
TIMESTAMP_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}[.][0-9]+(Z|[+-][0-9]{2}:[0-9]{2})?$"
DATE_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"

# Fixed factors: durations to nanoseconds, sizes to bytes.
DURATION_UNITS = {"ns": 1, "us": 1_000, "μs": 1_000, "µs": 1_000, "ms": 1_000_000, "s": 1_000_000_000}
SIZE_UNITS = {"B": 1, "KB": 1024, "MB": 1024**2, "GB": 1024**3}

_QUANTITY = r"^\s*([0-9][0-9,]*(?:[.][0-9]+)?)\s*([^0-9\s]+)\s*$"


def is_timestamp_text(column: Column) -> Column:
    return column.rlike(TIMESTAMP_PATTERN)


def is_date_text(column: Column) -> Column:
    return column.rlike(DATE_PATTERN)


def text_to_timestamp(column: Column) -> Column:
    """An instant where the text looks like one and is one, else null."""
    return F.when(is_timestamp_text(column), F.replace(column, F.lit(" "), F.lit("T")).try_cast("timestamp"))


def text_to_date(column: Column) -> Column:
    return F.when(is_date_text(column), column.try_cast("date"))


def quantity(column: Column, units: dict[str, int]) -> Column:
    """``525,861.8 μs`` to a number in the base unit of ``units``; ``NA`` and the like give null."""
    number = F.replace(F.regexp_extract(column, _QUANTITY, 1), F.lit(","), F.lit("")).try_cast("decimal(28,6)")
    unit = F.regexp_extract(column, _QUANTITY, 2)
    factor = F.create_map(*[F.lit(x) for pair in units.items() for x in (pair[0], pair[1])])
    return (number * F.try_element_at(factor, unit)).cast("decimal(38,6)")


def nanoseconds(column: Column) -> Column:
    return quantity(column, DURATION_UNITS)


def size_bytes(column: Column) -> Column:
    return quantity(column, SIZE_UNITS)
