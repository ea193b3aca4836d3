"""Projection, parameters, predicates, joins, aggregates, sorting and set operations.

Every function is DataFrame to DataFrame and lazy.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Value lists up to this length stay an IN list; longer ones become a semi join.
INLINE_VALUES = 1_000
# Largest value list that is broadcast, in bytes; beyond it Spark picks the join.
BROADCAST_BYTES = 64 << 20


# --- parameters -----------------------------------------------------------


def typed(value: Any) -> Any:
    """A driver value in the form Spark binds with its own type (PAR1, PRE10).

    Identifiers become lower-case text and times of day microseconds since
    midnight; texts stay literal, so no quoting step exists.
    """
    if isinstance(value, uuid.UUID):
        return str(value).lower()
    if isinstance(value, dt.time):
        return ((value.hour * 60 + value.minute) * 60 + value.second) * 1_000_000 + value.microsecond
    if isinstance(value, bytearray):
        return bytes(value)
    return value


def literal(value: Any) -> Column:
    """A typed literal; wall-clock timestamps stay without a zone."""
    value = typed(value)
    if isinstance(value, dt.datetime) and value.tzinfo is None:
        return F.expr(f"timestamp_ntz'{value.isoformat(sep=' ')}'")
    return F.lit(value)


def run_sql(spark: SparkSession, text: str, params: Mapping[str, Any] | None = None, **frames: DataFrame) -> DataFrame:
    """SQL text over DataFrames (``{name}``) with named parameters (``:name``), never spliced."""
    return spark.sql(text, args={k: literal(v) for k, v in (params or {}).items()}, **frames)


# --- projection -----------------------------------------------------------


def project(df: DataFrame, *columns: str | tuple[str | Column, str]) -> DataFrame:
    """Columns by name, or ``(expression, alias)`` pairs (PRJ1, PRJ5, PRJ6)."""
    out = []
    for c in columns:
        expr, alias = c if isinstance(c, tuple) else (c, None)
        expr = F.col(expr) if isinstance(expr, str) else expr
        out.append(expr.alias(alias) if alias else expr)
    return df.select(*out)


def single(df: DataFrame, what: str = "row") -> DataFrame:
    """The only row of ``df``; none or several raise when the plan runs (PRJ2)."""
    counted = df.limit(2).agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*df.columns)).alias("r"))
    message = F.concat(F.lit(f"expected exactly one {what}, found at least "), F.col("n").cast("string"))
    checked = F.when(F.col("n") == 1, F.col("r")).otherwise(F.raise_error(message))
    return counted.select(checked.alias("r")).select("r.*")


def split_row(df: DataFrame, **parts: Sequence[str]) -> DataFrame:
    """One struct column per named part: several objects out of one row (PRJ4)."""
    return df.select(*[F.struct(*cols).alias(name) for name, cols in parts.items()])


def product(left: Column, right: Column, dtype: str = "decimal(38,4)") -> Column:
    """``left * right`` under a stated result type (PRJ7)."""
    return (left * right).cast(dtype)


# --- predicates -----------------------------------------------------------

# Fixed set of comparison names and their operators.
COMPARISONS = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "like": lambda a, b: a.like(b),
    "not like": lambda a, b: ~a.like(b),
}


def _operand(value: Any) -> Column:
    return value if isinstance(value, Column) else literal(value)


def compare(left: Column, op: str, right: Any) -> Column:
    """A comparison between a column and a constant or another column (PRE1, PRE2, PRE6, PRE7)."""
    if op in ("like", "not like"):
        return COMPARISONS[op](left, right)
    return COMPARISONS[op](left, _operand(right))


def between(column: Column, low: Any, high: Any) -> Column:
    """Closed range (PRE3)."""
    return column.between(_operand(low), _operand(high))


def _values(df: DataFrame, column: str, values: Sequence[Any]) -> tuple[DataFrame, Column]:
    """A list as a table of its own type, and the condition that a row's value is in it.

    Spark brings both sides to one type, as it does for a short list.
    """
    array = pa.array([typed(v) for v in dict.fromkeys(values)])
    wanted = df.sparkSession.createDataFrame(pa.table({"_listed": array}))
    small = array.nbytes <= BROADCAST_BYTES
    return F.broadcast(wanted) if small else wanted, F.col(column) == F.col("_listed")


def in_list(df: DataFrame, column: str, values: Sequence[Any]) -> DataFrame:
    """Rows whose value is in the list (PRE4, PRE8)."""
    known = [v for v in values if v is not None]
    if len(known) <= INLINE_VALUES:
        return df.filter(F.col(column).isin([literal(v) for v in known]))
    wanted, listed = _values(df, column, known)
    return df.join(wanted, listed, "left_semi")


def not_in_list(df: DataFrame, column: str, values: Sequence[Any]) -> DataFrame:
    """Rows whose value is known and not in the list; a null in the list leaves no row (PRE8)."""
    if any(v is None for v in values):
        return df.filter(F.lit(False))
    if len(values) <= INLINE_VALUES:
        return df.filter(~F.col(column).isin([literal(v) for v in values]))
    wanted, listed = _values(df, column, values)
    return df.filter(F.col(column).isNotNull()).join(wanted, listed, "left_anti")


def contains_text(column: Column, text: str, ignore_case: bool = False) -> Column:
    """Substring search; ``text`` is literal, so ``%`` and ``_`` mean themselves (PRE5)."""
    if ignore_case:
        return F.lower(column).contains(text.lower())
    return column.contains(text)


def all_of(df: DataFrame, *conditions: Column) -> DataFrame:
    """Conjunction of predicates (PRE9)."""
    for condition in conditions:
        df = df.filter(condition)
    return df


# --- joins ----------------------------------------------------------------

# Fixed join kinds.
JOIN_KINDS = {"inner": "inner", "left": "left_outer", "right": "right_outer", "full": "full_outer"}


def equi_join(left: DataFrame, right: DataFrame, on: tuple[str, str], kind: str = "inner", alias: str | None = None) -> DataFrame:
    """Join on one pair of columns (JOI1, JOI8)."""
    right = right.alias(alias) if alias else right
    name = f"{alias}.{on[1]}" if alias else on[1]
    return left.join(right, F.col(on[0]) == F.col(name), JOIN_KINDS[kind])


# --- aggregation ----------------------------------------------------------

# Fixed aggregate names.
AGGREGATES = {"COUNT": F.count, "SUM": F.sum, "MIN": F.min, "MAX": F.max, "AVG": F.avg}


def aggregate(name: str, column: Column | str) -> Column:
    """An aggregate function by its name (AGG5); ``COUNT`` counts known values, ``COUNT`` of ``*`` counts rows (AGG4)."""
    if name.upper() == "COUNT" and isinstance(column, str) and column == "*":
        return F.count(F.lit(1))
    return AGGREGATES[name.upper()](column)


def count_by(df: DataFrame, *keys: str, of: str | None = None, alias: str = "count") -> DataFrame:
    """Group and count, largest group first, keys breaking ties (AGG1, AGG6)."""
    counted = df.groupBy(*keys).agg(aggregate("COUNT", of or "*").alias(alias))
    return counted.orderBy(F.desc(alias), *keys)


def row_count(df: DataFrame, alias: str = "count") -> DataFrame:
    """Row count of any query (AGG9)."""
    return df.agg(F.count(F.lit(1)).alias(alias))


def having(grouped: DataFrame, *conditions: Column) -> DataFrame:
    """Conditions on grouped rows, all of them (AGG7)."""
    return all_of(grouped, *conditions)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in ``order`` (AGG10).

    An aggregate, not a window: it combines on the map side, so a hot key
    never reaches one task as rows.
    """
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r"))
    return picked.select("r.*")


# --- sorting and paging ---------------------------------------------------


def order_terms(order: Sequence[str | tuple[str, str]]) -> list[Column]:
    """Sort terms: a column name, or ``(name, "asc" | "desc")``; nulls first on asc, last on desc (SRT1)."""
    terms = []
    for term in order:
        name, way = term if isinstance(term, tuple) else (term, "asc")
        terms.append(F.desc(name) if way == "desc" else F.asc(name))
    return terms


def sort(df: DataFrame, *order: str | tuple[str, str]) -> DataFrame:
    return df.orderBy(*order_terms(order))


def top(df: DataFrame, n: int, *order: str | tuple[str, str]) -> DataFrame:
    """The first ``n`` rows; give a unique last term, else ties are open (SRT2, SRT5)."""
    return sort(df, *order).limit(n)


def page(df: DataFrame, skip: int, take: int, *order: str | tuple[str, str]) -> DataFrame:
    """Offset paging (SRT3). Deep pages read and discard: see :func:`page_after`."""
    return sort(df, *order).offset(skip).limit(take)


def page_after(df: DataFrame, key: str, last: Any, take: int) -> DataFrame:
    """Keyset paging: the page behind a known key, at the cost of one page (SRT4)."""
    return df.filter(F.col(key) > _operand(last)).orderBy(key).limit(take)


def numbered(page_rows: DataFrame, *order: str | tuple[str, str], alias: str = "position") -> DataFrame:
    """Positions of a *limited* result; the window takes one task, so pass pages only."""
    return page_rows.withColumn(alias, F.row_number().over(Window.orderBy(*order_terms(order))))


def first_and_last(df: DataFrame, key: str) -> DataFrame:
    """First and last row by a unique key in one aggregate (SRT6)."""
    row = F.struct(*df.columns)
    return df.agg(F.min_by(row, key).alias("first_row"), F.max_by(row, key).alias("last_row"))


# --- set operations -------------------------------------------------------


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both, columns by position (SET1, SET6)."""
    return a.union(b).distinct()


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows in both (SET3).

    Both sides are made distinct first: copies collapse on the map side
    instead of meeting in the join.
    """
    return a.distinct().intersect(b.distinct())


def except_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that are not in ``b`` (SET4)."""
    return a.distinct().subtract(b.distinct())


def except_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` less those of ``b``, copy by copy (SET5)."""
    return a.exceptAll(b)
