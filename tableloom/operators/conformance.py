"""Declared types and constraints against the data (C5), and the type table behind them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed table: database type names to Spark types. Parameters in brackets are read separately.
DATABASE_TYPES = {
    "bigint": "bigint",
    "int": "int",
    "smallint": "smallint",
    "tinyint": "smallint",
    "bit": "boolean",
    "decimal": "decimal",
    "numeric": "decimal",
    "money": "decimal(19,4)",
    "smallmoney": "decimal(10,4)",
    "float": "double",
    "real": "float",
    "date": "date",
    "datetime": "timestamp_ntz",
    "datetime2": "timestamp_ntz",
    "smalldatetime": "timestamp_ntz",
    "datetimeoffset": "timestamp",
    "time": "bigint",
    "char": "string",
    "varchar": "string",
    "text": "string",
    "nchar": "string",
    "nvarchar": "string",
    "ntext": "string",
    "binary": "binary",
    "varbinary": "binary",
    "image": "binary",
    "rowversion": "binary",
    "timestamp": "binary",
    "geography": "binary",
    "uniqueidentifier": "string",
    "xml": "string",
    "sql_variant": "string",
}


def spark_type(database_type: str) -> str:
    """The Spark type of a database type such as ``decimal(18, 2)``; unknown names raise."""
    name, _, rest = database_type.strip().lower().partition("(")
    base = DATABASE_TYPES.get(name.strip())
    if base is None:
        raise ValueError(f"unknown database type {database_type!r}")
    if base != "decimal":
        return base
    numbers = [int(n) for n in rest.rstrip(") ").split(",") if n.strip()]
    precision, scale = (numbers + [0])[:2] if numbers else (18, 2)
    return f"decimal({precision},{scale})"


@dataclass(frozen=True)
class ColumnRule:
    """What a column declares."""

    name: str
    type: str | None = None
    required: bool = False
    max_length: int | None = None


@dataclass(frozen=True)
class TableRule:
    name: str
    columns: tuple[ColumnRule, ...]
    key: tuple[str, ...] = ()
    foreign_keys: Mapping[str, tuple[str, str]] = field(default_factory=dict)  # column -> (table, column)


def _unreadable(c: Column, dtype: T.DataType, declared: str) -> Column:
    """Values that have no form in the declared type; losing digits counts as having none."""
    wanted = T.StructType.fromDDL(f"x {declared}")["x"].dataType
    if isinstance(wanted, T.DecimalType) and isinstance(dtype, T.DoubleType) and wanted.precision <= 15:
        # Plain arithmetic instead of a decimal per value: a double has s decimals
        # exactly if it is the double nearest to some multiple of 10**-s.
        unit = float(10**wanted.scale)
        size = F.abs(c)
        fits = (size < float(10 ** (wanted.precision - wanted.scale))) & (F.floor(size * unit + 0.5) / unit == size)
        return c.isNotNull() & ~fits
    read = c.try_cast(declared)
    bad = read.isNull()
    if isinstance(wanted, T.DecimalType):
        bad = bad | (read.cast("double") != c.try_cast("double"))
    return c.isNotNull() & bad


def _checks(df: DataFrame, rule: ColumnRule) -> list[tuple[str, Column]]:
    c = F.col(rule.name)
    out = []
    if rule.required:
        out.append(("required", c.isNull()))
    if rule.type:
        out.append(("type", _unreadable(c, df.schema[rule.name].dataType, rule.type)))
    if rule.max_length is not None:
        out.append(("length", F.length(c.cast("string")) > rule.max_length))
    return out


def column_violations(df: DataFrame, rule: TableRule) -> DataFrame:
    """Violations per column rule: one pass over the table, whatever the number of rules."""
    checks = [(c.name, kind, bad) for c in rule.columns for kind, bad in _checks(df, c)]
    counted = df.agg(*[F.count_if(bad).alias(f"v{i}") for i, (_, _, bad) in enumerate(checks)])
    rows = F.array(
        *[
            F.struct(F.lit(kind).alias("rule"), F.lit(name).alias("column"), F.col(f"v{i}").alias("violations"))
            for i, (name, kind, _) in enumerate(checks)
        ]
    )
    return counted.select(F.explode(rows).alias("r")).select(F.lit(rule.name).alias("table"), "r.*")


def duplicate_keys(df: DataFrame, rule: TableRule) -> DataFrame:
    """Rows beyond the first of each key."""
    counts = df.groupBy(*rule.key).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")).select(
        F.lit(rule.name).alias("table"), F.lit("unique").alias("rule"), F.lit(",".join(rule.key)).alias("column"), "violations"
    )


def orphans(df: DataFrame, rule: TableRule, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose foreign key has no parent. Keys are counted first, so a hot key joins as one row."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    missing = counts.join(parent.select(F.col(parent_column).alias("k")), "k", "left_anti")
    return missing.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(
        F.lit(rule.name).alias("table"), F.lit("foreign key").alias("rule"), F.lit(column).alias("column"), "violations"
    )


def conformance(tables: Mapping[str, DataFrame], rules: Sequence[TableRule]) -> DataFrame:
    """Every rule of every table with its number of violations."""
    parts = []
    for rule in rules:
        df = tables[rule.name]
        parts.append(column_violations(df, rule))
        if rule.key:
            parts.append(duplicate_keys(df, rule))
        for column, (parent, parent_column) in rule.foreign_keys.items():
            parts.append(orphans(df, rule, column, tables[parent], parent_column))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
