"""Output profiles and tables made from a profile (D1d to D6d)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableloom.session import local_frame

# Fixed start of generated dates.
EPOCH = "2000-01-01"
# Days from there that every date and timestamp can hold.
DAYS = 2_900_000


def estimated_rows(df: DataFrame) -> int:
    """Row estimate of the optimizer, rounded up and at least 1; without statistics on rows, size over row size."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    if stats.rowCount().isDefined():
        rows = float(str(stats.rowCount().get()))
    else:
        width = sum(_width(f.dataType) for f in df.schema.fields) + 8
        rows = float(str(stats.sizeInBytes())) / width
    return max(1, math.ceil(rows))


def _width(dtype: T.DataType) -> int:
    if isinstance(dtype, T.StringType):
        return 20
    if isinstance(dtype, (T.StructType,)):
        return sum(_width(f.dataType) for f in dtype.fields)
    return 8


def output_profile(df: DataFrame, grouping: bool = False, exact: bool = False) -> DataFrame:
    """Name, ordinal and type of each output column, the row count and the grouping flag (D1d, D2d).

    ``exact`` counts the rows; otherwise the optimizer's estimate is used and nothing runs.
    """
    columns = [(f.name, i, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    schema = "column_name string, ordinal int, data_type string"
    profile = local_frame(df.sparkSession, columns, schema).withColumn("is_grouping", F.lit(grouping))
    if not exact:
        return profile.withColumn("row_count", F.lit(estimated_rows(df)).cast("bigint"))
    return profile.withColumn("row_count", df.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar())


def _generated(dtype: T.DataType, row: Column | None) -> Column:
    """The default of a type; with ``row`` a value that changes from row to row.

    A type with fewer values than there are rows starts again from its first.
    """
    n = row if row is not None else F.lit(0).cast("bigint")
    if isinstance(dtype, T.ByteType):
        return (1 + n % 126).cast(dtype)
    if isinstance(dtype, T.ShortType):
        return (1 + n % 254).cast(dtype)
    if isinstance(dtype, T.IntegerType):
        return (1 + n % ((1 << 31) - 1)).cast(dtype)
    if isinstance(dtype, T.DecimalType):
        whole = dtype.precision - dtype.scale
        # Without digits before the point the value counts in the last place.
        last = 10 ** (whole or dtype.scale) - 1
        value = 1 + n % min(last, 1 << 62)
        return (value if whole else value.cast(f"decimal({dtype.precision},0)") / 10**dtype.scale).cast(dtype)
    if isinstance(dtype, (T.LongType, T.DoubleType, T.FloatType)):
        return (1 + n).cast(dtype)
    if isinstance(dtype, T.BooleanType):
        return (n % 2 == 0) if row is not None else F.lit(False)
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.date_add(F.lit(EPOCH).cast("date"), (n % DAYS).cast("int")).cast(dtype)
    if isinstance(dtype, T.StringType):
        return F.concat(F.lit('"'), row.cast("string"), F.lit('"')) if row is not None else F.lit("null")
    if isinstance(dtype, T.BinaryType):
        return F.unhex(F.lpad(F.hex(n % 255), 2, "0"))
    return F.lit(None).cast(dtype)


def synthetic_table(spark: SparkSession, schema: T.StructType, rows: int, distinct: bool = False) -> DataFrame:
    """A table of the given schema and row count (D3d); ``distinct`` makes every row differ (D4d)."""
    ids = spark.range(rows)
    row = F.col("id") if distinct else None
    return ids.select(*[_generated(f.dataType, row).alias(f.name) for f in schema.fields])


def table_profile(df: DataFrame) -> DataFrame:
    """Per column: type, nulls, distinct values (approximate), smallest and largest value as text (D6d).

    One pass over the table.
    """
    aggregates = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        plain = not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        counted = F.approx_count_distinct(c) if plain else F.lit(None).cast("bigint")
        aggregates += [
            F.count_if(c.isNull()).alias(f"n{i}"),
            counted.alias(f"d{i}"),
            (F.min(c).cast("string") if plain else F.max(F.lit(None).cast("string"))).alias(f"lo{i}"),
            (F.max(c).cast("string") if plain else F.max(F.lit(None).cast("string"))).alias(f"hi{i}"),
        ]
    one = df.agg(*aggregates)
    rows = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.col(f"n{i}").alias("nulls"),
                F.col(f"d{i}").alias("distinct_values"),
                F.col(f"lo{i}").alias("lowest"),
                F.col(f"hi{i}").alias("highest"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def sample_rows(df: DataFrame, key: Sequence[str], k: int = 3) -> DataFrame:
    """The first ``k`` rows by key as JSON."""
    row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.orderBy(*key).limit(k).select(*key, row.alias("row"))
