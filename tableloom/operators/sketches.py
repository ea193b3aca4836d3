"""Profiles that merge: one row of sketches per part and column, stored and added up (D1d, D4d, D6d).

A part is a file, a day, or any group of rows. The profile of many parts is
the merged profile of each, so a new part costs one scan of that part alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bits of a distinct count: a standard error of about 1.04 / sqrt(2^14), under 1 %.
DISTINCT_BITS = 14
# Size of a quantile sketch: ranks are off by under 1 % (with high confidence).
QUANTILE_SIZE = 400
# Steps of the distribution that generated values follow.
STEPS = 200


def _number(f: T.StructField) -> Column | None:
    """The value as a double that keeps its order; times in microseconds."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double") if isinstance(f.dataType, T.NumericType) else None


def _identity(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.LongType, T.IntegerType, T.StringType)):
        return c
    return F.to_json(F.struct(c)) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else c.cast("string")


def profile_parts(df: DataFrame, part: Column) -> DataFrame:
    """``part, column_name, data_type, rows, nulls, different, spread, lowest, highest``: one scan, one row per part and column.

    ``different`` counts distinct values and ``spread`` holds quantiles of
    numbers and times; both are binary sketches. NaN counts as a null here.
    """
    aggregates = []
    for i, f in enumerate(df.schema.fields):
        number = _number(f)
        value = F.when(~F.isnan(number), number) if number is not None else None
        none = F.max(F.lit(None).cast("double"))
        aggregates += [
            F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"n{i}"),
            F.hll_sketch_agg(_identity(f), DISTINCT_BITS).alias(f"d{i}"),
            (F.kll_sketch_agg_double(value, QUANTILE_SIZE) if value is not None else F.max(F.lit(None).cast("binary"))).alias(f"q{i}"),
            (F.min(value) if value is not None else none).alias(f"lo{i}"),
            (F.max(value) if value is not None else none).alias(f"hi{i}"),
        ]
    one = df.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"), *aggregates)
    cells = [
        F.struct(
            F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.lit(i).alias("ordinal"), F.col(f"n{i}").alias("nulls"),
            F.col(f"d{i}").alias("different"), F.col(f"q{i}").alias("spread"), F.col(f"lo{i}").alias("lowest"), F.col(f"hi{i}").alias("highest"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return one.select("part", "rows", F.explode(F.array(*cells)).alias("c")).select("part", "rows", "c.*")


def merge_parts(parts: DataFrame, into: Sequence[Column] = ()) -> DataFrame:
    """The profile of all parts, or one for each group of them: the same columns without ``part``."""
    return parts.groupBy(*into, "column_name", "data_type", "ordinal").agg(
        F.sum("rows").alias("rows"),
        F.sum("nulls").alias("nulls"),
        F.hll_union_agg("different").alias("different"),
        F.kll_merge_agg_double("spread").alias("spread"),
        F.min("lowest").alias("lowest"),
        F.max("highest").alias("highest"),
    )


def estimates(profile: DataFrame, ranks: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Distinct values and quantiles of each column of a merged profile."""
    quantiles = F.when(F.col("lowest").isNotNull(), F.kll_sketch_get_quantile_double("spread", F.array(*[F.lit(r) for r in ranks])))
    return profile.select(
        "column_name", "data_type", "rows", "nulls", F.hll_sketch_estimate("different").alias("distinct_values"), quantiles.alias("quantiles"), "lowest", "highest"
    )


def estimated_groups(profile: DataFrame, column: str) -> DataFrame:
    """The estimated rows of a grouping by one column, nulls as a group of their own (D1d)."""
    one = profile.filter(F.col("column_name") == column)
    return one.select((F.hll_sketch_estimate("different") + F.when(F.col("nulls") > 0, 1).otherwise(0)).alias("row_count"))


def estimated_range(profile: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """The estimated rows with ``low < value <= high``; an open end is not cut (D1d). Times are microseconds."""
    one = profile.filter(F.col("column_name") == column)

    def rank(value: float | None, otherwise: float) -> Column:
        return F.lit(otherwise) if value is None else F.kll_sketch_get_rank_double("spread", F.lit(float(value)))

    known = F.col("rows") - F.col("nulls")
    return one.select(F.greatest(F.round(known * (rank(high, 1.0) - rank(low, 0.0))), F.lit(0)).cast("bigint").alias("row_count"))


def synthetic_like(spark: SparkSession, profile: DataFrame, rows: int) -> DataFrame:
    """A table whose numbers and times follow the distributions of a merged profile, nulls included (D4d).

    Values lie between neighbouring quantiles, so times have a time of day.
    Each column is dealt in an order of its own. Other types number their
    distinct values.
    """
    ranks = [k / STEPS for k in range(STEPS + 1)]
    found = estimates(profile, ranks).join(profile.select("column_name", "ordinal"), "column_name").orderBy("ordinal").collect()
    columns = []
    for k, r in enumerate(found):
        # A number in [0, 1) for each row: positions in a shuffled order, the same for every run.
        u = F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        dtype = T._parse_datatype_string(r["data_type"])
        share = (r["nulls"] / r["rows"]) if r["rows"] else 1.0
        if r["quantiles"]:
            steps = F.array(*[F.lit(float(x)) for x in r["quantiles"]])
            at = F.floor(u * STEPS).cast("int")
            low, high = F.get(steps, at), F.get(steps, F.least(at + 1, F.lit(STEPS)))
            value = low + (high - low) * (u * STEPS - at)
            if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                value = F.timestamp_micros(value.cast("bigint")).cast(dtype)
            else:
                value = (F.round(value) if isinstance(dtype, T.IntegralType) else value).cast(dtype)
        else:
            label = F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(max(r["distinct_values"] or 1, 1))).cast("string")
            value = F.concat(F.lit("v"), label).cast(dtype) if isinstance(dtype, T.StringType) else F.lit(None).cast(dtype)
        missing = F.pmod(F.xxhash64(F.lit(-1 - k), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < share
        columns.append(F.when(~missing, value).alias(r["column_name"]))
    return spark.range(rows).select(*columns)
