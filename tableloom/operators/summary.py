"""Result summaries: count, first and last row per query."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableloom.functions.canonical import canonical_struct, json_text
from tableloom.session import local_frame

SUMMARY_SCHEMA = "query_id string, count bigint, first_sample string, last_sample string, error string"


def summarise(df: DataFrame, query_id: str, key: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """One row per query: count, and the first and last row by a unique ``key`` as canonical JSON.

    No first row without rows, no last row below two. One aggregate over the
    plan of the query: nothing is sorted or collected.
    """
    row = canonical_struct(df, drop=drop)
    picked = df.select(F.col(key).alias("k"), row.alias("r")).agg(
        F.count(F.lit(1)).alias("count"), F.min_by("r", "k").alias("first"), F.max_by("r", "k").alias("last")
    )
    return picked.select(
        F.lit(query_id).alias("query_id"),
        "count",
        F.when(F.col("count") > 0, json_text(F.col("first"))).alias("first_sample"),
        F.when(F.col("count") > 1, json_text(F.col("last"))).alias("last_sample"),
        F.lit(None).cast("string").alias("error"),
    )


def failed(df: DataFrame, query_id: str, error: str) -> DataFrame:
    """The summary row of a query that failed."""
    return df.sparkSession.range(1).select(
        F.lit(query_id).alias("query_id"),
        F.lit(None).cast("bigint").alias("count"),
        F.lit(None).cast("string").alias("first_sample"),
        F.lit(None).cast("string").alias("last_sample"),
        F.lit(error).alias("error"),
    )


def summarise_all(results: Mapping[str, tuple[DataFrame, str]], drop: tuple[str, ...] = ()) -> DataFrame:
    """Summaries of several queries, given as ``{id: (rows, key)}``, in one table."""
    parts = [summarise(df, query_id, key, drop) for query_id, (df, key) in results.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def run_all(spark: SparkSession, queries: Mapping[str, Callable[[], tuple[DataFrame, str]]], drop: tuple[str, ...] = ()) -> DataFrame:
    """Run each query and summarise it; one that fails becomes an error row, the others go on.

    A query fails when it is planned or when it runs, so each one runs on its
    own here, and its one summary row reaches the driver.
    """
    rows = []
    for query_id, build in queries.items():
        try:
            df, key = build()
            rows.append(tuple(summarise(df, query_id, key, drop).first()))
        except PySparkException as e:
            text = (e.getCondition() or type(e).__name__) if hasattr(e, "getCondition") else type(e).__name__
            rows.append((query_id, None, None, None, text))
    return local_frame(spark, rows, SUMMARY_SCHEMA)


def payloads(summaries: DataFrame) -> DataFrame:
    """Summaries as ``(query_id, payload)`` JSON objects, the exchange form between stores."""
    body = F.struct(
        "count", F.col("first_sample").alias("firstSample"), F.col("last_sample").alias("lastSample"), "error"
    )
    return summaries.select("query_id", F.to_json(body).alias("payload"))
