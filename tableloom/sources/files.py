"""Delimited, document and graph files, and relational reads (SRC3 to SRC6)."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableloom.operators.documents import Collection
from tableloom.session import local_frame

_CSV = {"header": "true", "quote": '"', "escape": '"', "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}

# Raw iteration files of the benchmark runner: fixed column names.
MEASUREMENT_SCHEMA = (
    "Target_Method string, Job_Id string, Params string, Measurement_IterationStage string, "
    "Measurement_LaunchIndex int, Measurement_IterationIndex bigint, Measurement_Value double"
)


def read_relational(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    lower: int,
    upper: int,
    partitions: int,
    **properties: str,
) -> DataFrame:
    """Read a database table in ``partitions`` parallel key ranges."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url,
            dbtable=table,
            partitionColumn=partition_column,
            lowerBound=str(lower),
            upperBound=str(upper),
            numPartitions=str(partitions),
            **properties,
        )
        .load()
    )


def export_delimited(df: DataFrame, path: str, max_records: int = 5_000_000) -> None:
    """Write quoted CSV as gzip; values may hold quotes and line breaks.

    Values with line breaks keep a reader from splitting a file anyway.
    """
    df.write.mode("overwrite").options(**_CSV).option("compression", "gzip").option("quoteAll", "true").option(
        "maxRecordsPerFile", max_records
    ).csv(path)


def read_delimited(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Read what :func:`export_delimited` wrote, line breaks inside values included."""
    return spark.read.schema(schema).options(**_CSV).option("multiLine", "true").option("mode", "FAILFAST").csv(path)


def read_measurements(spark: SparkSession, path: str, schema: str = MEASUREMENT_SCHEMA) -> DataFrame:
    """Read a ``;``-separated measurement or report file with a header row."""
    return spark.read.schema(schema).option("sep", ";").option("header", "true").csv(path)


def write_documents(df: DataFrame, path: str, fmt: str = "json", exclude_nulls: bool = False, max_records: int = 200_000) -> None:
    """Write documents; ``exclude_nulls`` leaves null fields out of JSON.

    JSON is written as gzip, which no reader splits, so a file holds at most
    ``max_records`` documents.
    """
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", max_records)
    if fmt == "json":
        writer = writer.option("ignoreNullFields", str(exclude_nulls).lower()).option("compression", "gzip")
    writer.format(fmt).save(path)


def read_documents(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def write_collection(collection: Collection, path: str, fmt: str = "json", exclude_nulls: bool = False) -> None:
    """Write a collection whole: its documents, the further parts of its arrays, and the schema of both."""
    frames = {"documents": collection.documents}
    frames |= {f"continuations/{at}": rows for at, rows in collection.continuations.items()}
    for name, df in frames.items():
        write_documents(df, f"{path}/{name}", fmt, exclude_nulls)
    spark = collection.documents.sparkSession
    schemas = local_frame(spark, [(name, df.schema.json()) for name, df in frames.items()], "name string, schema string")
    schemas.coalesce(1).write.mode("overwrite").json(f"{path}/schema")


def read_collection(spark: SparkSession, path: str, fmt: str = "json") -> Collection:
    """Read what :func:`write_collection` wrote."""
    schemas = spark.read.schema("name string, schema string").json(f"{path}/schema").collect()  # one row for each array
    frames = {r["name"]: read_documents(spark, f"{path}/{r['name']}", T.StructType.fromJson(json.loads(r["schema"])), fmt) for r in schemas}
    documents = frames.pop("documents")
    return Collection(documents, {name.partition("/")[2]: df for name, df in frames.items()})


def write_graph(nodes: Mapping[str, DataFrame], edges: Mapping[tuple, DataFrame], path: str) -> None:
    """One parquet folder per node label and per (type, start, end)."""
    for label, df in nodes.items():
        df.write.mode("overwrite").parquet(f"{path}/nodes/{label}")
    for (kind, start, end), df in edges.items():
        df.write.mode("overwrite").parquet(f"{path}/edges/{kind}/{start}-{end}")


def bulk_node_columns(nodes: DataFrame, id_space: str) -> DataFrame:
    """Rename the id and label columns to the header form bulk loaders read."""
    return nodes.withColumnsRenamed({"id": f"id:ID({id_space})", "label": ":LABEL"})


def bulk_edge_columns(edges: DataFrame, start_space: str, end_space: str) -> DataFrame:
    return edges.withColumnsRenamed(
        {"src": f":START_ID({start_space})", "dst": f":END_ID({end_space})", "type": ":TYPE"}
    )


def write_graph_csv(
    nodes: Mapping[str, DataFrame], edges: Mapping[tuple, DataFrame], path: str, spaces: Mapping[str, str] | None = None
) -> None:
    """The same as quoted CSV with bulk-load headers; ``spaces`` maps a label to its id space."""
    space = dict(spaces or {})
    for label, df in nodes.items():
        export_delimited(bulk_node_columns(df, space.get(label, label)), f"{path}/nodes/{label}")
    for (kind, start, end), df in edges.items():
        export_delimited(
            bulk_edge_columns(df, space.get(start, start), space.get(end, end)), f"{path}/edges/{kind}/{start}-{end}"
        )


def declared_nulls(df: DataFrame) -> DataFrame:
    """Empty delimited fields back to null in text columns."""
    return df.select(
        [
            F.when(F.col(f.name) != "", F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )
