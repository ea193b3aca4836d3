"""Table scans, the column catalog and name resolution (SRC1, SRC2, SRC7, SRC9)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableloom.session import local_frame


def scan(spark: SparkSession, path: str, schema: str | T.StructType | None = None, alias: str | None = None) -> DataFrame:
    """Read a parquet table under its declared schema, which saves the inference job."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    return df.alias(alias) if alias else df


def view_name(qualified: str) -> str:
    """``schema.table`` as one view name."""
    return qualified.replace(".", "_").lower()


def column_catalog(spark: SparkSession, tables: Mapping[str, DataFrame], schema: str = "dbo") -> DataFrame:
    """One row per declared column of each table, from the schemas alone."""
    rows = []
    for name, df in tables.items():
        owner, _, table = name.rpartition(".")
        for ordinal, field in enumerate(df.schema.fields, start=1):
            rows.append((owner or schema, table, field.name, ordinal, field.dataType.simpleString(), field.nullable))
    return local_frame(
        spark,
        rows,
        "table_schema string, table_name string, column_name string, ordinal int, data_type string, is_nullable boolean",
    )


def column_type(catalog: DataFrame, schema: str, table: str, column: str) -> DataFrame:
    """Declared type of one column."""
    return catalog.filter(
        (F.col("table_schema") == schema) & (F.col("table_name") == table) & (F.col("column_name") == column)
    ).select("data_type")


def resolve_names(names: DataFrame, catalog: DataFrame, name: str = "name", default_schema: str = "dbo") -> DataFrame:
    """Add ``resolved``: the schema-qualified form of each table name.

    A name is looked up as it stands, then in its other number (``s`` dropped
    or added); the default schema comes first, then the schema name. Names
    with a dot, blank names and unknown names pass through.

    The distinct names are resolved, not the rows: a frequent name costs one
    lookup. The catalog is reduced to its best schema per table beforehand, so
    neither join multiplies rows.
    """
    best = catalog.groupBy(F.col("table_name").alias("_table")).agg(
        F.min_by("table_schema", F.struct((F.col("table_schema") != default_schema).alias("other"), "table_schema")).alias(
            "_schema"
        )
    )
    n = F.col(name)
    other = F.when(F.lower(n).endswith("s"), n.substr(F.lit(1), F.length(n) - 1)).otherwise(F.concat(n, F.lit("s")))
    distinct = names.select(n).distinct()
    open_names = distinct.filter((F.trim(n) != "") & ~n.contains("."))
    candidates = open_names.select(
        n, F.posexplode(F.array(n, other)).alias("_rank", "_candidate")
    )
    found = (
        candidates.join(best, F.col("_candidate") == F.col("_table"))
        .groupBy(n)
        .agg(F.min_by(F.concat_ws(".", "_schema", "_table"), "_rank").alias("_found"))
    )
    return names.join(found, name, "left").withColumn("resolved", F.coalesce("_found", n)).drop("_found")
