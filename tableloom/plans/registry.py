"""The named queries: a function over the tables and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tableloom.session import configure
from tableloom.sources.tables import scan

# Declared schemas of the given tables.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


class Tables:
    """The tables of one folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    def __call__(self, name: str) -> DataFrame:
        return scan(self.spark, f"{self.folder}/{name}.parquet", SCHEMAS[name])

    def dealt(self, name: str, *keys: str) -> DataFrame:
        """A table dealt to the shuffle partitions by its keys, for queries whose work for a row is large.

        A table of few bytes is read by few tasks, however much is made of its
        rows. The number of partitions is given, so small ones are not merged.
        """
        return self(name).repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), *keys)


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Tables], DataFrame]
    sql: str | None
    grouping: bool


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, grouping: bool = False):
    """Register a query; ``grouping`` says that its rows are groups or distinct values (D2d)."""

    def register(run: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, run, sql, grouping)
        return run

    return register
