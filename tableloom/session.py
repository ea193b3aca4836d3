"""Session settings and the shared scratch folder."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DataType, DecimalType, StructType

# Runtime settings every operator relies on. Partition counts stay with the
# caller: they depend on the cluster, not on the library.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot foreign key is split even where the split costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Whole texts go to Python workers in batches of about this size, whatever their length.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4194304",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply ``SETTINGS`` to a session and return it."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(app: str = "tableloom", cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name below the shared folder of the cluster.

    The base is ``spark.checkpoint.dir``. Only a local session may go without
    it; elsewhere a machine-local folder would be lost with its executor.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _local_base(spark)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tableloom-")


def _local_base(spark: SparkSession) -> str:
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    return _local_folder()


def local_frame(spark: SparkSession, rows: Sequence[tuple], schema: str | StructType) -> DataFrame:
    """A small DataFrame of driver values.

    Built from Arrow it is a local relation with a known size, which needs no
    job and no Python worker.
    """
    struct = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [()] * len(struct)
    table = pa.Table.from_arrays([pa.array(list(c), _arrow_type(f.dataType)) for c, f in zip(columns, struct)], names=struct.names)
    return spark.createDataFrame(table, struct)


def _arrow_type(dtype: DataType) -> pa.DataType | None:
    simple = {
        "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(),
        "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "date": pa.date32(),
        "timestamp_ntz": pa.timestamp("us"), "timestamp": pa.timestamp("us", "UTC"), "binary": pa.binary(),
    }
    if isinstance(dtype, DecimalType):
        return pa.decimal128(dtype.precision, dtype.scale)
    if isinstance(dtype, StructType):
        return pa.struct([(f.name, _arrow_type(f.dataType)) for f in dtype])
    if isinstance(dtype, ArrayType):
        return pa.list_(_arrow_type(dtype.elementType))
    return simple.get(dtype.simpleString())


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    For a result that a plan uses several times: it is computed once, its
    lineage ends there, and a lost executor costs a re-read.
    """
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
