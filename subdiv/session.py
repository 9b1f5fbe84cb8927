"""Session helpers: reliable intermediate tables and small driver-made tables."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SEP = "\u0001"


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may
    fall back to a temporary folder of the machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    created = tempfile.mkdtemp(prefix="subdiv-")
    spark.sparkContext.setCheckpointDir(created)
    return created


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, and gives Catalyst the
    real file sizes, on which it decides whether a side may be broadcast.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/subdiv/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, schema: pa.Schema, rows: list[tuple]) -> DataFrame:
    """DataFrame of a few driver-made rows, with a size Catalyst knows."""
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=schema))


def arrow_type(spark_type: T.DataType) -> pa.DataType:
    """Arrow type for the sum of a column."""
    if isinstance(spark_type, T.DecimalType):
        return pa.decimal128(38, spark_type.scale)
    if isinstance(spark_type, (T.DoubleType, T.FloatType)):
        return pa.float64()
    return pa.int64()


def string_literals(values: list[str]):
    """One constant ``array<string>``; a single literal whatever its length."""
    if any(_SEP in v for v in values):
        return F.array(*[F.lit(v) for v in values])
    return F.split(F.lit(_SEP.join(values)), _SEP)


def int_literals(values: list[int]):
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")
