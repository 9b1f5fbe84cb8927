"""Reading and writing the tables of a study."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subdiv.session import materialize

# --- fixed values: columns of the country table ------------------------------
COUNTRY_COLUMNS = ["id", "country", "iso3", "m49", "region1", "region2", "continent"]
# ------------------------------------------------------------------------------


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system it names (any Hadoop scheme)."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def require(spark: SparkSession, *paths: str) -> None:
    missing = [p for p in paths if not exists(spark, p)]
    if missing:
        raise ValueError(f"not available: {missing}")


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    *,
    header: bool = True,
    sep: str = ",",
    na: str = "",
    trim: bool = True,
) -> DataFrame:
    """CSV with a declared schema; ``na`` is the text of a missing value."""
    require(spark, path)
    return (
        spark.read.schema(schema)
        .option("header", header)
        .option("sep", sep)
        .option("nullValue", na)
        .option("ignoreLeadingWhiteSpace", trim)
        .option("ignoreTrailingWhiteSpace", trim)
        .option("escape", '"')
        .option("enforceSchema", True)
        .csv(path)
    )


def read_country_table(spark: SparkSession, path: str) -> DataFrame:
    """Countries with two region levels and continent; byte-order mark and CRLF are tolerated."""
    schema = ", ".join(f"{c} string" for c in COUNTRY_COLUMNS)
    raw = read_csv(spark, path, schema, header=False)
    cleaned = raw.withColumn("id", F.regexp_replace("id", "﻿", "").cast("int"))
    # a CRLF file leaves the carriage return on the last column
    return cleaned.withColumn("continent", F.nullif(F.regexp_replace("continent", "\r$", ""), F.lit("")))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_itemsets(itemsets: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Itemsets as Parquet, one folder per length; arrays stay arrays."""
    itemsets.write.mode(mode).partitionBy("length").parquet(path)


def read_itemsets(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    require(spark, path)
    out = spark.read.parquet(path)
    return out.select(*columns) if columns else out


def spill(itemsets: DataFrame) -> DataFrame:
    """Write itemsets to the shared folder by length and go on with the written table."""
    return materialize(itemsets, "itemsets", ["length"])


def write_statistics(stats: DataFrame, path: str) -> None:
    """Run statistics as JSON lines."""
    stats.write.mode("errorifexists").json(path)


STATISTICS = (
    "dataset string, metric string, criterion string, min_sup_tree double, minimal_gain double, min_sup double, "
    "generalized boolean, pruned boolean, top_k int, stat string, value double"
)


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    require(spark, path)
    return spark.read.schema(STATISTICS).json(path)


def read_nested_statistics(spark: SparkSession, path: str, stat: str) -> DataFrame:
    """A JSON object ``{min_support: {configuration: number}}`` as rows."""
    require(spark, path)
    parsed = spark.read.text(path, wholetext=True).select(
        F.from_json("value", "map<string,map<string,double>>").alias("m")
    )
    per_support = parsed.select(F.explode("m").alias("min_sup", "configs"))
    return per_support.select(
        F.col("min_sup").cast("double").alias("min_sup"),
        F.explode("configs").alias("configuration", "value"),
        F.lit(stat).alias("stat"),
    )
