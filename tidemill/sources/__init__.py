"""Reading tables: Parquet by table name, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` in a folder; Spark prunes its columns and pushes filters into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """The column as a timestamp with time zone, which watermarks need; times without a zone are taken in the session's."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def stream_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same table as a stream of its files, with the batch table's schema. files_per_trigger bounds a batch; without it a batch takes all files that are there."""
    schema = read_table(spark, folder, name).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}.parquet")
