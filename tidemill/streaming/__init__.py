"""Windowed aggregation and joins of streams, with late data, on Structured Streaming."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where it is unset and Spark runs in one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found or tempfile.mkdtemp(prefix="tidemill-")


def settled(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder: later steps neither repeat the work nor depend on the executors that did it."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def windowed_counts(events: DataFrame, by: str, time: str = "ts", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows by window and key. On a stream, rows later than ``late`` behind the newest are left out, and state goes with the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), by).agg(F.count("*").alias("n"))


def join_in_time(left: DataFrame, right: DataFrame, by: Sequence[tuple[str, str]], left_time: str, right_time: str, within: int, late: str = "10 minutes", alone: bool = False) -> DataFrame:
    """Pairs of rows with equal keys where the right row is at most so many seconds before the left one, and not after it.

    The columns of left and then those of right, whose names must differ; the
    same on batch tables. On streams, rows later than ``late`` behind the newest
    row that both sides have reached are left out, and a side's rows are kept only until the watermark
    says that no partner can come. The join is by key and stretch of ``within``
    seconds: a left row is in one stretch, a right row in its own and the next,
    so that a key with most rows is split by time, and each pair comes once.
    Null keys and times match nothing; rows that repeat pair again. With alone, left rows
    that have no partner come too, with nulls: on a table all of them, on a stream each
    once the watermark has passed it and so no partner can come any more.
    """
    stretch = lambda time: F.floor(F.unix_seconds(time) / within)
    one = left.withWatermark(left_time, late).withColumn("_stretch", stretch(left_time))
    own = stretch(right_time)
    two = right.withWatermark(right_time, late).withColumn("_other_stretch", F.explode(F.array(own, own + 1)))
    same = F.col("_stretch") == F.col("_other_stretch")
    for x, y in by:
        same = same & (one[f"`{x}`"] == two[f"`{y}`"])
    in_time = (two[right_time] <= one[left_time]) & (two[right_time] >= one[left_time] - F.expr(f"INTERVAL {within} SECONDS"))
    return one.join(two, same & in_time, "left" if alone else "inner").drop("_stretch", "_other_stretch")


def run_to_table(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Runs a stream over what is there now, in append mode, and returns what it wrote.

    Append mode writes a window once the watermark has closed it. Windows that
    are still open when the input ends are not in the result; they come when
    later rows move the watermark on.
    """
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
