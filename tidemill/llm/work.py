"""What several operators need of the session."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a temporary one only where it is unset and Spark runs in one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidemill-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Whether an action's shuffle files go when it ends; otherwise they stay until the driver collects its garbage, which may be after all steps of an operator.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, what is made and run leaves no shuffle files behind; the session's own setting comes back."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def settled(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder: later steps neither repeat the work nor depend on the executors that did it, and its shuffle files are deleted."""
    checkpoint_dir(df.sparkSession)
    with brief_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # Spark decides on the files when a table is made, so this is one of its own


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has no more than so many rows; otherwise Spark shuffles for the join. Give it settled, narrow rows."""
    with brief_shuffles(df.sparkSession):
        return F.broadcast(df) if df.count() <= rows else df


def own_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Only the columns an operator uses, under its own names, so that extra or clashing ones can't interfere."""
    return df.select(*[F.col(f"`{given}`").alias(name) for name, given in wanted.items()])
