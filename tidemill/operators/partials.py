"""Partial aggregates by day that are stored once and merged for any stretch of days.

Two kinds: bitmaps of ids, which count distinct ones exactly, and counts of
values in buckets whose bounds grow by a constant factor, which give quantiles
to a relative error that is stated beforehand. Both merge in any order, so a
day's rows are read once, and a day that is run again gives the same table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: The bucket of infinite values; that of the largest double is far below it for any error that is allowed.
ENDLESS = 1 << 30


def distinct_partials(df: DataFrame, by: Sequence[str], number: str) -> DataFrame:
    """(by..., bucket, ids): bitmaps of the whole numbers in a column, 32,768 to a bucket.

    Bitmaps are made before the shuffle, so a hot group moves one of each bucket
    and task. Null numbers aren't counted; null keys are a group.
    """
    ids = df.where(F.col(f"`{number}`").isNotNull()).select(*[F.col(f"`{c}`") for c in by], F.col(f"`{number}`").cast("bigint").alias("_id"))
    return ids.groupBy(*by, F.bitmap_bucket_number("_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_id")).alias("ids"))


def count_distinct(partials: DataFrame, by: Sequence[str], name: str = "ids") -> DataFrame:
    """(by..., name): how many different numbers the bitmaps of each group hold together."""
    merged = partials.groupBy(*by, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("ids")).alias("_n"))
    return merged.groupBy(*by).agg(F.sum("_n").alias(name))


def _factor(error: float) -> float:
    if not 1e-5 <= error < 1:
        raise ValueError("error must be from 0.00001 to below 1")
    return (1 + error) / (1 - error)


def value_partials(df: DataFrame, by: Sequence[str], value: str, error: float = 0.01) -> DataFrame:
    """(by..., sign, bucket, n): how many values of each group fall into each bucket.

    A bucket's bounds differ by a factor for which its middle is off by ``error``
    at most. Zero has a bucket of its own; values below it mirror those above;
    infinite ones have the last bucket. Null values and NaN aren't counted; null
    keys are a group. A group has at most as many rows as it has buckets: some
    700 for a million-fold range of values at 0.01.
    """
    v = F.col("_v")
    step = F.lit(math.log(_factor(error)))
    bucket = F.when(v == 0, 0).when(F.abs(v) == float("inf"), ENDLESS).otherwise(F.ceil(F.ln(F.abs(v)) / step))
    rows = df.select(*[F.col(f"`{c}`") for c in by], F.col(f"`{value}`").cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    return rows.groupBy(*by, F.signum("_v").cast("int").alias("sign"), bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(partials: DataFrame, by: Sequence[str], shares: dict[str, float], error: float = 0.01) -> DataFrame:
    """(by..., rows, a column for each share): about the smallest value that at least that share of the group's values don't exceed.

    The exact value and this one differ by ``error`` times the exact value at
    most, but for the rounding of doubles. error must be that of value_partials.
    """
    factor = _factor(error)
    merged = partials.groupBy(*by, "sign", "bucket").agg(F.sum("n").alias("n"))
    in_order = Window.partitionBy(*by).orderBy("sign", F.col("sign") * F.col("bucket"))
    so_far = merged.withColumns({"_to": F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_rows": F.sum("n").over(Window.partitionBy(*by))})
    middle = F.when(F.col("sign") == 0, 0.0).when(F.col("bucket") == ENDLESS, F.col("sign") * float("inf")).otherwise(F.col("sign") * F.exp(F.col("bucket") * math.log(factor)) * (2 / (factor + 1)))

    def at(share: float) -> Column:
        if not 0 < share <= 1:
            raise ValueError("a share must be above 0 and at most 1")
        place = F.greatest(F.lit(1), F.ceil(F.col("_rows") * F.lit(share)))
        return F.max(F.when((F.col("_to") >= place) & (F.col("_to") - F.col("n") < place), middle))

    return so_far.groupBy(*by).agg(F.max("_rows").alias("rows"), *[at(share).alias(name) for name, share in shares.items()])


def store_days(partials: DataFrame, path: str, day: str) -> None:
    """Writes partials to a table with a folder for each day. Days that partials has replace those stored; others stay as they are.

    So a run that was cut short is simply run again. partials must have whole
    days. Keep the path on storage that all executors share.
    """
    partials.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def stored_days(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table that store_days wrote, with its columns in the given order; filters on the day decide which folders are read."""
    return spark.read.schema(schema).parquet(path).select(*[F.col(f"`{c}`") for c in schema.names])


def last_days(partials: DataFrame, day: str, days: int) -> DataFrame:
    """partials, each filed under every day whose last ``days`` days have it, up to the table's last day.

    Groups by that day then merge the partials of a rolling stretch. The copies
    are narrow and merge before they are shuffled. Rows with a null day are left
    out; an empty table stays empty.
    """
    if days < 1:
        raise ValueError("days must be 1 at least")
    last = partials.agg(F.max(f"`{day}`")).first()[0]
    if last is None:
        return partials.where("false")
    until = F.least(F.date_add(F.col(f"`{day}`"), days - 1), F.lit(last))
    return partials.where(F.col(f"`{day}`").isNotNull()).withColumn(day, F.explode(F.sequence(F.col(f"`{day}`"), until)))
