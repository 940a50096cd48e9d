import os
import time

from pyspark.sql import functions as F
from tidemill.llm.components import components
from tidemill.llm.work import CLEANUP, settled, small


def shuffle_files(spark):
    """The shuffle files that are on disk now."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {name for top in dirs for _, _, names in os.walk(top) for name in names if name.startswith("shuffle_")}


def left(spark, before, seconds=10):
    """Those that are new; Spark deletes them in the background."""
    end = time.time() + seconds
    while (new := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.1)
    return new


def test_steps_leave_no_shuffle_files(spark):
    rows = spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    before = shuffle_files(spark)
    kept = settled(rows)
    small(kept, 10)
    found = components(spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "a long, b long"))
    assert not left(spark, before)
    assert sorted(map(tuple, kept.collect())) == sorted((k, 143 if k < 6 else 142) for k in range(7))
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)]
    rows.collect()  # the table that was given can still be run, and again
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, kept.collect()))


def test_the_sessions_own_setting_comes_back(spark):
    rows = spark.range(10).groupBy("id").count()
    was = spark.conf.get(CLEANUP, None)
    settled(rows)
    assert spark.conf.get(CLEANUP, None) == was
    try:
        for own in ("true", "false"):
            spark.conf.set(CLEANUP, own)
            settled(rows)
            assert spark.conf.get(CLEANUP) == own
    finally:
        spark.conf.unset(CLEANUP)
