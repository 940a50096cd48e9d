import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from tidemill.operators.funnels import funnel

DAY = dt.datetime(2024, 1, 1)


def chains(rows, within):
    """What a funnel of the kinds a, b and c gives, by looking through all rows."""
    usable = sorted((r for r in rows if r[1] is not None and r[3] is not None), key=lambda r: (r[1], r[3]))
    out = []
    for start in (r for r in usable if r[2] in ("a", "ab")):
        found, here = [], start
        for kind in "bc":
            here = here and next((r for r in usable if r[0] == here[0] and (r[1], r[3]) > (here[1], here[3]) and kind in (r[2] or "") and (r[1] - start[1]).total_seconds() <= within), None)
            found.append(here and here[3])
        out.append((start[0], start[3], *found))
    return sorted(out, key=repr)


def of_kinds(df, within, first="a"):
    is_a = lambda kind: F.col("kind").contains(kind)
    return funnel(df, ["k"], "t", "i", is_a(first), [("b_id", is_a("b")), ("c_id", is_a("c"))], within)


@pytest.mark.parametrize("within", (1, 7, 60, 100_000))
def test_funnels_are_those_of_looking_through_all_rows(spark, within):
    rng = random.Random(within)
    kinds = ("a", "a", "b", "c", "ab", "bc", "x", None)
    rows = [(rng.choice(("u", "u", "u", "v", None)), None if rng.random() < 0.05 else DAY + dt.timedelta(milliseconds=500 * rng.randrange(-200, 400)), rng.choice(kinds), None if rng.random() < 0.03 else i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t timestamp, kind string, i int").repartition(5)
    assert sorted((tuple(r) for r in of_kinds(df, within).select("k", "i", "b_id", "c_id").collect()), key=repr) == chains(rows, within)


def test_a_step_at_the_very_end_of_the_time_counts(spark):
    at = lambda *seconds: [DAY + dt.timedelta(seconds=s) for s in seconds]
    rows = [("u", t, kind, i) for i, (t, kind) in enumerate(zip(at(9, 10, 19, 20), "aabc", strict=True))]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, kind string, i int")
    assert sorted((r.i, r.b_id, r.c_id) for r in of_kinds(df, 10).collect()) == [(0, 2, None), (1, 2, 3)]


def test_funnels_keep_repeated_first_rows_and_other_columns(spark):
    rows = [("u", DAY, "a", 1, "x", 9)] * 2 + [("u", DAY + dt.timedelta(seconds=1), "b", 2, "y", 8)]
    df = spark.createDataFrame(rows, "k string, t timestamp, kind string, i int, `_row.x` string, c_id int")
    found = of_kinds(df, 10)
    assert found.columns == ["k", "t", "kind", "i", "_row.x", "b_id", "c_id"]
    assert [tuple(r) for r in found.collect()] == [("u", DAY, "a", 1, "x", 2, None)] * 2
    assert of_kinds(df.where("false"), 10).collect() == [] and of_kinds(df, 10, first="z").collect() == []


def test_funnels_need_steps_and_time(spark):
    df = spark.createDataFrame([("u", DAY, "a", 1)], "k string, t timestamp, kind string, i int")
    with pytest.raises(ValueError, match="two steps"):
        funnel(df, ["k"], "t", "i", F.lit(True), [], 5)
    with pytest.raises(ValueError, match="second"):
        of_kinds(df, 0)


def test_a_hot_key_is_split_by_time_in_one_shuffle(spark):
    """One key has all rows: they are dealt by key and stretch, each at most twice, and sorted once."""
    df = spark.range(6_000).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 10).alias("t"), F.element_at(F.split(F.lit("a,b,c"), ","), (F.col("id") % 3 + 1).cast("int")).alias("kind"), F.col("id").alias("i"))
    found = of_kinds(df, 100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and "Join" not in plan
    assert found.where("b_id = i + 1 AND c_id = i + 2").count() == found.count() == 2_000
