import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F
from tidemill.operators import partials

DAY = dt.date(2024, 1, 1)


def some_rows(seed, n=600):
    rng = random.Random(seed)
    numbers = [None, 0, -1, 1, 32_767, 32_768, 32_769, -32_768, 2**62, -(2**62), *range(100, 140)]
    return [(rng.choice(("x", "x", "y", None)), DAY + dt.timedelta(days=rng.choice((0, 1, 2, 5, 6, 11))), rng.choice(numbers), rng.choice((None, 0.0, -0.0, rng.lognormvariate(0, 5), -rng.lognormvariate(0, 3)))) for _ in range(n)]


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame(rows, "g string, day date, id long, v double").repartition(3)


def in_last_days(rows, days):
    """The rows of each group and day's stretch, by looking through all."""
    last = max(r[1] for r in rows)
    out = {}
    for r in rows:
        for k in range(days):
            if (day := r[1] + dt.timedelta(days=k)) <= last:
                out.setdefault((r[0], day), []).append(r)
    return out


@pytest.mark.parametrize("days", (1, 3, 30))
def test_distinct_counts_of_rolling_days_are_exact(table, days):
    rows = some_rows(days)
    kept = partials.distinct_partials(table(rows), ["g", "day"], "id")
    found = partials.count_distinct(partials.last_days(kept, "day", days), ["g", "day"])
    assert {(r.g, r.day): r.ids for r in found.collect()} == {k: n for k, v in in_last_days(rows, days).items() if (n := len({r[2] for r in v} - {None}))}


def test_partials_in_two_lots_merge_like_one(table):
    rows = some_rows(4)
    for made, merged in (
        (lambda df: partials.distinct_partials(df, ["g"], "id"), lambda df: partials.count_distinct(df, ["g"])),
        (lambda df: partials.value_partials(df, ["g"], "v"), lambda df: partials.quantiles(df, ["g"], {"q": 0.3})),
    ):
        whole, lots = made(table(rows)), made(table(rows[:250])).union(made(table(rows[250:])))
        assert sorted(map(repr, merged(whole).collect())) == sorted(map(repr, merged(lots).collect()))


@pytest.mark.parametrize("error", (0.001, 0.01, 0.3))
def test_quantiles_are_within_their_error(table, error):
    rows = some_rows(11, 900)
    shares = {"least": 1e-9, "p10": 0.1, "p50": 0.5, "p99": 0.99, "most": 1.0}
    kept = partials.value_partials(table(rows), ["g", "day"], "v", error)
    found = {(r.g, r.day): r for r in partials.quantiles(partials.last_days(kept, "day", 4), ["g", "day"], shares, error).collect()}
    exact = {k: sorted(r[3] for r in v if r[3] is not None) for k, v in in_last_days(rows, 4).items()}
    assert {k: r.rows for k, r in found.items()} == {k: len(v) for k, v in exact.items()}
    for k, values in exact.items():
        for name, share in shares.items():
            value = values[max(1, math.ceil(len(values) * share)) - 1]
            assert abs(found[k][name] - value) <= abs(value) * error * (1 + 1e-9)


def test_quantiles_of_extreme_values(table):
    inf = math.inf
    values = [-inf, -1.7e308, -5e-324, 0.0, 5e-324, 1.7e308, inf, float("nan"), None]
    kept = partials.value_partials(table([("x", DAY, 1, v) for v in values]), ["g"], "v", 0.00001)
    found = partials.quantiles(kept, ["g"], {f"q{k}": k / 7 for k in range(1, 8)}, 0.00001).first()
    assert found.rows == 7 and (found.q1, found.q4, found.q7) == (-inf, 0.0, inf)
    assert found.q2 == pytest.approx(-1.7e308, rel=1e-4) and found.q6 == pytest.approx(1.7e308, rel=1e-4) and found.q3 <= 0 <= found.q5


def test_a_day_that_is_stored_again_replaces_itself_alone(spark, table, tmp_path):
    rows, path = some_rows(8), str(tmp_path / "kept")
    made = lambda some: partials.distinct_partials(table(some), ["g", "day"], "id")
    wrong = [r for r in rows if r[1] != DAY or r[0] == "y"] + [("z", DAY, 5, None)]
    partials.store_days(made(wrong), path, "day")
    for _ in range(2):  # a run that is repeated changes nothing
        partials.store_days(made([r for r in rows if r[1] == DAY]), path, "day")
    kept = partials.stored_days(spark, path, made(rows).schema)
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, made(rows).collect()))
    one = kept.where(F.col("day") == DAY)
    assert "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().executedPlan().toString() and one.count() > 0


def test_empty_tables_and_bad_parameters(table):
    none = table(some_rows(1)).where("false")
    for kept in (partials.distinct_partials(none, ["g", "day"], "id"), partials.value_partials(none, ["g", "day"], "v")):
        assert partials.last_days(kept, "day", 7).collect() == []
    assert partials.count_distinct(partials.distinct_partials(none, ["g"], "id"), ["g"]).collect() == []
    assert partials.quantiles(partials.value_partials(none, ["g"], "v"), ["g"], {"q": 0.5}).collect() == []
    for wrong in (lambda: partials.value_partials(none, ["g"], "v", 0.0), lambda: partials.quantiles(partials.value_partials(none, ["g"], "v"), ["g"], {"q": 0.0}), lambda: partials.last_days(none, "day", 0)):
        with pytest.raises(ValueError):
            wrong()
