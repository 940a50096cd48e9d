"""Operators on DataFrames that compose Spark's own: nothing here leaves the JVM."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.streaming import settled

BROADCAST_ROWS = 200_000


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, place: str = "place") -> DataFrame:
    """The first n rows of each group with their place; order must end in a unique column for the same rows each time.

    Spark limits each group before the shuffle as well (WindowGroupLimit).
    """
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(place) <= n)


def _own_name(what: str) -> str:
    """A column name that no table has."""
    return f"_{what}_{uuid.uuid4().hex}"


def running_total(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: Column, name: str = "running", ranges: Column | None = None, falling: bool = False) -> DataFrame:
    """The sum of a value over the rows of the group so far.

    ranges cuts large groups: an expression that never falls in the given order,
    such as a day where the order is by time; with falling, one that never rises
    in it. Totals by group and range, one row each, are summed first; each range
    then goes to a window of its own and starts from the total of those before
    it. Null values don't add; the sum is null where there has been none. A null
    range comes first, or last if ranges fall. A column of the given name is
    replaced; others stay, whatever their names.
    """
    if ranges is None:
        window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(name, F.sum(value).over(window))
    at, own, total, before = map(_own_name, ("range", "own", "total", "before"))
    cut = df.withColumns({at: ranges, own: value})
    earlier = Window.partitionBy(*by).orderBy(F.desc_nulls_last(at) if falling else F.asc_nulls_first(at)).rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*by, at).agg(F.sum(own).alias(total)).withColumn(before, F.sum(total).over(earlier)).drop(total)
    within = Window.partitionBy(*by, at).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _with_range(cut.withColumn(own, F.sum(own).over(within)), sums, [*by, at], [before]).withColumn(name, F.coalesce(F.col(own) + F.col(before), own, before)).drop(at, own, before)


def _with_range(df: DataFrame, found: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """df with the columns that found has for its keys, which may be null."""
    other = found.select(*[F.col(f"`{k}`").alias(_own_name(str(i))) for i, k in enumerate(keys)], *columns)
    same = [df[f"`{k}`"].eqNullSafe(other[n]) for k, n in zip(keys, other.columns, strict=False)]
    return df.join(other, same, "left").drop(*other.columns[: len(keys)])


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows; otherwise Spark shuffles for the join. Give it settled, narrow rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def as_of_join(left: DataFrame, right: DataFrame, by: Sequence[tuple[str, str]], left_at: Sequence[str], right_at: Sequence[str], columns: dict[str, str], ranges: Callable[[Column], Column]) -> DataFrame:
    """left with columns of the last row of right that has the same key and isn't later.

    by: pairs of key columns. left_at, right_at: columns to compare in order, such
    as a time and then an id; of equal places the right row counts as earlier. The
    last of right's columns must tell its rows apart for the same result each
    time. columns: new name by column of right. ranges: a function from the
    first of these columns to a range that never falls as it rises, such as a
    day. Rows of both sides are put in order by key and range, each range in a
    window of its own; a range's last right row, one by key and range, is carried
    to the ranges after it. So a key with most rows is split by its ranges, and
    no pairs are made. Rows without a match, with a null key or with a null place get
    nulls; null places of right are passed over. Left rows stay as they are,
    repeated ones too.
    """
    keys = [_own_name(f"key{i}") for i in range(len(by))]
    places = [_own_name(f"at{i}") for i in range(len(left_at))]
    side, at, row, value, before = map(_own_name, ("side", "range", "row", "value", "before"))
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    some = F.lit(True)
    for c in right_at:
        some = some & F.col(f"`{c}`").isNotNull()
    told = right.where(some).select(*[F.col(f"`{r}`").alias(k) for (_, r), k in zip(by, keys, strict=True)], *[F.col(f"`{c}`").alias(p) for c, p in zip(right_at, places, strict=True)], F.lit(0).alias(side), whole.alias(value))
    asked = left.select(*[F.col(f"`{c}`").alias(k) for (c, _), k in zip(by, keys, strict=True)], *[F.col(f"`{c}`").alias(p) for c, p in zip(left_at, places, strict=True)], F.lit(1).alias(side), F.struct("*").alias(row))
    both = told.unionByName(asked, allowMissingColumns=True).withColumn(at, ranges(F.col(places[0])))
    # where the keys are null nothing matches; those rows only pass through
    in_order = Window.partitionBy(*keys, at).orderBy(*[F.asc_nulls_first(p) for p in places], side).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy(F.asc_nulls_first(at)).rowsBetween(Window.unboundedPreceding, -1)
    # ranges without a right row need a carried one too, so both sides' ranges are listed
    listed = both.groupBy(*keys, at).agg(F.max_by(F.when(F.col(side) == 0, F.col(value)), F.when(F.col(side) == 0, F.struct(*places))).alias(value))
    carried = listed.withColumn(before, F.last(value, ignorenulls=True).over(earlier)).drop(value)
    found = both.withColumn(value, F.last(value, ignorenulls=True).over(in_order)).where(F.col(side) == 1)
    found = _with_range(found, carried, [*keys, at], [before])
    matched = F.coalesce(value, before)
    for k in (*keys, *places):
        matched = F.when(F.col(k).isNotNull(), matched)
    found = found.select(F.col(row), matched.alias(value))
    return found.select(f"{row}.*", *[F.col(f"{value}.c{i}").alias(name) for i, name in enumerate(columns.values())])


def interval_join(left: DataFrame, right: DataFrame, left_span: tuple[Column, Column], right_span: tuple[Column, Column], width: int, by: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Pairs of rows whose spans of whole numbers, both ends included, have a number in common, and whose keys (by) are equal.

    The columns of left and then those of right, whose names must differ. A span
    is filed under each stretch of ``width`` numbers that it touches; rows meet in
    a stretch and make a pair in the first one that they share, which is where
    the later of the two begins. So each pair comes once without a distinct(),
    and Spark's join splits stretches that hold many rows. width should be about
    as long as most spans: shorter ones make more copies of a row, longer ones
    more rows that meet in vain. Spans that are null or end before they begin
    match nothing; rows that repeat pair again.
    """
    low, high, bins, other_low, other_high, other_bins = map(_own_name, ("low", "high", "bin", "low", "high", "bin"))

    def stretch(at: Column) -> Column:
        """Where the stretch of a number begins."""
        return at - F.pmod(at, F.lit(width).cast("bigint"))

    def filed(df: DataFrame, span: tuple[Column, Column], names: tuple[str, str, str]) -> DataFrame:
        a, b, k = names
        cut = df.withColumns({a: span[0].cast("bigint"), b: span[1].cast("bigint")}).where(F.col(a) <= F.col(b))
        return cut.withColumn(k, F.explode(F.sequence(stretch(F.col(a)), stretch(F.col(b)), F.lit(width).cast("bigint"))))

    one, two = filed(left, left_span, (low, high, bins)), filed(right, right_span, (other_low, other_high, other_bins))
    same = F.col(bins) == F.col(other_bins)
    for x, y in by:
        same = same & (one[f"`{x}`"] == two[f"`{y}`"])
    meet = (F.col(low) <= F.col(other_high)) & (F.col(other_low) <= F.col(high))
    first = stretch(F.greatest(low, other_low)) == F.col(bins)
    return one.join(two, same & meet & first).drop(low, high, bins, other_low, other_high, other_bins)


def exact_quantile(df: DataFrame, by: Sequence[str], value: str, share: float, name: str = "quantile", buckets: int = 1_024, few: int = 10_000) -> DataFrame:
    """(by..., rows, name): each group's smallest value that at least ``share`` of its values don't exceed; exact, whatever the group's size.

    A group's values are counted in buckets between its least and its greatest,
    as partial sums before the shuffle; the bucket that holds the wanted place
    gives the next bounds, until its values are all equal or ``few`` are left,
    which alone are sorted. Each pass reads the rows again and narrows the bounds
    of all groups at once; only bounds, one row by group, are kept between
    passes, in the checkpoint folder. Null values aren't counted, and neither are NaN; a group of nulls
    has no row; null keys are a group. share: above 0, at most 1.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    keys = [f"k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)], F.col(f"`{value}`").cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    bounds = rows.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    bounds = bounds.withColumns({"rows": F.col("n"), "place": F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(share))).cast("bigint")})  # the place is counted from the bounds' least value
    bounds = settled(bounds)

    def inside(wanted: DataFrame) -> DataFrame:
        """Rows between the bounds of their group."""
        other = wanted.select(*[F.col(k).alias(f"of_{k}") for k in keys], "low", "high", "n", "rows", "place")
        same = F.col("v").between(F.col("low"), F.col("high"))
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
        return rows.join(_small(other), same)

    while not (wide := bounds.where((F.col("low") < F.col("high")) & (F.col("n") > few))).isEmpty():
        # the bounds have buckets of their own, so each pass narrows them; halves, as the difference of two doubles may be too large for one
        whole, part = F.col("high") / 2 - F.col("low") / 2, F.col("v") / 2 - F.col("low") / 2
        inner = F.when((whole == 0) | (whole == float("inf")), 1).otherwise(F.least(F.lit(buckets - 2), 1 + F.floor(F.try_divide(part, whole) * (buckets - 3))))
        bucket = F.when(F.col("v") == F.col("low"), 0).when(F.col("v") == F.col("high"), buckets - 1).otherwise(inner)
        counted = inside(wide).groupBy(*keys, bucket.alias("bucket")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"), F.first("rows").alias("rows"), F.first("place").alias("place"))
        so_far = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are buckets
        counted = counted.withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0)))
        narrowed = counted.where("before < place AND place <= before + n").withColumn("place", F.col("place") - F.col("before"))
        bounds = settled(bounds.where((F.col("low") >= F.col("high")) | (F.col("n") <= few)).unionByName(narrowed.select(bounds.columns)))
    equal = bounds.where("low >= high").select(*keys, "rows", F.col("low").alias("v"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("v"))
    sorted_ = inside(bounds.where("low < high")).withColumn("number", number).where("number = place").select(*keys, "rows", "v")
    return equal.union(sorted_).select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], "rows", F.col("v").alias(name))


def without(df: DataFrame, other: DataFrame, on: Column) -> DataFrame:
    """Rows of df that nothing in other matches."""
    return df.join(other, on, "left_anti")


def having(df: DataFrame, other: DataFrame, on: Column) -> DataFrame:
    """Rows of df that something in other matches, each once."""
    return df.join(other, on, "left_semi")


def subtotals(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], every: bool = False) -> DataFrame:
    """Aggregates by all keys and by each shorter prefix of them, or with every by each subset; level tells totals from null keys."""
    grouped = df.cube(*keys) if every else df.rollup(*keys)
    return grouped.agg(*aggregates, F.grouping_id().cast("bigint").alias("level"))


def sessions(df: DataFrame, by: Sequence[str], time: str, gap: str, aggregates: Sequence[Column]) -> DataFrame:
    """Groups each key's rows into sessions that end after a gap without rows."""
    return df.groupBy(*by, F.session_window(time, gap).alias("session")).agg(*aggregates)
