"""Steps that follow one another in time, found without a user's whole history in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.operators import _own_name


def funnel(df: DataFrame, by: Sequence[str], time: str, order: str, first: Column, then: Sequence[tuple[str, Column]], within: int) -> DataFrame:
    """Each row that meets ``first``, with the first row of the next step after it, the first of the third after that, and so on.

    then: name and condition of each later step; the column of that name gets the
    order column's value of the step's row, or null where the step isn't reached
    within so many seconds of the first one. The first step's rows keep their
    columns; one of a later step's name is replaced. Rows are compared by time and then
    by order, which must be unique within a key for the same result each time; a
    row that meets several conditions is never two steps of one chain.

    The earliest row of a step leaves the most time for the rest, so that a chain
    needs only the next row of each step. Rows are filed by key and stretch of
    ``within`` seconds, later steps under the stretch before as well: a chain ends
    in its first row's stretch or in the next. So a key with most rows is split by
    time, and one shuffle and one sort serve all steps; what one task holds is a
    key's steps in two stretches, which Spark spills if need be. No pairs are made. Null
    keys are a key; rows with a null time or order are no step; an empty table
    gives an empty result. Repeated first rows stay.
    """
    if not then:
        raise ValueError("a funnel has two steps at least")
    if within < 1:
        raise ValueError("within must be a second at least")
    names, met = [name for name, _ in then], [_own_name("met") for _ in then]
    row, at, number, starts, stretch, ahead = map(_own_name, ("row", "at", "number", "starts", "stretch", "ahead"))
    keys = [_own_name("key") for _ in by]
    later = F.lit(False)
    for m in met:
        later = later | F.col(m)
    given = df.where(F.col(f"`{time}`").isNotNull() & F.col(f"`{order}`").isNotNull())
    given = given.select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)],
        F.unix_micros(F.col(f"`{time}`").cast("timestamp")).alias(at),
        F.col(f"`{order}`").alias(number),
        F.coalesce(first, F.lit(False)).alias(starts),
        *[F.coalesce(condition, F.lit(False)).alias(m) for (_, condition), m in zip(then, met, strict=True)],
        F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in names]).alias(row),
    ).where(F.col(starts) | later)
    length = F.lit(within * 1_000_000).cast("bigint")
    own = F.col(at) - F.pmod(F.col(at), length)  # where the row's stretch begins
    filed = given.withColumn(stretch, F.explode(F.when(later, F.array(own, own - length)).otherwise(F.array(own))))
    # only the rows of the first step, where they stand themselves, need their other columns
    filed = filed.withColumn(row, F.when(F.col(starts) & (F.col(stretch) == own), F.col(row)))
    # from the last row to the first, each row sees what the nearest row of a later step leads to
    falling = Window.partitionBy(*keys, stretch).orderBy(F.desc(at), F.desc(number)).rowsBetween(Window.unboundedPreceding, -1)
    for m in reversed(met):
        here = F.array(F.struct(F.col(at).alias("at"), F.col(number).alias("number")))
        reached = F.concat(here, F.coalesce(ahead, F.slice(here, 1, 0))) if ahead in filed.columns else here
        filed = filed.withColumn(ahead, F.last(F.when(F.col(m), reached), ignorenulls=True).over(falling))
    limit = F.col(at) + length
    found = [F.when(F.get(ahead, F.lit(i))["at"] <= limit, F.get(ahead, F.lit(i))["number"]).alias(name) for i, name in enumerate(names)]
    return filed.where(F.col(row).isNotNull()).select(F.col(row), *found).select(f"{row}.*", *names)
