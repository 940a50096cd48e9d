"""Column expressions that queries share."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact(column: Column | str, scale: int = 4) -> Column:
    """A double as decimal, so that sums don't depend on the order of rows."""
    return F.col(column).cast(f"decimal(18,{scale})") if isinstance(column, str) else column.cast(f"decimal(18,{scale})")


def ten_thousandths(column: str) -> Column:
    """A double as a whole number of ten-thousandths, without making a decimal of each value.

    It is what exact() holds for values of up to four decimals, as prices are. Of
    longer ones exact() rounds halves up in the value's decimal form, this rounds
    its product with 10,000 to the nearest whole number, halves to even.
    """
    return F.rint(F.col(column) * 10_000).cast("bigint")


def revenue(price: str = "l_extendedprice", discount: str = "l_discount") -> Column:
    """Price less discount in units of 1e-8, so that sums are exact in any order; in_units() makes money of a sum of it."""
    return (ten_thousandths(price) * (10_000 - ten_thousandths(discount))).cast("decimal(18,0)")


def in_units(total: Column) -> Column:
    """A sum of revenue(), or of such sums, as a double, rounded once."""
    return (total.cast("decimal(29,0)") * F.lit(Decimal("0.00000001"))).cast("double")


def clock(column: Column) -> Column:
    """A timestamp as text to the second."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def json_number(column: str, path: str) -> Column:
    """A whole number inside a JSON text; null where it is missing or no number."""
    return F.get_json_object(column, path).try_cast("bigint")
