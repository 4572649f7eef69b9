"""64-bit wrapping arithmetic under ANSI mode, through decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_M = "18446744073709551616"
_H = "9223372036854775808"


def wide_sum(value: Column) -> Column:
    """An exact sum."""
    return F.coalesce(F.sum(value.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))


def wrap(total: Column) -> Column:
    """An exact integer folded into a signed 64-bit one."""
    m, h = F.lit(_M).cast("decimal(38,0)"), F.lit(_H).cast("decimal(38,0)")
    r = F.pmod(total.cast("decimal(38,0)"), m)
    return F.when(r >= h, r - m).otherwise(r).cast("bigint")


def unsigned(x: Column) -> Column:
    """The 64 bits of a signed integer as an unsigned decimal."""
    d = x.cast("decimal(20,0)")
    return F.when(x < 0, d + F.lit(_M).cast("decimal(20,0)")).otherwise(d)
