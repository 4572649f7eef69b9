"""Allow- and deny-sets of ids, their algebra, and the envelope that lets Parquet skip row groups.

``None`` means no filter; an empty set allows, or denies, nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def envelope(ids: DataFrame) -> tuple[int, int] | None:
    """Least and greatest id of a set, as literals for a scan: one row to the driver. None if the set is empty."""
    r = ids.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    return None if r["lo"] is None else (r["lo"], r["hi"])


def within(pairs: DataFrame, bounds: tuple[int, int] | None) -> DataFrame:
    """Pairs whose id lies in the bounds; on a stored column the literals reach the Parquet scan."""
    return pairs.where(F.lit(False)) if bounds is None else pairs.where(F.col("id").between(*bounds))


def apply_filters(pairs: DataFrame, allow: DataFrame | None = None, deny: DataFrame | None = None, bounds: tuple[int, int] | None = None) -> DataFrame:
    """Pairs whose id is in the allow-set and not in the deny-set.

    Sets meet pairs by semi and anti joins, so repeats in a set never multiply
    pairs; Spark broadcasts a set only when its measured size allows that.
    """
    out = pairs if bounds is None else within(pairs, bounds)
    if allow is not None:
        out = out.join(allow.select("id"), "id", "left_semi")
    return out if deny is None else out.join(deny.select("id"), "id", "left_anti")


def value_between(pairs: DataFrame, low: int, high: int) -> DataFrame:
    """Pairs by their value; on a stored column the range reaches the scan."""
    return pairs.where(F.col("value").between(low, high))


def ids_of(pairs: DataFrame) -> DataFrame:
    """The distinct ids of a column."""
    return pairs.select("id").distinct()


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").union(b.select("id")).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").distinct().join(b.select("id"), "id", "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").distinct().join(b.select("id"), "id", "left_anti")


def set_summary(ids: DataFrame) -> DataFrame:
    """(cardinality, min_id, max_id), zeros for an empty set."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return ids.agg(F.countDistinct("id").alias("cardinality"), zero(F.min("id")).alias("min_id"), zero(F.max("id")).alias("max_id"))


def bitmaps(ids: DataFrame) -> DataFrame:
    """The set as bitmaps: (bucket, bits)."""
    return ids.groupBy(F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def bitmap_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_cardinality(maps: DataFrame) -> DataFrame:
    return maps.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("bigint").alias("cardinality"))
