"""The five measures of a column: count, min, max, sum, avg, always in one row.

Sums are exact and wrap once, at the end, to signed 64 bits; avg is the wrapped
sum over the count; an empty input gives zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.wrap import wide_sum, wrap
from .blocks import candidate_blocks
from .filters import apply_filters, envelope, within


def _finish(parts: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    total = wrap(F.col("sum"))
    avg = F.when(F.col("count") > 0, total.cast("double") / F.col("count")).otherwise(F.lit(0.0))
    return parts.select(zero("count"), zero("min"), zero("max"), total.alias("sum"), avg.alias("avg"))


def _fold(df: DataFrame, count: Column, low: Column, high: Column, total: Column) -> DataFrame:
    return df.agg(F.sum(count).alias("count"), F.min(low).alias("min"), F.max(high).alias("max"), wide_sum(total).alias("sum"))


def partials(pairs: DataFrame) -> DataFrame:
    """One row of mergeable measures."""
    return _fold(pairs, F.lit(1), F.col("value"), F.col("value"), F.col("value"))


def stat_partials(stats: DataFrame) -> DataFrame:
    """The same from block statistics, without reading pairs."""
    return _fold(stats, F.col("count"), F.col("min_value"), F.col("max_value"), F.col("sum"))


def merge(*parts: DataFrame) -> DataFrame:
    """Measures of several partial results; empty ones do not count."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return _finish(_fold(whole, F.col("count"), F.col("min"), F.col("max"), F.col("sum")))


def aggregate(
    pairs: DataFrame, allow: DataFrame | None = None, deny: DataFrame | None = None, stats: DataFrame | None = None, prune: bool = False, bounds: tuple[int, int] | None = None
) -> DataFrame:
    """The measures of the pairs that pass the filters.

    Statistics answer alone when there is no filter. ``bounds`` is an allow-set of
    consecutive ids, and needs no join. ``prune`` looks up the allow-set's envelope
    first. On a stored column both reach the scan, which skips row groups and pages.
    """
    if stats is not None and allow is None and deny is None and bounds is None:
        return _finish(stat_partials(stats))
    if prune and allow is not None:
        pairs = within(pairs, envelope(allow))
    return _finish(partials(apply_filters(pairs, allow, deny, bounds)))


def aggregate_parallel(pairs: DataFrame, workers: int, **options) -> DataFrame:
    """The same on at most ``workers`` scan tasks; 0 or less leaves that to Spark."""
    return aggregate(pairs.coalesce(workers) if workers > 0 else pairs, **options)


def aggregate_hybrid(blocks: DataFrame, stats: DataFrame, allow: DataFrame, deny: DataFrame | None = None) -> DataFrame:
    """Statistics for blocks that the filters leave whole, a scan for the rest.

    A block is whole if as many distinct ids of it are allowed as it has, and no
    denied id lies in its range. It counts allowed ids in the candidate blocks by
    one equi-join on the id.
    """
    candidates = candidate_blocks(stats, allow)
    have = blocks.select("block_id", "id").join(candidates, "block_id", "left_semi").distinct()
    met = have.join(allow.select("id"), "id", "left_semi").groupBy("block_id").agg(F.count("*").alias("allowed"))
    whole = stats.join(met, "block_id").where(F.col("allowed") == F.col("distinct_ids"))
    if deny is not None:
        denied = blocks.select("block_id", "id").join(deny.select("id"), "id", "left_semi").select("block_id").distinct()
        whole = whole.join(denied, "block_id", "left_anti")
    rest = blocks.join(candidates, "block_id", "left_semi").join(whole.select("block_id"), "block_id", "left_anti")
    return merge(stat_partials(whole), partials(apply_filters(rest.select("id", "value"), allow, deny)))
