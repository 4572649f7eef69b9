"""Logical blocks of pairs, their statistics, pruning and scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.wrap import wide_sum, wrap
from .filters import apply_filters


#: Slices hold about this many pairs at least, so that small columns do not fall into small files.
SLICE_ROWS = 100_000


def _cut(pairs: DataFrame, bounds: list) -> DataFrame:
    """Pairs with slice: how many of the sorted bounds are at most the id, found by halving.

    Each step is a projection of its own, so that the work and the compiled code
    of a row grow with the logarithm of the bounds.
    """
    known = F.array(*map(F.lit, bounds)).cast(f"array<{dict(pairs.dtypes)['id']}>")
    at, step = F.col("slice"), 1 << len(bounds).bit_length() >> 1
    rows = pairs.withColumn("slice", F.lit(0))
    while step:
        rows = rows.withColumn("slice", F.when(F.get(known, at + (step - 1)) <= F.col("id"), at + step).otherwise(at))  # null beyond the last
        step >>= 1
    return rows


def assign_blocks(pairs: DataFrame, rows_per_block: int = 1000, slices: int | None = None, firsts: bool = False) -> DataFrame:
    """Pairs with block_id: every ``rows_per_block`` pairs in the order of id and value.

    No window runs over all rows: ids fall into slices at quantiles, each slice
    is numbered by itself, and the slices' counts before it are added. Bounds
    and counts pass the driver, one of each a slice. Each partition of the result
    is a slice, sorted, and slices follow each other; all pairs of an id share one.
    ``firsts`` adds first: whether a pair is the first of its id in its block.
    """
    spark = pairs.sparkSession
    most = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = [i / most for i in range(1, most)]
    about = pairs.agg(F.count("*").alias("n"), *([F.percentile_approx("id", marks, 10_000).alias("bounds")] if marks else [])).first()
    bounds = (about["bounds"] or []) if marks else []
    if not slices:
        keep = max(1, min(most, about["n"] // SLICE_ROWS))
        bounds = [bounds[i * most // keep - 1] for i in range(1, keep)]
    bounds = sorted(set(bounds))
    rows = _cut(pairs, bounds)
    counts = dict(rows.groupBy("slice").count().collect())
    starts = [0]
    for i in range(len(bounds)):
        starts.append(starts[-1] + counts.get(i, 0))
    order = Window.partitionBy("slice").orderBy("id", "value")
    before = F.get(F.array(*map(F.lit, starts)).cast("array<bigint>"), F.col("slice"))
    rows = rows.repartitionById(len(starts), "slice").withColumns({"nth": F.row_number().over(order) + before - 1, "past": F.lag("id").over(order)})
    out = [*pairs.columns, F.expr(f"nth div {int(rows_per_block)}").alias("block_id")]
    if firsts:
        out.append((F.col("past").isNull() | (F.col("past") != F.col("id")) | (F.col("nth") % int(rows_per_block) == 0)).alias("first"))
    return rows.select(*out)


def dense_blocks(pairs: DataFrame, rows_per_block: int = 1000) -> DataFrame:
    """Blocks of dense ids from 0: an exact projection for any BIGINT, no shuffle."""
    return pairs.withColumn("block_id", F.expr(f"id div {int(rows_per_block)}"))


def block_stats(blocks: DataFrame, distinct: Column | None = None) -> DataFrame:
    """One row a block: id and value ranges, exact sum, count and distinct ids. ``distinct`` counts them where blocks tell, else a shuffle of all ids does."""
    return blocks.groupBy("block_id").agg(
        F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        wide_sum(F.col("value")).alias("sum"), F.count("*").alias("count"), (F.countDistinct("id") if distinct is None else distinct).alias("distinct_ids"),
    )


def candidate_blocks(stats: DataFrame, allow: DataFrame | None = None) -> DataFrame:
    """block_id of the blocks whose id range meets the allow-set's; deny-sets never prune."""
    if allow is None:
        return stats.select("block_id")
    bounds = allow.agg(F.min("id").alias("lo"), F.max("id").alias("hi"))  # one row
    return stats.join(F.broadcast(bounds), (F.col("max_id") >= F.col("lo")) & (F.col("min_id") <= F.col("hi"))).select("block_id")


def scan_block(blocks: DataFrame, block_id: int, allow: DataFrame | None = None, deny: DataFrame | None = None) -> DataFrame:
    """The pairs of one block, filtered; a block that is not there has none."""
    return apply_filters(blocks.where(F.col("block_id") == block_id).select("id", "value"), allow, deny)


def describe(stats: DataFrame) -> DataFrame:
    """Blocks in order with their ranges, counts and wrapped sums."""
    return stats.withColumn("sum", wrap(F.col("sum"))).orderBy("block_id")
