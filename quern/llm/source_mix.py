"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key ``-ln(u) / w`` with ``w`` its quality
weight; a source's documents are taken in the order of their keys until its
token budget is filled. A budget above the source's size buys complete epochs
first, and only the rest is selected by the keys.

Defined cases: null text has size 0 and is never taken; a text without words has
size 0 and comes by its key like any other; a null source is a source of its own,
ordered last; a null doc_id draws as ``~`` with the text's digest, as any doc_id
does; rows equal in both share a draw and each count; a source without words has
target 0; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import column, n_words, pick, settle, unit

WEIGHTS = (5.0, 2.0, 1.0)


#: Marks that prose has few of.
MARKS = "0123456789#%&$*<>{}[]|\\~^=+_@/"


def quality_weight(text: Column) -> Column:
    """One less the share of digits and marks among a text's characters, to 4 places, 0.05 at least."""
    size = F.greatest(F.char_length(text), F.lit(1))
    odd = F.char_length(text) - F.char_length(F.translate(text, MARKS, ""))
    return F.greatest(F.lit(0.05), F.round(F.lit(1.0) - odd / size, 4))


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """A target for each source, from (source, source_size).

    Filling by weight with a cap on each source: in ascending order of cap over
    weight, the sources up to some place are full, and the rest share what is
    left by weight. The level is the first that no later source exceeds. One
    row a source goes through the window, nothing of the documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("w", F.element_at(cycle, (F.row_number().over(order) - 1) % len(weights) + 1))
    s = s.withColumn("cap", F.lit(float(cap)) * F.col("source_size")).withColumn("r", F.col("cap") / F.col("w"))
    rising = Window.orderBy("r", F.col("source").asc_nulls_last())
    past = rising.rowsBetween(Window.unboundedPreceding, -1)
    on = rising.rowsBetween(0, Window.unboundedFollowing)
    everything = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.lit(float(share)) * F.sum("source_size").over(everything)
    s = s.withColumn("level", (total - F.coalesce(F.sum("cap").over(past), F.lit(0.0))) / F.sum("w").over(on))
    s = s.withColumn("level", F.first(F.when(F.col("level") <= F.col("r"), F.col("level")), ignorenulls=True).over(everything))
    full = F.col("level").isNull() | (F.col("r") <= F.col("level"))
    return s.select("source", "source_size", F.when(full, F.col("cap")).otherwise(F.col("level") * F.col("w")).alias("target"))


def _draw(doc_id: Column, text: Column, seed: str) -> Column:
    """The exponential key of a document."""
    return -F.ln(unit(seed, doc_id, F.md5(text.cast("binary")))) / F.coalesce(quality_weight(text), F.lit(0.05))


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: Sequence[float] = WEIGHTS, seed: str = "mix", rows_per_bin: int = 4_000) -> DataFrame:
    """Each document with its size, its source's size and target, and the words taken of it.

    The texts are read once; what follows needs a few numbers a row. The prefix
    sums run over bins of the keys: bin totals are pre-aggregated and summed, and
    documents are ordered within a bin only, so that a source with most of the
    rows is spread over tasks. No stretch of keys holds more than its width's
    share of the rows, as no weight is above 1, so that equal widths bound every
    bin. A document counts as taken if at least half of it fits into what is left
    of the budget.
    """
    rows = pick(docs, doc_id="long", text="string", source="string").select(
        "doc_id", "source", n_words(F.col("text")).alias("size"), F.col("text").isNotNull().alias("there"), _draw(F.col("doc_id"), F.col("text"), seed).alias("draw"),
    )
    rows = settle(rows, "mix")
    bins = max(256, rows.count() // rows_per_bin + 1)
    rows = rows.withColumn("bin", F.floor(F.col("draw") * F.lit(float(bins))).cast("long"))
    known = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    goal = targets(known.groupBy("source").agg(F.sum("bin_size").cast("long").alias("source_size")), share, cap, weights)
    past = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumn("before", F.coalesce(F.sum("bin_size").over(past), F.lit(0)))
    goal = goal.select(F.col("source").alias("goal_source"), "source_size", "target")
    known = known.join(goal, F.col("source").eqNullSafe(F.col("goal_source"))).select(
        F.col("source").alias("known_source"), F.col("bin").alias("known_bin"), "before", "source_size", "target"
    )
    upto = Window.partitionBy("source", "bin").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(upto))
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("known_source")) & (F.col("bin") == F.col("known_bin")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - epochs * F.col("source_size")
    chosen = F.col("before") + F.col("upto") - F.col("size") / 2 <= rest
    times = F.when(F.col("there"), epochs + F.when(chosen & (rest > 0), F.lit(1)).otherwise(F.lit(0))).otherwise(F.lit(0))
    return rows.select(
        "doc_id", "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"),
        times.cast("int").alias("times"), epochs.cast("int").alias("epochs"), "source", "draw",
    )


def apply_mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: Sequence[float] = WEIGHTS, seed: str = "mix") -> DataFrame:
    """The mixed corpus: every document as often as it is taken, with the columns of ``docs``.

    The last key taken of each source decides, so the texts are not shuffled: a
    row needs its own key and its source's line of a small table. Rows with
    equal keys are taken together.
    """
    rated = mix(docs, share, cap, weights, seed)
    goal = settle(rated.groupBy("source").agg(F.first("epochs").alias("epochs"), F.max(F.when(F.col("times") > F.col("epochs"), F.col("draw"))).alias("last")), "goals")
    goal = goal.select(F.col("source").alias("__source"), F.col("epochs").alias("__epochs"), F.col("last").alias("__last"))
    text, source = column(docs, "text", "string"), column(docs, "source", "string")
    out = docs.withColumns({"__draw": _draw(column(docs, "doc_id", "long"), text, seed), "__own": source, "__there": text.isNotNull()})
    out = out.join(goal, F.col("__own").eqNullSafe(F.col("__source"))).where("__there")
    times = F.col("__epochs") + F.when(F.col("__draw") <= F.col("__last"), F.lit(1)).otherwise(F.lit(0))
    out = out.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), times.cast("int"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def sql() -> str:
    """``mix`` of documents with the defaults, for DuckDB; without the draw."""
    marks = MARKS.replace("'", "''")
    return f"""
        WITH r AS (SELECT doc_id, source, text IS NOT NULL AS there, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
                          md5('mix|' || coalesce(doc_id::VARCHAR, '~') || '|' || coalesce(md5(text), '~')) AS h,
                          coalesce(greatest(0.05::DOUBLE, round(1.0::DOUBLE - (length(text) - length(translate(text, '{marks}', ''))) / greatest(length(text), 1)::DOUBLE, 4)), 0.05::DOUBLE) AS w FROM documents),
        k AS (SELECT *, -ln((('0x' || substr(h, 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / {2**52}::DOUBLE) / w AS draw FROM r),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
        t AS (SELECT *, [{', '.join(f'{w}::DOUBLE' for w in WEIGHTS)}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT] AS sw FROM s),
        c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / sw AS ratio FROM t),
        l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                        / sum(sw) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
        f AS (SELECT (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1) AS found),
        g AS (SELECT source, source_size, CASE WHEN found IS NULL OR ratio <= found THEN cap ELSE found * sw END AS target FROM l, f),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM g),
        p AS (SELECT k.*, source_size, target, epochs, target - epochs * source_size AS rest,
                     sum(size) OVER (PARTITION BY k.source ORDER BY draw, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source),
        q AS (SELECT *, CASE WHEN NOT there THEN 0 ELSE epochs + CASE WHEN rest > 0 AND upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END END AS times FROM p)
        SELECT doc_id, size, source_size, target, (times * size)::BIGINT AS taken, times::INT AS times, epochs::INT AS epochs, source FROM q"""
