"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child draws
``-ln(u) / weight`` with ``u`` fixed by the row's key and the child's name, and
the smallest draw wins. A changed weight alters only the draw of that child, so
rows move only out of, or into, subtrees whose weights change. The ``base`` shards
that a store is founded with share regions and racks, and ``base`` stays the same
as it grows; later shards open in regions of their own while all other weights
stand, so that a new shard takes rows only into itself.

Defined cases: a null key draws as the text ``~``; repeated keys share a shard
and take slots one after another in the order of checksum, size and text
length; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import pick, unit


@dataclass(frozen=True)
class Node:
    """A named subtree: either a shard number or children, with a weight."""

    name: str
    weight: float
    shard: int | None = None
    children: tuple["Node", ...] = ()


#: Shards that a store is founded with.
BASE = 16


def layout(shards: int, base: int = BASE, racks: int = 2, per_rack: int = 2) -> Node:
    """The tree of ``base`` shards in regions of ``racks`` x ``per_rack``, and a region for each shard beyond them."""
    regions, number = [], 0
    while number < base:
        region = []
        for r in range(racks):
            own = tuple(Node(f"s{k}", 1.0, k) for k in range(number, min(number + per_rack, base)))
            if own:
                region.append(Node(f"r{len(regions)}k{r}", float(len(own)), children=own))
            number += len(own)
        regions.append(Node(f"r{len(regions)}", sum(x.weight for x in region), children=tuple(region)))
    for k in range(base, shards):
        leaf = Node(f"s{k}", 1.0, k)
        regions.append(Node(f"r{len(regions)}", 1.0, children=(Node(f"r{len(regions)}k0", 1.0, children=(leaf,)),)))
    return Node("root", float(max(shards, base)), children=tuple(regions))


def _draw(key: Column, node: Node, seed: str) -> Column:
    return -F.ln(unit(f"{seed}/{node.name}", key)) / F.lit(node.weight)


def best_child(key: Column, children: tuple[Node, ...], seed: str) -> Column:
    """Position of the child with the smallest draw (the first of equals)."""
    live = [(i, c) for i, c in enumerate(children) if c.weight > 0]
    if len(live) == 1:
        return F.lit(live[0][0])
    draws = F.array(*[F.struct(_draw(key, c, seed).alias("d"), F.lit(i).alias("i")) for i, c in live])
    return F.array_min(draws)["i"]


def assign(df: DataFrame, key: Column, tree: Node, out: str, seed: str = "tree") -> DataFrame:
    """Add the shard of each row, level by level, drawing only on the path taken."""
    level, nodes = "__node", [tree]
    df = df.withColumn(level, F.lit(0))
    while any(n.children for n in nodes):
        below: list[Node] = []
        step = None
        for i, n in enumerate(nodes):
            if n.children:
                to = best_child(key, n.children, seed) + F.lit(len(below))
                below.extend(n.children)
            else:
                to = F.lit(len(below))
                below.append(n)
            if len(nodes) == 1:
                step = to
            else:
                step = F.when(F.col(level) == i, to) if step is None else step.when(F.col(level) == i, to)
        df, nodes = df.withColumn(level, step), below
    numbers = F.array(*[F.lit(n.shard) for n in nodes])
    return df.withColumn(out, F.element_at(numbers, F.col(level) + 1).cast("int")).drop(level)


def assign_shard(df: DataFrame, key: Column, shards: int, out: str, base: int = BASE) -> DataFrame:
    """Add the shard of each row among ``shards``, of which ``base`` were there from the start."""
    if not 1 <= base <= shards:
        raise ValueError("a store is founded with one shard at least, and has no fewer later")
    return assign(df, key, layout(shards, base), out)


def shard_documents(docs: DataFrame, shards: int = 16, base: int = BASE, rows_per_run: int = 50_000) -> DataFrame:
    """Every document with its shard, its slot there, and its shard among one more.

    Slots: rows of a shard fall into runs by a hash of the key; the runs' counts
    are pre-aggregated and summed before each, and rows are numbered within a
    run only. So no task orders a whole shard.
    """
    rows = pick(docs, doc_id="long", text="string").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    key = F.col("doc_id")
    rows = assign_shard(rows, key, shards, "shard", base)
    rows = assign_shard(rows, key, shards + 1, "grown_shard", base)
    n_runs = max(1, docs.count() // (rows_per_run * shards) + 1)
    rows = rows.withColumn("run", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(n_runs)))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("shard", "run").agg(F.count("*").alias("n")).select(
        "shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("nth", F.row_number().over(inside))
        .join(runs, ["shard", "run"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"), "grown_shard",
        )
    )
