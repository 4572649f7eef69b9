"""Connected components of an edge table, never gathered on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import release, settle


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).where("lo <> hi").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (u, v); label is the component's least node.

    Each round hooks every root to its least neighbour, follows the hooks once,
    and contracts the edges. The first round orders nodes by their ids, which
    ends it for stars around the least; the later ones order them by a hash, so
    that rising chains are short and the number of roots falls by a constant
    share, for paths in the order of ids, too. The hooks and the edges that are
    left are written to the shared folder; the labels follow the hooks of all
    rounds at the end, in one query.
    """
    first = live = settle(_ordered(edges), "edges")
    rounds = []
    while not live.isEmpty():
        hooks = live.groupBy("hi").agg(F.min("lo").alias("to")).select(F.col("hi").alias("root"), "to")
        further = hooks.select(F.col("root").alias("to"), F.col("to").alias("next"))
        hooks = settle(hooks.join(further, "to", "left").select("root", F.coalesce("next", "to").alias("to")), "hooks")
        low = hooks.select(F.col("root").alias("lo"), F.col("to").alias("lo_to"))
        high = hooks.select(F.col("root").alias("hi"), F.col("to").alias("hi_to"))
        moved = live.join(low, "lo", "left").join(high, "hi", "left").select(F.coalesce("lo_to", "lo").alias("u"), F.coalesce("hi_to", "hi").alias("v"))
        if not rounds:
            moved = moved.select(_drawn("u").alias("u"), _drawn("v").alias("v"))
        rounds.append(hooks)
        before, live = live, settle(_ordered(moved), "edges")
        if before is not first:
            release(before)
    labels = first.select(F.col("lo").alias("node")).union(first.select("hi")).distinct().withColumn("label", F.col("node"))
    for number, hooks in enumerate(rounds):
        if number == 1:
            labels = labels.select("node", _drawn("label").alias("label"))
        labels = labels.join(hooks, labels["label"] == hooks["root"], "left").select("node", F.coalesce("to", "label").alias("label"))
    if len(rounds) > 1:
        labels = settle(labels, "roots")
        rounds.append(labels)
        labels = labels.join(labels.groupBy("label").agg(F.min("node").alias("least")), "label").select("node", F.col("least").alias("label"))
    labels = settle(labels, "labels")
    release(first, *rounds, *([] if live is first else [live]))
    return labels


def _drawn(node: str) -> Column:
    """A node that is ordered by a hash of its id."""
    return F.struct(F.xxhash64(node).alias("h"), F.col(node).alias("id"))


def joined_components(label: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links: only the components that the links join are worked on again."""
    end = lambda c: label.select(F.col("node").alias(c), F.col("label").alias("l" + c))
    between = links.join(end("u"), "u", "left").join(end("v"), "v", "left").select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v"))
    moved = components(between)
    to = moved.select(F.col("node").alias("label"), F.col("label").alias("to"))
    known = label.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    out = settle(known.union(moved.join(label, "node", "left_anti").select("node", "label")), "labels")
    release(moved)
    return out
