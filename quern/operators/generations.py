"""Several generations of one column: for every id the newest generation that has it wins.

All pairs of the winning generation stay, repeats included; an id can be
overwritten but not deleted.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregate import aggregate, merge, partials
from .filters import apply_filters

#: Beyond so many generations a chain of anti joins costs more than one shuffle by id.
CHAIN = 4


def stack(generations: Sequence[DataFrame]) -> DataFrame:
    """One table (id, value, gen), 0 the oldest."""
    return reduce(DataFrame.unionByName, [g.select("id", "value", F.lit(i).alias("gen")) for i, g in enumerate(generations)])


def resolve_latest(stacked: DataFrame) -> DataFrame:
    """The winning pairs: each id's greatest generation is pre-aggregated and joined back, so no id is a hot window."""
    newest = stacked.groupBy("id").agg(F.max("gen").alias("gen"))
    return stacked.join(newest, ["id", "gen"], "left_semi").select("id", "value", "gen")


def resolve_by_chain(generations: Sequence[DataFrame]) -> list[DataFrame]:
    """The winning pairs of each generation, newest first, by anti joins with all newer ids."""
    out, newer = [], None
    for g in reversed(generations):
        own = g.select("id", "value")
        out.append(apply_filters(own, deny=newer))
        newer = own.select("id") if newer is None else newer.union(own.select("id"))
    return out


def aggregate_latest(generations: Sequence[DataFrame], allow: DataFrame | None = None, empty: DataFrame | None = None) -> DataFrame:
    """The measures of the winning pairs. ``empty`` is any pairs table, for when there is no generation."""
    if not generations:
        if empty is None:
            raise ValueError("no generation, and no session to make an empty result")
        return aggregate(empty.where(F.lit(False)))
    if len(generations) <= CHAIN:
        return merge(*[partials(apply_filters(g, allow)) for g in resolve_by_chain(generations)])
    return aggregate(resolve_latest(stack(generations)), allow=allow)
