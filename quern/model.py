"""The data model: pairs (id, value), optionally with a block or a generation.

Ids and values are BIGINT without nulls. A column of any table becomes pairs by
``column_of``. Ids beyond 2^63 need ``wide_ids`` and are decimals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The eight integer encodings: code, name, whether ids and values are stored as deltas, whether as varints.
ENCODINGS = {
    0: ("raw", False, False, False, False),
    1: ("delta_id", True, False, False, False),
    2: ("delta_value", False, True, False, False),
    3: ("delta_both", True, True, False, False),
    4: ("varint", False, False, True, True),
    5: ("varint_id", True, False, True, False),
    6: ("varint_value", False, True, False, True),
    7: ("varint_both", True, True, True, True),
}


@dataclass(frozen=True)
class ColumnOptions:
    """How a column is written: its encoding, rows in a block, and target bytes of a row group."""

    encoding: int = 0
    rows_per_block: int = 1000
    block_bytes: int = 64 * 1024 * 1024

    def __post_init__(self):
        if self.encoding not in ENCODINGS:
            raise ValueError(f"unknown encoding {self.encoding}")
        if self.rows_per_block < 1 or self.block_bytes < 1:
            raise ValueError("a block holds one row at least")

    @property
    def is_delta(self) -> bool:
        return self.encoding in (1, 2, 3)

    @property
    def is_varint(self) -> bool:
        return self.encoding in (4, 5, 6, 7)


def column_of(df: DataFrame, id: Column | str, value: Column | str, wide_ids: bool = False) -> DataFrame:
    """Pairs from any table; a null id or value fails the query."""
    as_col = lambda c: F.expr(c) if isinstance(c, str) else c
    kind = "decimal(20,0)" if wide_ids else "bigint"
    need = lambda c, what: F.coalesce(c, F.raise_error(F.lit(f"null {what}")).cast(kind if what == "id" else "bigint"))
    return df.select(need(as_col(id).cast(kind), "id").alias("id"), need(as_col(value).cast("bigint"), "value").alias("value"))


def id_set(df: DataFrame, id: Column | str = "id") -> DataFrame:
    """A filter: one column of ids. Repeats do not matter."""
    return df.select((F.expr(id) if isinstance(id, str) else id).cast("bigint").alias("id"))
