"""Integer codecs as column expressions: delta, zigzag, varint, and the sizes that each encoding takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import ENCODINGS
from .wrap import wrap


def zigzag(v: Column) -> Column:
    """Signed to unsigned bits: 0, -1, 1, -2 become 0, 1, 2, 3."""
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-z.bitwiseAND(F.lit(1).cast("bigint")))


def varint_length(x: Column) -> Column:
    """Bytes of an unsigned base-128 varint of the 64 bits of x: 1 to 10."""
    out = F.lit(10)
    for k in range(9, 0, -1):
        out = F.when(F.shiftrightunsigned(x, 7 * k) == 0, F.lit(k)).otherwise(out) if 7 * k < 64 else out
    return out.cast("int")


def varint_bytes(x: Column) -> Column:
    """The varint itself: seven bits a byte, lowest first, the high bit set on all but the last."""
    n = varint_length(x)
    group = lambda i: F.call_function("shiftrightunsigned", x, i * 7).bitwiseAND(F.lit(127).cast("bigint"))
    byte = lambda i: group(i) + F.when(i < n - 1, F.lit(128)).otherwise(F.lit(0))
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), ""))


def varint_value(b: Column) -> Column:
    """The integer of a varint; input that is empty, cut short or too long fails."""
    text = F.hex(b)
    at = lambda i: F.conv(F.substring(text, i * 2 + 1, 2), 16, 10).cast("bigint")
    size = F.octet_length(b)
    bits = F.aggregate(
        F.sequence(F.lit(0), size - 1), F.lit(0).cast("bigint"),
        lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", at(i).bitwiseAND(F.lit(127).cast("bigint")), i * 7)),
    )
    whole = (size > 0) & (size <= 10) & (at(F.greatest(size - 1, F.lit(0))) < 128)
    return F.when(whole, bits).otherwise(F.raise_error(F.lit("malformed varint")).cast("bigint"))


def signed_varint_bytes(v: Column) -> Column:
    return varint_bytes(zigzag(v))


def signed_varint_value(b: Column) -> Column:
    return unzigzag(varint_value(b))


def _order(by: list[str], pos: str):
    return Window.partitionBy(*by).orderBy(pos)


def _minus(a: Column, b: Column) -> Column:
    return wrap(a.cast("decimal(38,0)") - b.cast("decimal(38,0)"))


def delta_encode(df: DataFrame, columns: list[str], by: list[str], pos: str) -> DataFrame:
    """Each column as its first value and then differences, modulo 2^64, within each block."""
    order = _order(by, pos)
    return df.withColumns({c: _minus(F.col(c), F.coalesce(F.lag(c).over(order), F.lit(0))) for c in columns})


def delta_decode(df: DataFrame, columns: list[str], by: list[str], pos: str) -> DataFrame:
    """The running sums of differences, modulo 2^64, within each block."""
    upto = _order(by, pos).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: wrap(F.sum(F.col(c).cast("decimal(38,0)")).over(upto)) for c in columns})


def encode(df: DataFrame, encoding: int, by: list[str], pos: str) -> DataFrame:
    """id and value as the encoding stores them: numbers, or varint bytes."""
    _, delta_id, delta_value, var_id, var_value = ENCODINGS[encoding]
    deltas = [c for c, on in (("id", delta_id), ("value", delta_value)) if on]
    out = delta_encode(df, deltas, by, pos) if deltas else df
    if var_id:
        out = out.withColumn("id", varint_bytes(F.col("id")))
    return out.withColumn("value", signed_varint_bytes(F.col("value"))) if var_value else out


def decode(df: DataFrame, encoding: int, by: list[str], pos: str) -> DataFrame:
    """The inverse of ``encode``."""
    _, delta_id, delta_value, var_id, var_value = ENCODINGS[encoding]
    out = df.withColumn("id", varint_value(F.col("id"))) if var_id else df
    out = out.withColumn("value", signed_varint_value(F.col("value"))) if var_value else out
    deltas = [c for c, on in (("id", delta_id), ("value", delta_value)) if on]
    return delta_decode(out, deltas, by, pos) if deltas else out


def encoding_sizes(df: DataFrame, by: list[str], pos: str) -> DataFrame:
    """For each encoding the bytes of ids and of values: (encoding, name, id_bytes, value_bytes, total_bytes)."""
    d = delta_encode(df.select(*by, pos, "id", "value", F.col("id").alias("d_id"), F.col("value").alias("d_value")), ["d_id", "d_value"], by, pos)
    sums = []
    for code, (_, delta_id, delta_value, var_id, var_value) in ENCODINGS.items():
        i, v = ("d_id" if delta_id else "id"), ("d_value" if delta_value else "value")
        sums.append(F.sum(varint_length(F.col(i)) if var_id else F.lit(8)).alias(f"i{code}"))
        sums.append(F.sum(varint_length(zigzag(F.col(v))) if var_value else F.lit(8)).alias(f"v{code}"))
    one = d.agg(*sums)
    rows = F.array(*[
        F.struct(F.lit(c).alias("encoding"), F.lit(e[0]).alias("name"), F.coalesce(f"i{c}", F.lit(0)).cast("bigint").alias("id_bytes"), F.coalesce(f"v{c}", F.lit(0)).cast("bigint").alias("value_bytes"))
        for c, e in ENCODINGS.items()
    ])
    return one.select(F.inline(rows)).withColumn("total_bytes", F.col("id_bytes") + F.col("value_bytes"))


def padding(pos: Column, page: int = 4096) -> Column:
    """Bytes to the next multiple of a page."""
    return F.pmod(-pos, F.lit(page))


def estimated_block_bytes(rows: Column, position: Column, pair_bytes: Column, header: int = 64, layout: int = 16, page: int = 4096) -> Column:
    """Bytes of a block of ``rows`` pairs at a position in a file, with the padding after it."""
    size = F.lit(header + layout) + rows * pair_bytes
    return size + padding(position + size, page)


