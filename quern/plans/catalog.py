"""Named queries over the driver's tables, and the same in SQL.

Base columns: O orders, E events, C customer (signed values), P part, and L
lineitem, whose ids repeat.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codecs
from ..model import column_of, id_set
from ..operators import aggregate as agg
from ..operators import blocks as blk
from ..operators import filters as flt
from ..operators import generations as gen
from ..sources.storage import StoredColumn, aggregate_stored, exists, scratch, write_column

#: Table, id and value of each base column.
BASES = {
    "O": ("orders", "o_orderkey", "floor(o_totalprice*100)"),
    "E": ("events", "event_id", "floor(value*100)"),
    "C": ("customer", "c_custkey", "floor(c_acctbal*100)"),
    "P": ("part", "p_partkey", "floor(p_retailprice*100)"),
    "L": ("lineitem", "l_orderkey*8+l_linenumber", "floor(l_extendedprice*100)"),
}


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, id, value = BASES[name]
    return column_of(spark.read.parquet(f"{sf_dir}/{table}.parquet"), id, value)


#: Columns that are open, by application and path.
_OPEN: dict[tuple[str, str], StoredColumn] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, pairs: DataFrame | None = None) -> StoredColumn:
    """A base column (or the given pairs) as a stored one; it is written at its first use in an application, and stays open."""
    app = spark.sparkContext.applicationId
    path = f"{scratch(spark)}/column-{name}-{md5(f'{app}/{sf_dir}/{name}'.encode()).hexdigest()}"
    if (app, path) not in _OPEN:
        if not exists(spark, f"{path}/meta"):
            write_column(base(spark, sf_dir, name) if pairs is None else pairs, path)
        _OPEN[app, path] = StoredColumn(spark, path)
    return _OPEN[app, path]


def _sql_base(name: str) -> str:
    table, id, value = BASES[name]
    return f"(SELECT CAST({id} AS BIGINT) AS id, CAST({value} AS BIGINT) AS value FROM {table})"


def _sql_measures(rows: str) -> str:
    return (
        "SELECT COUNT(*) AS count, COALESCE(MIN(value), 0) AS min, COALESCE(MAX(value), 0) AS max, CAST(COALESCE(SUM(value), 0) AS BIGINT) AS sum, "
        f"CASE WHEN COUNT(*) > 0 THEN CAST(CAST(SUM(value) AS BIGINT) AS DOUBLE) / COUNT(*) ELSE CAST(0 AS DOUBLE) END AS avg FROM {rows}"
    )


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _add(name: str, sql: str):
    def take(f):
        _QUERIES[name], _SQL[name] = f, sql
        return f

    return take


def _measures(name: str, column: str = "O", allow: str | None = None, deny: str | None = None, prune: bool = False, keep: bool = False) -> None:
    """A filtered aggregate of a base column; allow and deny are conditions on its ids. ``keep``: of the stored column."""
    sql = [f"({c})" if yes else f"NOT ({c})" for c, yes in ((allow, True), (deny, False)) if c]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = stored(spark, sf_dir, column).pairs if keep else base(spark, sf_dir, column)
        pick = lambda c: None if c is None else id_set(pairs.where(c))
        return agg.aggregate(pairs, pick(allow), pick(deny), prune=prune)

    _QUERIES[name] = run
    _SQL[name] = _sql_measures(f"{_sql_base(column)} t" + (f" WHERE {' AND '.join(sql)}" if sql else ""))


_measures("agg_full_scan")
_measures("agg_signed", "C")
_measures("agg_duplicates", "L")
_measures("agg_events", "E")
for _n, _step in (("sparse", 1000), ("medium", 10), ("dense", 2)):
    _measures(f"agg_allow_{_n}", allow=f"id % {_step} = 0", keep=True)
_measures("agg_deny", deny="id % 5 = 0", keep=True)
_measures("agg_allow_deny", allow="id < 2000", deny="id % 2 = 0", prune=True, keep=True)
_measures("agg_allow_empty", allow="id < 0")
_measures("agg_deny_empty", deny="id < 0")
_measures("agg_deny_all_allowed", allow="id < 500", deny="id < 500")


@_add("agg_allow_range", _sql_measures(f"{_sql_base('O')} t WHERE id >= (SELECT COUNT(*) // 4 FROM orders) AND id < (SELECT COUNT(*) // 2 FROM orders)"))
def _range(spark, sf_dir):
    column = stored(spark, sf_dir, "O")
    n = column.about["total_items"]
    return agg.aggregate(column.pairs, bounds=(n // 4, n // 2 - 1))


@_add("agg_allow_single_block", _sql_measures(f"{_sql_base('O')} t WHERE id BETWEEN 0 AND 999"))
def _single(spark, sf_dir):
    return agg.aggregate(stored(spark, sf_dir, "O").pairs, bounds=(0, 999))


@_add("agg_allow_nonexistent", _sql_measures(f"{_sql_base('O')} t WHERE false"))
def _nonexistent(spark, sf_dir):
    return agg.aggregate(base(spark, sf_dir, "O"), id_set(spark.range(10**12, 10**12 + 3)), prune=True)


@_add("agg_allow_cross_table", _sql_measures(f"{_sql_base('O')} t WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"))
def _cross(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return agg.aggregate(base(spark, sf_dir, "O"), id_set(lines.where("l_returnflag = 'R'"), "l_orderkey"))


@_add("agg_parallel", _sql_measures(f"{_sql_base('O')} t WHERE id % 2 = 0"))
def _parallel(spark, sf_dir):
    pairs = base(spark, sf_dir, "O")
    return agg.aggregate_parallel(pairs, 4, allow=id_set(pairs.where("id % 2 = 0")))


@_add("agg_value_between", _sql_measures(f"{_sql_base('O')} t WHERE value BETWEEN 1000000 AND 20000000"))
def _value(spark, sf_dir):
    return agg.aggregate(flt.value_between(stored(spark, sf_dir, "O").pairs, 1_000_000, 20_000_000))


def _blocks(spark, sf_dir, name="O"):
    return blk.dense_blocks(base(spark, sf_dir, name))


_SQL_BLOCKS = f"(SELECT id, value, CAST(id // 1000 AS INTEGER) AS block_id FROM {_sql_base('O')} b)"
_SQL_STATS = (
    "(SELECT block_id, MIN(id) AS min_id, MAX(id) AS max_id, MIN(value) AS min_value, MAX(value) AS max_value, CAST(SUM(value) AS BIGINT) AS sum, "
    f"COUNT(*) AS count, COUNT(DISTINCT id) AS distinct_ids FROM {_SQL_BLOCKS} GROUP BY block_id)"
)


@_add("agg_from_stats", _SQL["agg_full_scan"])
def _from_stats(spark, sf_dir):
    column = stored(spark, sf_dir, "O")
    return agg.aggregate(column.pairs, stats=column.stats)


@_add("agg_from_metadata", _SQL["agg_full_scan"])
def _from_metadata(spark, sf_dir):
    return stored(spark, sf_dir, "O").totals()


@_add("agg_hybrid", _sql_measures(f"{_sql_base('O')} t WHERE id BETWEEN 500 AND 4499 AND id <> 2500"))
def _hybrid(spark, sf_dir):
    column = stored(spark, sf_dir, "O")
    return agg.aggregate_hybrid(column.blocks, column.stats, id_set(spark.range(500, 4500)), id_set(spark.range(2500, 2501)))


@_add("stored_pairs", f"SELECT id, value FROM {_sql_base('L')} t")
def _stored_pairs(spark, sf_dir):
    return stored(spark, sf_dir, "L").pairs


@_add("stored_about", f"SELECT COUNT(*) AS total_items, (COUNT(*) + 999) // 1000 AS block_count, MIN(id) AS min_id, MAX(id) AS max_id, COUNT(DISTINCT id) AS id_count FROM {_sql_base('L')} t")
def _stored_about(spark, sf_dir):
    column = stored(spark, sf_dir, "L")
    column.check()
    return column.meta.select("total_items", F.col("block_count").cast("bigint").alias("block_count"), "min_id", "max_id", F.lit(column.id_count()).alias("id_count"))


@_add("block_stats", f"SELECT CAST(block_id AS BIGINT) AS block_id, min_id, max_id, min_value, max_value, sum, count, distinct_ids FROM {_SQL_STATS} s")
def _stats(spark, sf_dir):
    return blk.describe(blk.block_stats(_blocks(spark, sf_dir))).withColumn("block_id", F.col("block_id").cast("bigint"))


@_add("block_assignment", f"SELECT CAST((ROW_NUMBER() OVER (ORDER BY id, value) - 1) // 1000 AS BIGINT) AS block_id, id, value FROM {_sql_base('L')} b")
def _assignment(spark, sf_dir):
    return blk.assign_blocks(base(spark, sf_dir, "L"), 1000).select(F.col("block_id").cast("bigint").alias("block_id"), "id", "value")


@_add("candidate_blocks", f"SELECT CAST(block_id AS BIGINT) AS block_id FROM {_SQL_STATS} s WHERE max_id >= 1500 AND min_id <= 3200")
def _candidates(spark, sf_dir):
    found = blk.candidate_blocks(blk.block_stats(_blocks(spark, sf_dir)), id_set(spark.range(1500, 3201, 100)))
    return found.select(F.col("block_id").cast("bigint").alias("block_id"))


@_add("block_scan", f"SELECT id, value FROM {_SQL_BLOCKS} t WHERE block_id = 3")
def _scan(spark, sf_dir):
    return blk.scan_block(_blocks(spark, sf_dir), 3)


@_add("block_scan_filtered", f"SELECT id, value FROM {_SQL_BLOCKS} t WHERE block_id = 1 AND id % 3 = 0 AND id % 2 <> 0")
def _scan_filtered(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    return blk.scan_block(blocks, 1, id_set(blocks.where("id % 3 = 0")), id_set(blocks.where("id % 2 = 0")))


@_add("id_set", f"SELECT DISTINCT id FROM {_sql_base('L')} t")
def _ids(spark, sf_dir):
    return flt.ids_of(base(spark, sf_dir, "L"))


@_add("id_set_cardinality", f"SELECT COUNT(DISTINCT id) AS cardinality, MIN(id) AS min_id, MAX(id) AS max_id FROM {_sql_base('L')} t")
def _cardinality(spark, sf_dir):
    return flt.set_summary(base(spark, sf_dir, "L"))


@_add("id_set_bitmap", f"SELECT COUNT(DISTINCT id) AS cardinality FROM (SELECT id FROM {_sql_base('L')} t UNION ALL SELECT id FROM {_sql_base('O')} u)")
def _bitmap(spark, sf_dir):
    maps = flt.bitmap_union(flt.bitmaps(base(spark, sf_dir, "L")), flt.bitmaps(base(spark, sf_dir, "O")))
    return flt.bitmap_cardinality(maps)


def _two_sets(spark, sf_dir):
    orders = id_set(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey").where("id % 3 <> 0")
    return orders, id_set(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey").where("id % 2 = 0")


_SQL_A, _SQL_B = "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0", "SELECT l_orderkey AS id FROM lineitem WHERE l_orderkey % 2 = 0"
for _n, _word, _f in (("union", "UNION", flt.union), ("intersect", "INTERSECT", flt.intersect), ("difference", "EXCEPT", flt.difference)):
    _add(f"id_set_{_n}", f"SELECT DISTINCT id FROM ({_SQL_A} {_word} {_SQL_B}) t")(lambda spark, sf_dir, f=_f: f(*_two_sets(spark, sf_dir)))


def _generations(spark, sf_dir, n):
    o = base(spark, sf_dir, "O")
    second = o.where("id % 5 = 0").select("id", (F.col("value") * 2).alias("value"))
    third = o.where("id % 7 = 0").select("id", (F.col("value") + 1).alias("value"))
    third = third.union(o.where("id < 100").select((F.col("id") + 10_000_000).alias("id"), "value"))
    return [o, second, third][:n]


def _sql_latest(n: int) -> str:
    o = _sql_base("O")
    parts = [
        f"SELECT id, value, 0 AS gen FROM {o} a", f"SELECT id, value * 2 AS value, 1 AS gen FROM {o} b WHERE id % 5 = 0",
        f"SELECT id, value + 1 AS value, 2 AS gen FROM {o} c WHERE id % 7 = 0 UNION ALL SELECT id + 10000000 AS id, value, 2 AS gen FROM {o} d WHERE id < 100",
    ][:n]
    return f"(SELECT id, value, gen FROM (SELECT *, MAX(gen) OVER (PARTITION BY id) AS newest FROM ({' UNION ALL '.join(parts)}) u) w WHERE gen = newest)"


_add("gen_two", _sql_measures(f"{_sql_latest(2)} t"))(lambda spark, sf_dir: gen.aggregate_latest(_generations(spark, sf_dir, 2)))
_add("gen_three", _sql_measures(f"{_sql_latest(3)} t"))(lambda spark, sf_dir: gen.aggregate_latest(_generations(spark, sf_dir, 3)))


def _stored_generations(spark, sf_dir):
    return [stored(spark, sf_dir, f"G{i}", g) for i, g in enumerate(_generations(spark, sf_dir, 3))]


_add("gen_stored", _sql_measures(f"{_sql_latest(3)} t"))(lambda spark, sf_dir: aggregate_stored(_stored_generations(spark, sf_dir)))
_add("gen_stored_filtered", _sql_measures(f"{_sql_latest(3)} t WHERE id BETWEEN 10 AND 999"))(lambda spark, sf_dir: aggregate_stored(_stored_generations(spark, sf_dir), id_set(spark.range(10, 1000))))


@_add("gen_three_filtered", _sql_measures(f"{_sql_latest(3)} t WHERE id % 3 = 0"))
def _gen_filtered(spark, sf_dir):
    gens = _generations(spark, sf_dir, 3)
    return gen.aggregate_latest(gens, allow=id_set(gen.stack(gens).where("id % 3 = 0")))


@_add("gen_latest_pairs", f"SELECT id, value, CAST(gen AS BIGINT) AS gen FROM {_sql_latest(3)} t")
def _gen_pairs(spark, sf_dir):
    return gen.resolve_latest(gen.stack(_generations(spark, sf_dir, 3))).withColumn("gen", F.col("gen").cast("bigint"))


@_add("gen_duplicates", _sql_measures(f"(SELECT id, value FROM {_sql_base('O')} a WHERE id NOT IN (SELECT id FROM {_sql_base('L')} b) UNION ALL SELECT id, value FROM {_sql_base('L')} c) t"))
def _gen_duplicates(spark, sf_dir):
    return gen.aggregate_latest([base(spark, sf_dir, "O"), base(spark, sf_dir, "L")])


def _positions(spark, sf_dir, name):
    blocks = blk.dense_blocks(base(spark, sf_dir, name))
    return blocks.withColumn("pos", (F.col("id") % 1000).cast("int"))


_SQL_DELTA = "CAST({c} - COALESCE(LAG({c}) OVER (PARTITION BY id // 1000 ORDER BY id), 0) AS BIGINT)"


@_add("delta_encode", f"SELECT id, {_SQL_DELTA.format(c='id')} AS id_delta, {_SQL_DELTA.format(c='value')} AS value_delta FROM {_sql_base('E')} t")
def _delta(spark, sf_dir):
    rows = _positions(spark, sf_dir, "E").withColumns({"id_delta": F.col("id"), "value_delta": F.col("value")})
    return codecs.delta_encode(rows, ["id_delta", "value_delta"], ["block_id"], "pos").select("id", "id_delta", "value_delta")


@_add("delta_roundtrip", f"SELECT id, value FROM {_sql_base('E')} t")
def _delta_back(spark, sf_dir):
    rows = codecs.encode(_positions(spark, sf_dir, "E"), 3, ["block_id"], "pos")
    return codecs.decode(rows, 3, ["block_id"], "pos").select("id", "value")


@_add("varint_roundtrip", f"SELECT id, value FROM {_sql_base('C')} t")
def _varint_back(spark, sf_dir):
    rows = codecs.encode(_positions(spark, sf_dir, "C"), 7, ["block_id"], "pos")
    return codecs.decode(rows, 7, ["block_id"], "pos").select("id", "value")


_SQL_ZIGZAG = "CASE WHEN value >= 0 THEN value * 2 ELSE -value * 2 - 1 END"


@_add("zigzag", f"SELECT id, value, CAST({_SQL_ZIGZAG} AS BIGINT) AS zigzag FROM {_sql_base('C')} t")
def _zigzag(spark, sf_dir):
    return base(spark, sf_dir, "C").withColumn("zigzag", codecs.zigzag(F.col("value")))


def _sql_length(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {2 ** (7 * k)} THEN {k}" for k in range(1, 9)) + " ELSE 9 END"


@_add("varint_length", f"SELECT id, CAST({_sql_length('id')} AS BIGINT) AS id_bytes, CAST({_sql_length(f'({_SQL_ZIGZAG})')} AS BIGINT) AS value_bytes FROM {_sql_base('C')} t")
def _length(spark, sf_dir):
    length = lambda c: codecs.varint_length(c).cast("bigint")
    return base(spark, sf_dir, "C").select("id", length(F.col("id")).alias("id_bytes"), length(codecs.zigzag(F.col("value"))).alias("value_bytes"))


def _sql_sizes() -> str:
    zig = lambda c: f"(CASE WHEN {c} >= 0 THEN {c} * 2 ELSE -{c} * 2 - 1 END)"
    rows = []
    for code, (name, delta_id, delta_value, var_id, var_value) in codecs.ENCODINGS.items():
        i, v = ("d_id" if delta_id else "id"), ("d_value" if delta_value else "value")
        a = f"SUM({_sql_length(i)})" if var_id else "SUM(8)"
        b = f"SUM({_sql_length(zig(v))})" if var_value else "SUM(8)"
        rows.append(f"SELECT {code} AS encoding, '{name}' AS name, CAST({a} AS BIGINT) AS id_bytes, CAST({b} AS BIGINT) AS value_bytes, CAST({a} + {b} AS BIGINT) AS total_bytes FROM d")
    d = f"SELECT id, value, {_SQL_DELTA.format(c='id')} AS d_id, {_SQL_DELTA.format(c='value')} AS d_value FROM {_sql_base('C')} t"
    return f"WITH d AS ({d}) " + " UNION ALL ".join(rows)


@_add("encoding_sizes", _sql_sizes())
def _sizes(spark, sf_dir):
    return codecs.encoding_sizes(_positions(spark, sf_dir, "C"), ["block_id"], "pos")


@_add("sorted_pairs", f"SELECT id, value, CAST(ROW_NUMBER() OVER (ORDER BY id) AS BIGINT) AS pos FROM {_sql_base('P')} t")
def _sorted(spark, sf_dir):
    blocks = blk.assign_blocks(base(spark, sf_dir, "P"), 1000)
    nth = F.row_number().over(Window.partitionBy("block_id").orderBy("id", "value"))
    return blocks.select("id", "value", (F.col("block_id") * 1000 + nth).cast("bigint").alias("pos"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries by name."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """Their SQL for DuckDB."""
    return dict(_SQL)
