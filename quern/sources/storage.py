"""Columns on disk: Parquet sorted by id, with block statistics, the id set as bitmaps, and one row of metadata.

Each write goes to a folder of its own, which the metadata name. They are written
last, so that a column opens whole, in its new or its old state, or not at all.
Encodings with deltas or varints are stored as Parquet's delta pages, raw ones as
plain pages; ids and values stay columns of numbers, so that filters reach the scan.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import asdict, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ENCODINGS, ColumnOptions
from ..operators.aggregate import _finish, merge, partials, stat_partials
from ..operators.blocks import assign_blocks, block_stats
from ..operators.filters import apply_filters, bitmap_cardinality, bitmaps

VERSION = 2


def _path(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local master may do with a temporary one."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.applicationId not in _scratch:
        _scratch[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="quern-columns-")
    return _scratch[spark.sparkContext.applicationId]


_scratch: dict[str, str] = {}


def write_column(pairs: DataFrame, path: str, options: ColumnOptions | None = None, mode: str = "errorifexists") -> None:
    """Write pairs, sorted by id into blocks, then their statistics and id set, then the metadata. mode: errorifexists or overwrite."""
    options, spark = options or ColumnOptions(), pairs.sparkSession
    old = None
    if exists(spark, f"{path}/meta"):
        if mode != "overwrite":
            raise FileExistsError(f"{path} holds a column")
        old = StoredColumn(spark, path).folder
    folder = f"{path}/data-{uuid.uuid4().hex}"
    data = assign_blocks(pairs.select("id", "value"), options.rows_per_block, firsts=True)  # sorted, a slice a file
    pages = "v1" if options.encoding == 0 else "v2"
    data.write.option("parquet.block.size", options.block_bytes).option("parquet.enable.dictionary", "false").option("parquet.writer.version", pages).parquet(f"{folder}/pairs")
    stored = spark.read.parquet(f"{folder}/pairs")
    block_stats(stored, F.count_if("first")).repartitionByRange("block_id").sortWithinPartitions("block_id").write.parquet(f"{folder}/stats")
    bitmaps(stored).write.parquet(f"{folder}/ids")
    stats = spark.read.parquet(f"{folder}/stats")
    about = stat_partials(stats).select("count", "min", "max", "sum")
    about = about.join(F.broadcast(stats.agg(F.count("*").alias("block_count"), F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id"))))  # one row each
    meta = {"version": VERSION, **asdict(options), "encoding_name": ENCODINGS[options.encoding][0], "is_delta": options.is_delta, "is_varint": options.is_varint, "data": folder.rpartition("/")[2]}
    row = about.select(*[F.lit(v).alias(k) for k, v in meta.items()], F.col("block_count").cast("int").alias("block_count"), F.coalesce("count", F.lit(0)).cast("bigint").alias("total_items"), "min_id", "max_id", "count", "min", "max", "sum", F.current_timestamp().alias("created"))
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    if old:
        delete(spark, old)


class StoredColumn:
    """A column that was written: pairs, statistics and metadata. Open it once: schemas are read then."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.meta = spark.read.parquet(f"{path}/meta")
        about = self.meta.first()
        if about is None or about["version"] != VERSION:
            raise ValueError(f"{path} is no column of version {VERSION}")
        self.about = about.asDict()
        self.folder = f"{path}/{about['data']}"
        self._ids: DataFrame | None = None

    @cached_property
    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/pairs").select("id", "value", "block_id")

    @property
    def pairs(self) -> DataFrame:
        return self.blocks.select("id", "value")

    @cached_property
    def stats(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/stats")

    def totals(self) -> DataFrame:
        """The five measures of the whole column from its one row of metadata: no statistics, no pairs."""
        return _finish(self.meta.select("count", "min", "max", "sum"))

    def check(self) -> None:
        """Statistics and metadata must agree."""
        r = self.stats.agg(F.count("*").alias("b"), F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first()
        if (r["b"], r["n"]) != (self.about["block_count"], self.about["total_items"]):
            raise ValueError(f"{self.path}: {r['b']} blocks and {r['n']} pairs in the statistics, {self.about['block_count']} and {self.about['total_items']} in the metadata")

    def id_bitmaps(self) -> DataFrame:
        """The id set as it was written with the column."""
        return self.spark.read.parquet(f"{self.folder}/ids")

    def id_count(self) -> int:
        return bitmap_cardinality(self.id_bitmaps()).first()[0]

    def ids(self, keep: bool = False) -> DataFrame:
        """The distinct ids; ``keep`` caches them until ``forget``."""
        if self._ids is not None:
            return self._ids
        ids = self.pairs.select("id").distinct()
        if keep:
            self._ids = ids.cache()
        return ids

    def forget(self) -> None:
        if self._ids is not None:
            self._ids.unpersist()
            self._ids = None


def aggregate_stored(generations: Sequence[StoredColumn], allow: DataFrame | None = None) -> DataFrame:
    """The measures of several stored generations, oldest first, where the newest that has an id wins.

    Without a filter the newest generation answers by its statistics; older ones
    are scanned without the ids of all newer ones.
    """
    if not generations:
        raise ValueError("no generation")
    parts, newer = [], None
    for g in reversed(generations):
        whole = allow is None and newer is None
        parts.append(stat_partials(g.stats) if whole else partials(apply_filters(g.pairs, allow, newer)))
        newer = g.pairs.select("id") if newer is None else newer.union(g.pairs.select("id"))
    return merge(*parts)


class ColumnWriter:
    """Append in batches; ``close`` sorts and writes the whole column once. A close that fails can be called again."""

    def __init__(self, spark: SparkSession, path: str, options: ColumnOptions | None = None):
        self.spark, self.path, self.options = spark, path, options or ColumnOptions()
        self.closed, self._parts = False, 0

    def _open(self) -> None:
        if self.closed:
            raise ValueError("the writer is closed")

    def set_rows_per_block(self, rows: int) -> None:
        self._open()
        self.options = replace(self.options, rows_per_block=rows)

    def write(self, pairs: DataFrame) -> None:
        self._open()
        pairs.select("id", "value").write.mode("append").parquet(f"{self.path}/pending")
        self._parts += 1

    def _pending(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/pending") if self._parts else self.spark.createDataFrame([], "id bigint, value bigint")

    def total_items(self) -> int:
        """Pairs written so far."""
        return StoredColumn(self.spark, self.path).about["total_items"] if self.closed else self._pending().count()

    def close(self) -> None:
        """Write the column; again does nothing."""
        if self.closed:
            return
        write_column(self._pending(), self.path, self.options)
        self.closed = True
        delete(self.spark, f"{self.path}/pending")


def generate(spark: SparkSession, n: int, seed: int = 1, max_id: int = 1_000_000, max_value: int = 1_000_000) -> DataFrame:
    """Pairs for load tests: nine of ten ids near their row's place, seven of ten values near their ids."""
    i = F.col("id")
    spread = F.floor(F.rand(seed) * max_id)
    near = F.floor(i * (max_id / max(n, 1)) + F.rand(seed + 1) * 10)
    new = F.when(F.rand(seed + 2) < 0.9, near).otherwise(spread).cast("bigint")
    rows = spark.range(n).select(new.alias("id"))
    value = F.when(F.rand(seed + 3) < 0.7, F.pmod(F.col("id") + F.floor(F.rand(seed + 4) * 100), F.lit(max_value))).otherwise(F.floor(F.rand(seed + 5) * max_value))
    return rows.select("id", value.cast("bigint").alias("value"))
