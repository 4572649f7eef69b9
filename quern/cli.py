"""Command line: write and read columns, make load-test columns, time aggregates."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .model import ENCODINGS, ColumnOptions
from .operators.aggregate import aggregate
from .operators.blocks import describe
from .sources.storage import StoredColumn, generate, write_column


def _numbers(text: str) -> list[int]:
    return [int(x) for x in text.split(",") if x.strip()]


def walkthrough(spark: SparkSession) -> None:
    """Five filters on ids 1 to 300, whose values are 10, 5 and 2 times the id by hundreds."""
    i = F.col("id")
    pairs = spark.range(1, 301).select("id", (i * F.when(i <= 100, 10).when(i <= 200, 5).otherwise(2)).cast("bigint").alias("value"))
    some = lambda condition: pairs.where(condition).select("id")
    for name, allow, deny in (
        ("no filter", None, None), ("nine ids allowed", some("id % 100 IN (10, 20, 30)"), None), ("the first hundred denied", None, some("id <= 100")),
        ("the first two hundred allowed, even ids denied", some("id <= 200"), some("id % 2 = 0")),
        ("three ranges allowed, multiples of five denied", some("id % 100 BETWEEN 50 AND 75"), some("id % 5 = 0")),
    ):
        r = aggregate(pairs, allow, deny).first()
        print(f"{name}: count {r['count']} min {r['min']} max {r['max']} sum {r['sum']} avg {r['avg']:.2f}")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quern")
    sub = parser.add_subparsers(dest="command", required=True)
    write = sub.add_parser("write", help="write pairs given as lists")
    write.add_argument("path")
    write.add_argument("--ids", type=_numbers, required=True)
    write.add_argument("--values", type=_numbers, required=True)
    write.add_argument("--encoding", type=int, default=0, choices=sorted(ENCODINGS))
    read = sub.add_parser("read", help="show a column's metadata, and on request its pairs, blocks and measures")
    read.add_argument("path")
    for flag in ("--dump", "--agg", "--blocks"):
        read.add_argument(flag, action="store_true")
    load = sub.add_parser("import", help="write a generated column")
    load.add_argument("path")
    for name, default in (("--rows", 10_000_000), ("--rows-per-block", 10_000), ("--seed", 1), ("--max-id", 1_000_000), ("--max-value", 1_000_000)):
        load.add_argument(name, type=int, default=default)
    timed = sub.add_parser("aggregate", help="time a column's measures from statistics and by a scan")
    timed.add_argument("path")
    sub.add_parser("walkthrough", help="show allow- and deny-filters on 300 pairs in three blocks")
    a = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("quern").getOrCreate()
    if a.command == "write":
        if len(a.ids) != len(a.values):
            parser.error("as many values as ids are needed")
        write_column(spark.createDataFrame(list(zip(a.ids, a.values, strict=True)), "id bigint, value bigint"), a.path, ColumnOptions(a.encoding))
    elif a.command == "import":
        write_column(generate(spark, a.rows, a.seed, a.max_id, a.max_value), a.path, ColumnOptions(7, a.rows_per_block))
    elif a.command == "walkthrough":
        walkthrough(spark)
    else:
        column = StoredColumn(spark, a.path)
        print(f"version {column.about['version']}, {column.about['block_count']} blocks, {column.about['total_items']} pairs, encoding {column.about['encoding_name']}")
        if a.command == "aggregate":
            for name, stats in (("statistics", column.stats), ("scan", None)):
                began = time.time()
                print(name, aggregate(column.pairs, stats=stats).first().asDict(), f"{time.time() - began:.3f} s")
            return
        if a.blocks:
            describe(column.stats).show(truncate=False)
        if a.dump:
            for r in column.pairs.orderBy("id", "value").toLocalIterator():  # a partition at a time
                print(r["id"], r["value"])
        if a.agg:
            r = aggregate(column.pairs, stats=column.stats).first()
            print(f"count {r['count']} min {r['min']} max {r['max']} sum {r['sum']} avg {r['avg']:.2f}")


if __name__ == "__main__":
    main()
