"""Literal fixtures of the column model: filters, generations, codecs, storage."""

import pytest
from pyspark.sql import functions as F

from quern import cli
from quern.functions import codecs
from quern.functions.wrap import wrap
from quern.model import ENCODINGS, ColumnOptions, column_of, id_set
from quern.operators import aggregate as agg
from quern.operators import blocks as blk
from quern.operators import filters as flt
from quern.operators import generations as gen
from quern.sources.storage import ColumnWriter, StoredColumn, generate, write_column
from quern.streaming.append import append_generations, read_generations

BIG = 2**63 - 1


def pairs_of(spark, rows):
    return spark.createDataFrame(rows, "id bigint, value bigint")


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id bigint")


@pytest.fixture(scope="module")
def three(spark):
    rows = [(i, i * (10 if i <= 100 else 5 if i <= 200 else 2), (i - 1) // 100) for i in range(1, 301)]
    return spark.createDataFrame(rows, "id bigint, value bigint, block_id int").cache()


CASES = [
    (None, None, (300, 10, 1000, 175850)),
    (range(1, 11), None, (10, 10, 100, 550)),
    ([50, 150, 250], None, (3, 500, 750, 1750)),
    ([1000, 2000, 3000], None, (0, 0, 0, 0)),
    ([10, 20, 110, 120, 210, 220], None, (6, 100, 600, 2310)),
    (range(150, 251), None, (101, 402, 1000, 67175)),
    (None, range(1, 6), (295, 60, 1000, 175700)),
    (range(1, 11), [1, 3, 5, 7, 9], (5, 20, 100, 300)),
    (range(1, 6), range(1, 6), (0, 0, 0, 0)),
    (None, [50, 150, 250], (297, 10, 1000, 174100)),
    (range(1, 101), range(50, 101), (49, 10, 490, 12250)),
    ([], None, (0, 0, 0, 0)),
    (None, [], (300, 10, 1000, 175850)),
    ([5, 5, 5], None, (1, 50, 50, 50)),
    ([10, 20, 30, 110, 120, 130, 210, 220, 230], None, (9, 100, 650, 3720)),
    (None, range(1, 101), (200, 402, 1000, 125350)),
    (range(1, 201), range(2, 301, 2), (100, 10, 995, 62500)),
    ([*range(50, 76), *range(150, 176), *range(250, 276)], range(5, 301, 5), (60, 502, 870, 39250)),
]


@pytest.mark.parametrize("allow,deny,want", CASES)
def test_filters(spark, three, allow, deny, want):
    a, d = (None if x is None else ids(spark, x) for x in (allow, deny))
    r = agg.aggregate(three, a, d, prune=True).first()
    assert tuple(r)[:4] == want
    assert r["avg"] == pytest.approx(want[3] / want[0] if want[0] else 0.0)
    if a is not None:
        assert tuple(agg.aggregate_hybrid(three, blk.block_stats(three), a, d).first()) == tuple(r)


def test_stats_and_candidates(spark, three):
    stats = blk.block_stats(three)
    got = [tuple(r) for r in blk.describe(stats).select("block_id", "min_id", "max_id", "min_value", "max_value", "sum", "count").collect()]
    assert got == [(0, 1, 100, 10, 1000, 50500, 100), (1, 101, 200, 505, 1000, 75250, 100), (2, 201, 300, 402, 600, 50100, 100)]
    assert tuple(agg.aggregate(three, stats=stats).first()) == tuple(agg.aggregate(three).first())
    for allow, want in (([50], [0]), ([150, 250], [1, 2]), ([1000], []), ([], [])):
        assert sorted(r[0] for r in blk.candidate_blocks(stats, ids(spark, allow)).collect()) == want
    assert blk.candidate_blocks(stats).count() == 3
    assert blk.scan_block(three, 0, deny=ids(spark, [1, 101, 201])).count() == 99
    assert blk.scan_block(three, 9).count() == 0


def test_duplicates_and_sets(spark):
    rows = [(i, 10 * i) for i in range(1, 11)] + [(i, i) for i in (5, 10, 15, 20, 25)]
    p = pairs_of(spark, rows)
    assert tuple(agg.aggregate(p).first())[:4] == (15, 5, 100, 625)
    assert tuple(flt.set_summary(p).first()) == (13, 1, 25)
    assert tuple(flt.set_summary(p.where("false")).first()) == (0, 0, 0)
    assert flt.bitmap_cardinality(flt.bitmaps(p)).first()[0] == 13


def test_generations(spark):
    g0 = pairs_of(spark, [(i, 10 * i) for i in range(1, 11)])
    g1 = pairs_of(spark, [(5, 500), (6, 600), (7, 700)] + [(i, 10 * i) for i in range(11, 16)])
    g2 = pairs_of(spark, [(3, 300), (4, 400), (11, 1100), (12, 1200)] + [(i, 10 * i) for i in range(16, 21)])
    assert tuple(gen.aggregate_latest([g0, g1, g2]).first()) == (20, 10, 1200, 6420, 321.0)
    assert tuple(gen.aggregate_latest([g0, g1, g2], allow=ids(spark, range(1, 11))).first()) == (10, 10, 700, 2800, 280.0)
    assert tuple(gen.aggregate_latest([g0, g1]).first()) == (15, 10, 700, 2820, 188.0)
    assert tuple(gen.aggregate_latest([], empty=g0).first()) == (0, 0, 0, 0, 0.0)
    assert tuple(agg.aggregate(gen.resolve_latest(gen.stack([g0, g1, g2]))).first()) == (20, 10, 1200, 6420, 321.0)
    twice = pairs_of(spark, [(1, 7), (1, 8)])
    assert sorted(r["value"] for r in gen.resolve_latest(gen.stack([g0, twice])).where("id = 1").collect()) == [7, 8]


def test_wrapping(spark):
    p = pairs_of(spark, [(1, BIG), (2, 1)])
    assert agg.aggregate(p).first()["sum"] == -(2**63)
    assert spark.range(1).select(wrap(F.lit("18446744073709551616").cast("decimal(38,0)"))).first()[0] == 0


def test_null_pairs_fail(spark):
    with pytest.raises(Exception, match="null value"):
        column_of(spark.sql("SELECT 1 AS a, CAST(NULL AS BIGINT) AS b"), "a", "b").collect()


VARINTS = [(0, "00"), (1, "01"), (127, "7F"), (128, "8001"), (16383, "FF7F"), (16384, "808001"), (2097151, "FFFF7F"), (2097152, "80808001"), (268435455, "FFFFFF7F"), (268435456, "8080808001"), (2**32 - 1, "FFFFFFFF0F")]


def test_codecs(spark):
    df = spark.createDataFrame(VARINTS, "v bigint, h string")
    bad = df.where((F.hex(codecs.varint_bytes(F.col("v"))) != F.col("h")) | (codecs.varint_value(F.unhex("h")) != F.col("v")) | (codecs.varint_length(F.col("v")) != F.length("h") / 2))
    assert bad.count() == 0
    sizes = spark.createDataFrame([(2**35, 6), (2**56, 9), (-1, 10)], "v bigint, n int")
    assert sizes.where(codecs.varint_length(F.col("v")) != F.col("n")).count() == 0
    zig = spark.createDataFrame([(0, 0), (-1, 1), (1, 2), (-2, 3)], "v bigint, z bigint")
    assert zig.where(codecs.zigzag(F.col("v")) != F.col("z")).count() == 0
    with pytest.raises(Exception, match="malformed"):
        spark.sql("SELECT X'80' AS b").select(codecs.varint_value(F.col("b"))).collect()
    pads = spark.createDataFrame([(0, 0), (4096, 0), (4097, 4095), (8191, 1), (1234, 2862), (12388, 3996)], "p bigint, w bigint")
    assert pads.where(codecs.padding(F.col("p")) != F.col("w")).count() == 0


@pytest.mark.parametrize("encoding", sorted(ENCODINGS))
def test_round_trips(spark, encoding):
    values = [0, 1, -1, 63, -64, 8191, -8192, BIG, -BIG, -BIG - 1]
    rows = [(i * i, v, i, 0) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id bigint, value bigint, pos int, block_id int")
    back = codecs.decode(codecs.encode(df, encoding, ["block_id"], "pos"), encoding, ["block_id"], "pos")
    assert sorted(tuple(r) for r in back.select("id", "value").collect()) == sorted((r[0], r[1]) for r in rows)


def test_storage_and_cli(spark, tmp_path, capsys):
    p = spark.range(20_000).select(((F.col("id") * 7) % 20_000).alias("id"), (F.col("id") * 100).alias("value"))
    write_column(p, str(tmp_path / "c"), ColumnOptions(7, 1000))
    c = StoredColumn(spark, str(tmp_path / "c"))
    assert c.about["block_count"] == 20 and c.about["is_varint"] and not c.about["is_delta"]
    assert tuple(agg.aggregate(c.pairs, stats=c.stats).first()) == tuple(agg.aggregate(c.pairs).first())
    assert agg.aggregate(c.pairs).first()["sum"] == 19_999_000_000
    assert c.ids(keep=True).count() == 20_000
    c.forget()
    w = ColumnWriter(spark, str(tmp_path / "w"))
    for b in range(3):
        w.write(spark.range(b * 10, b * 10 + 10).select("id", (F.col("id") * 100).alias("value")))
    w.close()
    w.close()
    assert StoredColumn(spark, str(tmp_path / "w")).about["total_items"] == 30
    with pytest.raises(ValueError):
        w.write(p)
    with pytest.raises(ValueError):
        ColumnOptions(8)
    assert not (tmp_path / "w" / "pending").exists() and w.total_items() == 30
    with pytest.raises(FileExistsError):
        write_column(p, str(tmp_path / "c"))
    write_column(p.where("id < 5000"), str(tmp_path / "c"), ColumnOptions(0, 500), mode="overwrite")
    again = StoredColumn(spark, str(tmp_path / "c"))
    again.check()
    assert (again.about["total_items"], again.about["block_count"], again.id_count()) == (5000, 10, 5000)
    assert tuple(again.totals().first()) == tuple(agg.aggregate(again.pairs).first())
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        StoredColumn(spark, str(tmp_path / "never"))
    cli.main(["write", str(tmp_path / "x"), "--ids", "1,5,10", "--values", "100,200,300"], spark)
    cli.main(["read", str(tmp_path / "x"), "--agg", "--dump", "--blocks"], spark)
    out = capsys.readouterr().out
    assert "count 3 min 100 max 300 sum 600 avg 200.00" in out and "5 200" in out
    cli.main(["import", str(tmp_path / "y"), "--rows", "3000", "--rows-per-block", "1000"], spark)
    cli.main(["aggregate", str(tmp_path / "y")], spark)
    assert capsys.readouterr().out.count("'count': 3000") == 2
    cli.main(["walkthrough"], spark)
    assert "count 60 min 502 max 870 sum 39250 avg 654.17" in capsys.readouterr().out
    assert generate(spark, 1000).count() == 1000


def test_filters_reach_the_scan(spark, tmp_path):
    write_column(spark.range(50_000).select("id", (F.col("id") * 3).alias("value")), str(tmp_path / "c"))
    pairs = StoredColumn(spark, str(tmp_path / "c")).pairs
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df, want in (
        (agg.aggregate(pairs, bounds=(0, 999)), "LessThanOrEqual(id,999)"), (agg.aggregate(pairs, ids(spark, [7, 90]), prune=True), "LessThanOrEqual(id,90)"),
        (agg.aggregate(flt.value_between(pairs, 30, 60)), "GreaterThanOrEqual(value,30)"),
    ):
        assert want in plan(df).split("PushedFilters:")[1].split("ReadSchema")[0]
    assert tuple(agg.aggregate(pairs, bounds=(0, 999)).first())[:4] == (1000, 0, 2997, 1498500)


def test_blocks_of_large_ids(spark):
    p = pairs_of(spark, [(9007199254741000999, 1), (BIG, 2)])
    assert [r["block_id"] for r in blk.dense_blocks(p).orderBy("id").collect()] == [9007199254741000, BIG // 1000]


def test_many_slices(spark, tmp_path):
    """Work on a row grows with the logarithm of the slices, and one shuffle sorts; numbers and files are in order."""
    rows = [(i * i % 4001 - 2000, i % 13) for i in range(6000)] + [(5, 5)] * 300 + [(BIG, 1), (-BIG - 1, 2), (BIG, 1)]
    want = [(id, value, n // 7) for n, (id, value) in enumerate(sorted(rows))]
    p = pairs_of(spark, rows).repartition(5)
    for slices in (1, 2, 3, 8, 500):
        got = blk.assign_blocks(p, 7, slices)
        assert sorted(tuple(r) for r in got.select("id", "value", "block_id").collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("CASE WHEN") <= 9 and plan.count("Exchange") == 2  # one of them is repartition's
    few = spark.conf.get("spark.sql.shuffle.partitions")
    write_column(spark.range(900_000).select((F.col("id") * 7 % 900_000).alias("id"), F.col("id").alias("value")), str(tmp_path / "c"))
    c = StoredColumn(spark, str(tmp_path / "c"))
    files = c.blocks.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy("lo").collect()
    assert len(files) == int(few) and files[0]["lo"] == 0 and files[-1]["hi"] == 899_999
    assert all(r["hi"] - r["lo"] + 1 == r["n"] < 150_000 for r in files)
    for r in files:
        stored = [x["id"] for x in spark.read.parquet(r["file"]).collect()]
        assert stored == sorted(stored)
    assert c.blocks.where("block_id <> id div 1000").count() == 0
    c.check()
    write_column(p, str(tmp_path / "r"), ColumnOptions(rows_per_block=7))
    r = StoredColumn(spark, str(tmp_path / "r"))
    assert sorted(map(tuple, r.stats.collect())) == sorted(map(tuple, blk.block_stats(r.blocks).collect()))
    assert sorted(map(tuple, r.blocks.collect())) == want and r.stats.count() == len(want) // 7 + 1
    write_column(p.where("false"), str(tmp_path / "e"))
    assert StoredColumn(spark, str(tmp_path / "e")).about["total_items"] == 0


def test_streamed_generations(spark, tmp_path):
    for b in range(2):
        pairs_of(spark, [(1, b), (b + 2, 5)]).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{b}"))
    stream = spark.readStream.schema("id bigint, value bigint").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    append_generations(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert agg.aggregate(gen.resolve_latest(read_generations(spark, str(tmp_path / "out")))).first()["count"] == 3


def test_random_properties(spark):
    p = spark.range(5000).select((F.col("id") * 3).alias("id"), (F.floor(F.rand(42) * 2001) - 1000).cast("bigint").alias("value")).cache()
    a, b = id_set(p.where("id % 2 = 0")), id_set(p.where("id % 2 = 1"))
    whole, even, odd = (agg.aggregate(p, x).first() for x in (None, a, b))
    assert even["count"] + odd["count"] == whole["count"] and even["sum"] + odd["sum"] == whole["sum"]
    assert tuple(agg.aggregate(p, flt.union(a, b)).first()) == tuple(whole)
    assert tuple(agg.aggregate_parallel(p, 3).first()) == tuple(whole)
