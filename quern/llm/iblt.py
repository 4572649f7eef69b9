"""Document fingerprints by invertible Bloom lookup tables.

A text's paragraphs (lines; those of over LONG characters are cut after their
sentences) become 63-bit digests. A table has three rows of cells; each digest
is added to one cell of each row: to an XOR of digests, and to a sum that holds
the count and a check. Tables subtract cell by cell, so the difference of two
versions is built by adding one's digests and taking the other's away. Peeling
cells that hold one digest recovers the digests in which the versions differ.

A table has 24 cells for each segment of a few digests, dealt by bits of the
digests, so that work follows the length of a text and no row holds a whole
table of a long one. Segments that do not peel empty are rebuilt at 64 times the
size, and so on; what the last attempt leaves is compared digest by digest, so
that every difference is exact. All tables are columns of hash aggregates; everything after the
shuffle by document stays within its partition.

Defined cases: null text counts as empty; an empty text's table is empty, and
two empty texts are alike (1.0); repeated paragraphs count once; null doc_id
comes last; of rows that share a doc_id the lesser text comes first; a single
row is its own next; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import pick, settle

LONG = 300
ROWS, CELLS = 3, 8
#: Digests of one version that a segment is meant for.
PER_SEGMENT = 4
#: Peeling rounds of each attempt; an attempt has GROWTH times the cells of the one before.
ROUNDS, GROWTH = (6, 4, 4), 64
#: Chunks of the id order: bounds are gathered on the driver, so many at most.
MOST_CHUNKS = 4096
_ONE, _CHECK = 1 << 40, (1 << 32) - 1


def digests(text: Column) -> Column:
    """The distinct 63-bit digests of a text's paragraphs."""
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    cut = F.flatten(F.transform(lines, lambda x: F.when(F.length(x) > LONG, F.split(x, r"(?<=[.!?]) ")).otherwise(F.array(x))))
    return F.array_distinct(F.transform(cut, lambda x: F.xxhash64(x).bitwiseAND(F.lit((1 << 63) - 1))))


def _weight(key: Column) -> Column:
    """What a digest adds to a cell's sum: one to the count, and its check."""
    return F.lit(_ONE) + F.xxhash64(key).bitwiseAND(F.lit(_CHECK))


def _names() -> list[tuple[int, int, str, str]]:
    return [(r, i, f"k{r}_{i}", f"w{r}_{i}") for r in range(ROWS) for i in range(CELLS)]


def _sums(key: Column, weight: Column, base: Column | None = None) -> list[Column]:
    """Aggregates that add digests to cells; where ``base`` holds, the row is a table itself."""
    out = []
    for r, i, k, w in _names():
        here = F.shiftright(key, 3 * r).bitwiseAND(F.lit(CELLS - 1)) == i
        if base is None:
            out += [F.bit_xor(F.when(here, key).otherwise(0)).alias(k), F.sum(F.when(here, weight).otherwise(0)).alias(w)]
        else:
            out += [
                F.bit_xor(F.when(base, F.col(k)).when(here, key).otherwise(0)).alias(k),
                F.sum(F.when(base, F.col(w)).when(here, weight).otherwise(0)).alias(w),
            ]
    return out


def peel(tables: DataFrame, by: list[str], rounds: int) -> DataFrame:
    """(by, found, clean): digests that come out of each difference table, and whether it ends empty.

    A digest that the other version has is written as its complement. Each round
    takes the digests of all cells that hold one out of every table.
    """
    cells = [F.col(k) for *_, k, _ in _names()], [F.col(w) for *_, w in _names()]
    tables = tables.withColumn("found", F.lit(0).cast("long"))
    for _ in range(rounds):
        pure = [F.when(w == _weight(k), k).when(w == -_weight(k), F.bitwise_not(k)) for k, w in zip(*cells, strict=True)]
        out = F.array_distinct(F.array_compact(F.array(*pure)))
        rows = tables.withColumn("e", F.explode(F.array_append(out, F.lit(None).cast("long"))))
        rows = rows.withColumn("key", F.when(F.col("e") < 0, F.bitwise_not("e")).otherwise(F.col("e")))
        rows = rows.withColumn("weight", F.when(F.col("e") < 0, _weight(F.col("key"))).otherwise(-_weight(F.col("key"))))
        base = F.col("e").isNull()
        tables = rows.groupBy(*by).agg(*_sums(F.col("key"), F.col("weight"), base), F.sum(F.when(base, F.col("found")).otherwise(1)).alias("found"))
    empty = None
    for w in cells[1][:CELLS]:  # each digest is in every row
        empty = (w == 0) if empty is None else empty & (w == 0)
    return tables.select(*by, "found", empty.alias("clean"))


def _signed(rows: DataFrame) -> DataFrame:
    """(uid, pair, splits, key, weight): both versions of each pair, the other's taken away."""

    def side(name: str, pair: int, plus: bool) -> Column:
        return F.transform(name, lambda k: F.struct(F.lit(pair).alias("pair"), F.lit(plus).alias("plus"), k.alias("key")))

    every = F.concat(side("own", 0, True), side("new", 0, False), side("own", 1, True), side("after", 1, False))
    rows = rows.select("uid", "splits", F.inline(every))
    return rows.select("uid", "pair", "splits", "key", F.when(F.col("plus"), _weight(F.col("key"))).otherwise(-_weight(F.col("key"))).alias("weight"))


def differences(rows: DataFrame) -> DataFrame:
    """(uid, pair, d): digests in one version only, for pairs 0 (own, new) and 1 (own, after).

    Only segments that failed go to the next, larger attempt; those that fail
    the last are compared digest by digest.
    """
    by = ["uid", "pair", "segment"]
    rows = rows.repartition("uid")
    done, failed, bits = [], None, 62
    signed = _signed(rows)
    for attempt, rounds in enumerate(ROUNDS):
        if failed is None:
            signed = signed.withColumn("segment", F.pmod(F.shiftright("key", 16), F.col("splits")))
        else:
            signed = signed.join(failed, by, "left_semi")
            bits -= 6
            signed = signed.withColumn("segment", F.col("segment") * GROWTH + F.shiftright("key", bits - 6).bitwiseAND(F.lit(GROWTH - 1)))
        tables = signed.groupBy(*by).agg(*_sums(F.col("key"), F.col("weight")))
        result = settle(peel(tables, by, rounds), "peeled")
        done.append(result.select("uid", "pair", F.when(F.col("clean"), F.col("found")).otherwise(0).alias("d")))
        failed = result.where(~F.col("clean")).select(*by)
        if failed.isEmpty():
            break
    else:
        left = signed.join(failed, by, "left_semi").groupBy("uid", "pair", "key").agg(F.sum("weight").alias("w"))
        done.append(left.groupBy("uid", "pair").agg(F.count(F.when(F.col("w") != 0, 1)).alias("d")))
    whole = done[0]
    for more in done[1:]:
        whole = whole.union(more)
    return whole.groupBy("uid", "pair").agg(F.sum("d").alias("d"))


def _as_text(n: Column) -> Column:
    """A table as text: the number of digests, then each cell's sum and digests, in hexadecimals."""
    cells = [F.concat(F.hex(F.col(w)), F.lit("."), F.hex(F.col(k))) for *_, k, w in _names()]
    return F.concat(n.cast("string"), F.lit(":"), F.concat_ws(",", *cells))


def base_tables(rows: DataFrame) -> DataFrame:
    """(uid, fingerprint, edited_fingerprint): the 24-cell tables of own and new."""
    own = F.transform("own", lambda k: F.struct(F.lit(0).alias("version"), k.alias("key")))
    new = F.transform("new", lambda k: F.struct(F.lit(1).alias("version"), k.alias("key")))
    keys = rows.select("uid", F.inline(F.concat(own, new)))
    tables = keys.groupBy("uid", "version").agg(F.count("*").alias("n"), *_sums(F.col("key"), _weight(F.col("key"))))
    text = tables.select("uid", "version", _as_text(F.col("n")).alias("t"))
    pick_one = lambda v: F.max(F.when(F.col("version") == v, F.col("t")))
    return text.groupBy("uid").agg(pick_one(0).alias("fingerprint"), pick_one(1).alias("edited_fingerprint"))


def with_next(docs: DataFrame, rows_per_chunk: int = 1000) -> DataFrame:
    """Each row of (doc_id, text) with a number of its own, and the next text by doc_id.

    The id order is cut into chunks at quantiles; the first rows of each chunk
    go to the chunk before, too (the first of all to the last). So one shuffle
    of the texts by chunk suffices, and no task holds more than a chunk.
    """
    spark = docs.sparkSession
    chunks = max(1, min(MOST_CHUNKS, docs.count() // rows_per_chunk))
    marks = [i / chunks for i in range(1, chunks)]
    bounds = docs.agg(F.percentile_approx("doc_id", marks, 20_000)).first()[0] if marks else []
    bounds = sorted(set(bounds or []))
    coarse = bounds[::64] or [0]
    fine = F.array(*[F.array(*[F.lit(b).cast("long") for b in bounds[i : i + 64]]) for i in range(0, len(bounds), 64)]) if bounds else None
    if fine is None:
        chunk = F.lit(0)
    else:
        above = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in coarse]), lambda b: b <= F.col("doc_id")))
        inner = F.size(F.filter(F.element_at(fine, F.greatest(above, F.lit(1))), lambda b: b <= F.col("doc_id")))
        chunk = F.when(above == 0, F.lit(0)).otherwise((above - 1) * 64 + inner)
    chunk = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(chunk).cast("int")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), chunk.alias("chunk"))
    first = [(r["chunk"], r["least"]) for r in rows.groupBy("chunk").agg(F.min("doc_id").alias("least")).orderBy("chunk").collect()]
    known = [(c, least, first[i - 1][0]) for i, (c, least) in enumerate(first)]
    before = spark.createDataFrame(known, "chunk int, least long, previous int")  # MOST_CHUNKS + 1 rows at most
    rows = rows.join(F.broadcast(before), "chunk")
    here = F.struct(F.col("chunk").alias("chunk"), F.lit(False).alias("tail"))
    there = F.struct(F.col("previous").alias("chunk"), F.lit(True).alias("tail"))
    places = F.when(F.col("doc_id").eqNullSafe(F.col("least")), F.array(here, there)).otherwise(F.array(here))
    rows = rows.select("doc_id", "text", F.inline(places))
    order = Window.partitionBy("chunk").orderBy("tail", F.col("doc_id").asc_nulls_last(), "text")
    rows = rows.withColumn("next_text", F.lead("text").over(order))
    uid = F.col("chunk").cast("long") * (1 << 40) + F.row_number().over(order)
    rows = rows.withColumn("uid", uid)
    return rows.where(~F.col("tail")).select("uid", "doc_id", "text", F.coalesce("next_text", "text").alias("next_text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next text's."""
    rows = with_next(pick(docs, doc_id="long", text="string"))
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("uid", "doc_id", n.cast("long").alias("n_chars"), "text", "next_text", edited.alias("edited"))
    rows = rows.select(
        "uid", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("new"), digests(F.col("next_text")).alias("after"),
    )
    most = F.greatest(F.size("own"), F.size("new"), F.size("after"))
    rows = settle(rows.withColumn("splits", F.greatest(F.lit(1), F.ceil(most / PER_SEGMENT)).cast("long")), "digests")
    keys = rows.select("uid", "splits", "own", "new", "after")
    d = differences(keys).groupBy("uid").agg(
        F.sum(F.when(F.col("pair") == 0, F.col("d"))).alias("d0"), F.sum(F.when(F.col("pair") == 1, F.col("d"))).alias("d1")
    )
    out = rows.repartition("uid").join(base_tables(keys.repartition("uid")), "uid", "left").join(d, "uid", "left")
    empty = F.lit("0:" + ",".join(["0.0"] * (ROWS * CELLS)))

    def near(other: str, d: str) -> Column:
        both = F.size("own") + F.size(other)
        return F.when(both == 0, F.lit(1.0)).otherwise((both - F.col(d)) / (both + F.col(d)))

    return out.select(
        "doc_id", "n_chars", "edited_sha256", F.coalesce("fingerprint", empty).alias("fingerprint"),
        F.coalesce("edited_fingerprint", empty).alias("edited_fingerprint"), near("new", "d0").alias("near_edited"), near("after", "d1").alias("near_next"),
    )
