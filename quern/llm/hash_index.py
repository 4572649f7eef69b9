"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes by learned rotations: iterative quantisation turns
a rotation until the signs lie close to the rotated vectors, on a bounded sample
(``sample_rows``, lowest hash first). Codes split into substrings of 16 bits,
and every block of the index holds, for each substring, its distinct values and
who has them. By the pigeonhole principle a code within Hamming radius r has a
substring within floor(r / substrings); those values are probed (counted out, or
found among the block's values where these are fewer), codes outside the radius
go, and the rest is ranked by inner products of the original vectors in double
precision.

The radius is learned, too: the sample's queries are searched exactly, and the
radius covers ``cover`` of their true neighbours' codes. If a block gives a query fewer than
it asks for, the query's radius grows until the block gives enough or is spent.

Equal vectors are one class: it is searched once, and carries the least ids that
any query can need. Every vector is indexed; the stated queries meet all blocks.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows without vec_id; vectors meet those of their
own length, and each length has an index of its own; ties go to the lesser vec_id, and a vec_id that repeats with equal vectors counts once;
fewer candidates than asked for are all returned; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import pick, settle

SUB = 16  # bits of a substring
_FLIPS = {r: np.array([sum(1 << b for b in c) for c in combinations(range(SUB), r)], np.uint16) for r in range(3)}


def learn_rotations(x: np.ndarray, tables: int = 4, turns: int = 30, seed: int = 5) -> np.ndarray:
    """``tables`` rotations, each by iterative quantisation from another start."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    out = []
    for _ in range(tables):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(turns if len(x) else 0):
            u, _, v = np.linalg.svd(np.sign(x @ r).T @ x)
            r = (u @ v).T
        out.append(r)
    return np.concatenate(out, 1)


def encode(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Codes as rows of 16-bit substrings."""
    bits = (x @ rotation) > 0
    pad = -bits.shape[1] % SUB
    if pad:
        bits = np.pad(bits, ((0, 0), (0, pad)))
    return np.packbits(bits, axis=1).view(np.uint16)


def hamming(codes: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ q).sum(1, dtype=np.int64)


def learn_radius(x: np.ndarray, codes: np.ndarray, k: int, cover: float, queries: int = 200) -> int:
    """The radius that covers the share ``cover`` of the sample's true k nearest."""
    far = []
    for i in range(min(queries, len(x))):
        s = x @ x[i]
        s[i] = -np.inf
        top = np.argpartition(-s, min(k, len(s) - 1) - 1)[: min(k, len(s) - 1)] if len(s) > 1 else []
        far += hamming(codes[top], codes[i]).tolist()
    return int(np.quantile(far, cover)) + 1 if far else codes.shape[1] * SUB


class Block:
    """The multi-index of one block of codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.subs = []
        for column in codes.T:
            values, inverse, counts = np.unique(column, return_inverse=True, return_counts=True)
            order = np.argsort(inverse, kind="stable")
            self.subs.append((values, inverse, order, np.concatenate([[0], np.cumsum(counts)])))

    def within(self, q: np.ndarray, radius: int) -> np.ndarray:
        """Places of all codes within the radius."""
        each = radius // len(self.subs)
        if each >= SUB:
            marked = np.arange(len(self.codes))
        else:
            hit = np.zeros(len(self.codes), dtype=bool)
            for (values, inverse, order, starts), own in zip(self.subs, q, strict=True):
                if each < 2 and len(values) > 64:
                    probes = own ^ np.concatenate([_FLIPS[r] for r in range(each + 1)])
                    at = np.searchsorted(values, probes)
                    at[at == len(values)] = 0
                    for j in at[values[at] == probes]:
                        hit[order[starts[j] : starts[j + 1]]] = True
                else:
                    near = np.bitwise_count(values ^ own) <= each
                    hit |= near[inverse]
            marked = np.flatnonzero(hit)
        return marked[hamming(self.codes[marked], q) <= radius]

    def search(self, q: np.ndarray, radius: int, least: int) -> np.ndarray:
        """At least ``least`` places, by a growing radius, or all there are."""
        found = self.within(q, radius)
        while len(found) < min(least, len(self.codes)):
            radius += 2 * len(self.subs)
            found = self.within(q, radius)
        return found


def _valid(df: DataFrame) -> DataFrame:
    e = F.col("embedding")
    rows = pick(df, vec_id="long", embedding="array<double>").where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
    fine = ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(e, lambda v: v != 0)
    return rows.where(F.coalesce(fine, F.lit(False))).withColumn("embedding", F.transform(e, lambda v: v + F.lit(0.0)))


def nearest(df: DataFrame, k: int = 20, every: int = 20, cover: float = 0.97, sample_rows: int = 12_000, block_rows: int = 8192, query_rows: int = 2048) -> DataFrame:
    """For each row whose vec_id is divisible by ``every`` its k nearest others: (query_id, rank, vec_id, score)."""
    rows = _valid(df)
    lengths = sorted(r["d"] for r in rows.select(F.size("embedding").alias("d")).distinct().collect()) or [0]
    parts = [_nearest(rows.where(F.size("embedding") == d), d, k, every, cover, sample_rows, block_rows, query_rows) for d in lengths]
    return reduce(DataFrame.union, parts)


def _nearest(rows: DataFrame, d: int, k: int, every: int, cover: float, sample_rows: int, block_rows: int, query_rows: int) -> DataFrame:
    """The same for vectors of one length."""
    rows = rows.withColumn("key", F.xxhash64("embedding"))
    # The k + 1 least ids of each vector; the limit holds before the shuffle, too.
    least = Window.partitionBy("key", "embedding").orderBy("vec_id")
    members = rows.dropDuplicates(["key", "embedding", "vec_id"]).withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= k + 1)
    classes = members.groupBy("key", "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("key", "embedding").agg(F.lit(True).alias("asked"))
    classes = settle(
        classes.join(asked, ["key", "embedding"], "left").select(F.col("ids")[0].alias("rep"), "key", "embedding", "ids", F.coalesce("asked", F.lit(False)).alias("asked")), "classes"
    )
    sample = classes.orderBy("key", "rep").limit(sample_rows).select("embedding").toPandas()["embedding"]
    x = np.array(sample.tolist(), dtype=np.float64).reshape(-1, max(d, 1))
    rotation = learn_rotations(x[:4000])
    radius = learn_radius(x, encode(x, rotation), k, cover)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = np.asarray(b.column(1).flatten(), dtype=np.float64).reshape(b.num_rows, d)
            codes = encode(v, rotation)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r.tobytes() for r in v], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), b.column(2)], ["rep", "v", "code", "asked"]
            )

    index = settle(classes.select("rep", "embedding", "asked").mapInArrow(coded, "rep long, v binary, code binary, asked boolean"), "codes")
    counts = index.agg(F.count("*").alias("n"), F.count(F.when(F.col("asked"), 1)).alias("q")).first()
    blocks, groups = max(1, -(-counts["n"] // block_rows)), max(1, -(-counts["q"] // query_rows))
    spread = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.lit(n)).cast("int")
    left = index.where("asked").select("rep", "v", "code", spread(groups, 1).alias("g")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = index.select("rep", "v", "code", spread(blocks, 2).alias("b")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def meet(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "rep": [], "score": []}
        if len(queries) and len(block):
            reps = block["rep"].to_numpy(np.int64)
            order = np.argsort(reps)
            reps = reps[order]
            v = np.frombuffer(b"".join(block["v"]), np.float64).reshape(len(block), d)[order]
            own = Block(np.frombuffer(b"".join(block["code"]), np.uint16).reshape(len(block), -1)[order])
            qv = np.frombuffer(b"".join(queries["v"]), np.float64).reshape(len(queries), d)
            qc = np.frombuffer(b"".join(queries["code"]), np.uint16).reshape(len(queries), -1)
            for rep, x, c in zip(queries["rep"].to_numpy(np.int64), qv, qc, strict=True):
                at = own.search(c, radius, k + 1)
                s = (v[at] * x).sum(1)  # the same order of sums for every row
                best = np.lexsort((reps[at], -s))[: k + 1]
                out["query"].append(np.full(len(best), rep))
                out["rep"].append(reps[at][best])
                out["score"].append(s[best])
        return pd.DataFrame({n: np.concatenate(c) if c else [] for n, c in out.items()})

    met = left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInPandas(meet, "query long, rep long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    met = met.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).drop("nth")
    # From classes to ids: of each found class the least ids, of these the k + 1 best, less the query's own.
    ids = classes.select("rep", F.explode("ids").alias("vec_id"))
    wide = met.join(ids, "rep").withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("nth") <= k + 1)
    lists = wide.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("found"))
    who = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "key", "embedding").distinct()
    who = who.join(classes.where("asked").select("key", "embedding", F.col("rep").alias("query")), ["key", "embedding"]).select("query_id", "query")
    own = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)
    out = who.join(lists, "query").select("query_id", F.posexplode(own).alias("pos", "f"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.s")).alias("score"))
