"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct shingles of five words. Sets are kept in one
global order, rare shingles first; two sets of similarity t or more share at
least m shingles within their prefixes of ``n - ceil(t n) + m``, for any m up to
``ceil(t n)``. Each document picks the m (its *match*) whose prefix promises the
least cost, by the document frequencies of its shingles; a pair is verified only
if it shares the smaller m of the two within both prefixes of that m.

The work is kept from growing with the square of a group:

* equal sets are one class from the start;
* near copies first meet at hubs, the least document of each bottom-k value;
  verified links to hubs make clusters, so dense groups shrink to one cluster;
* clusters that share prefix shingles meet at hubs, too, for STAR_ROUNDS rounds;
* the exact prefix join then looks only at pairs across clusters: shingles whose
  holders are all in one cluster go before any pair is made, pairs are made at
  the places where the first shared shingle of linked sets must be, shared
  shingles count only within the prefixes that the two sizes ask for, and of two
  clusters the likeliest pair is verified first.

Document frequencies are counted over all documents in a sketch of fixed size;
they set the order only, so that collisions cost time and never a link.

Defined cases: null and empty texts have no shingles, and are linked with
nothing; shorter texts than five words are one shingle; rows that share a doc_id
are one document with the links of all of its rows; a row without doc_id takes
the component of equal texts, or null; an empty table gives no rows; extra
columns are ignored. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import pick, release, settle, tidy
from .graph import components, joined_components
from .shingles import scramble, shingle_sets

#: Cells of the frequency sketch and bits of the filter of wanted documents: fixed sizes, whatever the input.
CELLS, BITS = 1 << 20, 1 << 23
SEGMENTS = 32
KEYS = 4
MOST_MATCHES = 8
#: Rounds of linking clusters at hubs before all pairs across clusters are made.
STAR_ROUNDS = 2
#: Texts shingled at once; the arrays take some 100 bytes for each of their words.
BATCH = 100


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _cell(x: np.ndarray) -> np.ndarray:
    return (scramble(x, 21) >> np.uint64(44)).astype(np.int64)


def _profile(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(CELLS, np.int32)
        names = ["doc_id", "n", "h1", "h2", "keys", "segment", "cells"]
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                sets = shingle_sets(part.column(1).to_pylist(), width)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                sketch += np.bincount(_cell(flat), minlength=CELLS).astype(np.int32)
                with np.errstate(over="ignore"):
                    h1 = [int(_signed(scramble(s, 31).sum(keepdims=True, dtype=np.uint64))[0]) for s in sets]
                    h2 = [int(_signed(scramble(s, 32).sum(keepdims=True, dtype=np.uint64))[0]) for s in sets]
                keys = [_signed(np.partition(s, KEYS)[:KEYS] if len(s) > KEYS else s).tolist() for s in (scramble(s, 41) for s in sets)]
                none = pa.nulls(part.num_rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                     pa.array(keys, pa.list_(pa.int64())), none, pa.nulls(part.num_rows, pa.binary())], names,
                )
        cut = sketch.reshape(SEGMENTS, -1)
        longs = pa.nulls(SEGMENTS, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [longs, longs, longs, longs, pa.nulls(SEGMENTS, pa.list_(pa.int64())), pa.array(range(SEGMENTS), pa.int32()), pa.array([c.tobytes() for c in cut], pa.binary())], names
        )

    return run


def _sum_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partial sum a segment and partition."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(cells, np.int32).astype(np.int64)
            sums[k] = sums[k] + own if k in sums else own
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["segment", "cells"])


def _frequencies(profile: DataFrame) -> np.ndarray:
    """The summed sketch, less the noise of its cells. The driver gets SEGMENTS rows of fixed size."""
    parts = profile.where("segment IS NOT NULL").select("segment", "cells").repartition(SEGMENTS, "segment")
    out = np.zeros((SEGMENTS, CELLS // SEGMENTS), np.int64)
    for k, cells in parts.mapInArrow(_sum_cells, "segment int, cells binary").collect():
        out[k] = np.frombuffer(cells, np.int64)
    flat = out.reshape(-1)
    return np.maximum(flat - int(np.median(flat)), 0).astype(np.int32)


def _wanted(nodes: DataFrame) -> np.ndarray:
    """A filter of fixed size that all given nodes pass (and few others)."""
    spot = F.pmod(F.xxhash64("node"), F.lit(BITS)) + 1  # Spark's bitmaps count from 1
    rows = nodes.select(spot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m"))
    size = 4096 * 8
    bits = np.zeros(BITS // 8, np.uint8)
    for b, m in rows.collect():
        bits[(b - 1) * size // 8 : b * size // 8] = np.frombuffer(bytes(m), np.uint8)
    return bits


def prefixes(freq: np.ndarray, num: int, den: int, width: int):
    """Emit (doc_id, n, match, tokens): each set's prefix in the global order, as long as its match asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                sets = shingle_sets(part.column(1).to_pylist(), width)
                ns, ms, out = [], [], []
                for s in sets:
                    n = len(s)
                    if not n:
                        ns.append(0), ms.append(0), out.append([])
                        continue
                    df = freq[_cell(s)]
                    common = np.log2(df + 1.0).astype(np.int64)
                    order = np.lexsort((s, common))
                    need = -(-num * n // den)
                    most = min(MOST_MATCHES, need)
                    others = np.cumsum(df[order], dtype=np.int64)
                    m = np.arange(1, most + 1)
                    length = n - need + m
                    cost = length + others[length - 1] * (0.2 + 4.0 / m)
                    match = int(m[int(cost.argmin())])
                    ns.append(n), ms.append(match), out.append(_signed(s[order[: n - need + match]]).tolist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ns, pa.int64()), pa.array(ms, pa.int32()), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "n", "match", "tokens"]
                )

    return run


def _sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, s) for the nodes: their sets, worked out anew from the texts."""
    # Rows hash their ids in the JVM so that both sides agree.
    bits = _wanted(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits[spot >> 3] >> (spot & 7)) & 1 == 1))
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                sets = [_signed(s) for s in shingle_sets(part.column(1).to_pylist(), width)]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = pa.array(np.concatenate(sets), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], ["node", "s"])

    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(BITS)).alias("spot"))
    return rows.mapInArrow(run, "node long, s array<long>").where(F.size("s") > 0)


def verify(docs: DataFrame, pairs: DataFrame, num: int, den: int, width: int) -> DataFrame:
    """Those of the pairs (u, v) that are linked, by their whole sets. The pairs do not repeat."""
    sets = _sets(docs, pairs.select(F.explode(F.array("u", "v")).alias("node")), width)  # the same plan for both sides, so that one pass and one shuffle serve both
    side = lambda c: sets.select(F.col("node").alias(c), F.col("s").alias("s" + c))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    common = F.size(F.array_intersect("su", "sv"))
    checked = both.select("u", "v", common.alias("c"), (F.size("su") + F.size("sv")).alias("t"))
    return checked.where(F.col("c") * den >= (F.col("t") - F.col("c")) * num).select("u", "v").distinct()


def _hub_pairs(classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of a node and a hub that share two bottom-k values (or all they have)."""
    keyed = classes.select("node", "n", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min(F.struct("node", "n")).alias("hub"), F.count("*").alias("c")).where("c > 1")
    met = keyed.join(hubs, "key").where(F.col("node") != F.col("hub.node"))
    near = (F.least("n", "hub.n") * den >= F.greatest("n", "hub.n") * num) & ((F.col("c") >= 2) | (F.col("n") <= KEYS))
    by_pair = met.groupBy("node", F.col("hub").alias("hub")).agg(F.count("*").alias("c"), F.first("n").alias("n")).where(near)
    best = by_pair.groupBy("node").agg(F.max(F.struct("c", -F.col("hub.node"))).alias("b"))
    return best.select(F.col("node").alias("u"), (-F.col("b.col2")).alias("v"))


def links_and_classes(docs: DataFrame, num: int = 75, den: int = 100, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """The profile of each row, and (node, label) of every class that is linked to another."""
    docs = pick(docs, doc_id="long", text="string")
    schema = "doc_id long, n long, h1 long, h2 long, keys array<long>, segment int, cells binary"
    both = settle(docs.mapInArrow(_profile(width), schema), "profile")
    rows = both.where("segment IS NULL").drop("segment", "cells")
    freq = _frequencies(both)
    classes = settle(rows.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys")).where("node IS NOT NULL"), "classes")
    # Rows that share a doc_id are one document.
    same = rows.where("n > 0 AND doc_id IS NOT NULL").join(classes.select("n", "h1", "h2", "node"), ["n", "h1", "h2"])
    same = same.where("doc_id <> node").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    own = classes.select("node").groupBy("node").count()
    joined = same.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    joined = joined.union(same.join(own, same["doc_id"] == own["node"]).select(F.col("doc_id").alias("u"), F.col("a").alias("v")))

    found = settle(_hub_pairs(classes, num, den), "hub-pairs")
    hub_links = settle(verify(docs, found, num, den, width).union(joined), "links")
    label = components(hub_links)
    release(found, hub_links)
    tidy(docs.sparkSession)

    known = classes.select("node").distinct().join(label, "node", "left").select("node", F.coalesce("label", "node").alias("cluster"))
    heads = docs.where("doc_id IS NOT NULL").mapInArrow(prefixes(freq, num, den, width), "doc_id long, n long, match int, tokens array<long>").where("n > 0")
    heads = settle(heads.join(known, heads["doc_id"] == known["node"]).drop("doc_id"), "prefixes")
    # A pair's first shared shingle is in the prefix of match 1; the longer prefixes only count.
    first = F.slice("tokens", F.lit(1), F.size("tokens") - F.col("match") + 1)
    tokens = heads.select("node", "cluster", "n", "match", F.posexplode(first).alias("pos", "token"))
    kept = _mixed(tokens.select("token", "node", "cluster", (F.col("n") * (1 << 32) + F.col("pos") * 16 + F.col("match")).cast("long").alias("meta")))
    release(classes)
    tidy(docs.sparkSession)
    for number in range(STAR_ROUNDS):
        if kept.isEmpty():
            break
        stars = settle(_star_pairs(kept, number, num, den), "star-pairs")
        more = settle(verify(docs, stars, num, den, width), "star-links")
        release(stars)
        if more.isEmpty():
            release(more)
            break
        old, label = label, joined_components(label, more)
        before, kept = kept, _mixed(settle(_relabelled(kept, label), "relabelled"), release_it=True)
        release(old, more, before)
        tidy(docs.sparkSession)
    met = settle(_cross_pairs(kept, num, den), "met")
    release(kept)
    pairs = _matched(met, heads, num, den)
    release(met, heads)
    tidy(docs.sparkSession)
    return rows, _resolve(docs, pairs, label, num, den, width)


def _mixed(tokens: DataFrame, release_it: bool = False) -> DataFrame:
    """The rows of shingles that more than one cluster holds.

    The shingles are found first, by partial aggregates: those that a large
    group holds alone never meet in one task, and their rows meet no partner.
    """
    mixed = tokens.groupBy("token").agg(F.min("cluster").alias("a"), F.max("cluster").alias("b")).where("a <> b").select("token")
    mixed = settle(mixed, "mixed")  # its shuffle goes before the next begins
    out = settle(tokens.join(mixed, "token"), "tokens")
    release(mixed, *([tokens] if release_it else []))
    return out


def _relabelled(kept: DataFrame, label: DataFrame) -> DataFrame:
    """The rows under the clusters of now."""
    return kept.join(label, "node", "left").select("token", "node", F.coalesce("label", "cluster").alias("cluster"), "meta")


def _parts(side: str) -> list:
    """Size, place in the order, and match of a row, named for one side of a pair."""
    size, rest = F.shiftright("meta", 32), F.col("meta").bitwiseAND(F.lit((1 << 32) - 1))
    return [F.col("node").alias(side), size.alias("n" + side), F.shiftright(rest, 4).alias("p" + side), rest.bitwiseAND(F.lit(15)).alias("m" + side)]


def _need(num: int, den: int):
    """Shingles that sets of the two sizes share if they are linked."""
    return F.ceil((F.col("nu") + F.col("nv")) * num / (num + den))


def _meets(num: int, den: int):
    """Whether a shared shingle may be the first that linked sets of the two sizes share.

    Linked sets share ``need`` shingles; ``need - 1`` of them come after the
    first in both orders, so that it comes before ``n - need + 1`` in both.
    """
    need = _need(num, den)
    sizes = F.least("nu", "nv") * den >= F.greatest("nu", "nv") * num
    return sizes & (F.col("pu") <= F.col("nu") - need) & (F.col("pv") <= F.col("nv") - need)


def _star_pairs(kept: DataFrame, number: int, num: int, den: int) -> DataFrame:
    """For each cluster at a shingle one member, paired with the member of the shingle's hub cluster.

    These pairs grow with the rows, not with their squares. Each round draws
    other members and hubs; of a cluster's pairs the one that meets most often is kept.
    """
    drawn = F.struct(F.xxhash64("node", F.lit(number)).alias("h"), "node", "meta")
    members = kept.groupBy("token", "cluster").agg(F.min(drawn).alias("m"))
    hubs = members.groupBy("token").agg(F.min(F.struct(F.xxhash64("cluster", F.lit(number)).alias("h"), "cluster", "m")).alias("hub"))
    met = members.join(hubs, "token").where(F.col("cluster") != F.col("hub.cluster"))
    met = met.select("cluster", F.col("hub.m").alias("o"), F.col("m.node").alias("node"), F.col("m.meta").alias("meta")).select("cluster", "o", *_parts("u"))
    met = met.select("cluster", "u", "nu", "pu", "mu", F.col("o.node").alias("node"), F.col("o.meta").alias("meta")).select("cluster", "u", "nu", "pu", "mu", *_parts("v"))
    counted = met.where(_meets(num, den)).groupBy("u", "v", "cluster").agg(F.count("*").alias("c"))
    best = counted.groupBy("cluster").agg(F.max(F.struct("c", "u", "v")).alias("b"))
    return best.select("b.u", "b.v")


def _cross_pairs(kept: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of nodes of different clusters that share a shingle where linked sets share their first.

    The smaller set of a pair (the lesser node of equals) comes by the shorter
    prefix that a partner of its size or more asks for, so that shingles common
    to a large group meet only from the few sets that hold them so early.
    """
    least = F.ceil(F.col("nu") * (2 * num) / (num + den))
    early = kept.select("token", F.col("cluster").alias("ca"), *_parts("u")).where(F.col("pu") <= F.col("nu") - least)
    every = kept.select("token", F.col("cluster").alias("cb"), *_parts("v"))
    order = (F.col("nu") < F.col("nv")) | ((F.col("nu") == F.col("nv")) & (F.col("u") < F.col("v")))
    met = early.join(every, "token").where(order & (F.col("ca") != F.col("cb")) & _meets(num, den))
    return met.select("u", "v", F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).distinct()


def _matched(met: DataFrame, heads: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs that share the smaller match of the two, each within its prefix of that match.

    Linked sets share m of the shingles that come before ``n - need + m`` in
    both, for any m.
    """
    side = lambda c: heads.select(F.col("node").alias(c), F.col("n").alias("n" + c), F.col("match").alias("m" + c), F.col("tokens").alias("t" + c))
    ends = met.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    heads = settle(heads.join(ends, "node"), "met-prefixes")  # few of all
    both = met.join(side("u"), "u").join(side("v"), "v").withColumn("match", F.least("mu", "mv").cast("long"))
    part = lambda c: F.slice("t" + c, F.lit(1), F.greatest(F.lit(0), F.col("n" + c) - F.col("need") + F.col("match")).cast("int"))
    both = both.withColumn("need", _need(num, den))
    found = both.select("u", "v", "ca", "cb", "match", F.size(F.array_intersect(part("u"), part("v"))).alias("shared")).where("shared >= match")
    out = settle(found.groupBy("u", "v", "ca", "cb").agg(F.max("shared").alias("shared")), "pairs")
    release(heads)
    return out


def _resolve(docs: DataFrame, pairs: DataFrame, label: DataFrame, num: int, den: int, width: int) -> DataFrame:
    """Components after verifying pairs across clusters: the likeliest of each two clusters, then all still apart."""
    if pairs.isEmpty():
        return label
    first = pairs.groupBy("ca", "cb").agg(F.max(F.struct("shared", "u", "v")).alias("b")).select("b.u", "b.v")
    first = settle(first, "first")
    links = settle(verify(docs, first, num, den, width), "links")
    label = joined_components(label, links)
    ends = lambda s: label.select(F.col("node").alias(s), F.col("label").alias("l" + s))
    rest = pairs.join(first, ["u", "v"], "left_anti").join(ends("u"), "u", "left").join(ends("v"), "v", "left")
    rest = settle(rest.where(F.coalesce("lu", "u") != F.coalesce("lv", "v")).select("u", "v"), "rest")
    release(pairs, first, links)
    if not rest.isEmpty():
        links = settle(verify(docs, rest, num, den, width), "links")
        label = joined_components(label, links)
        release(links)
    release(rest)
    return label


def join_components(docs: DataFrame, num: int = 75, den: int = 100, width: int = 5) -> DataFrame:
    """Every row's doc_id, shingle count and component: the least doc_id reachable by links."""
    rows, label = links_and_classes(docs, num, den, width)
    classes = rows.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("node"))
    classes = classes.join(label, "node", "left").select("n", "h1", "h2", F.coalesce("label", "node").alias("component_id"))
    out = rows.select("doc_id", "n", "h1", "h2").join(classes, ["n", "h1", "h2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
