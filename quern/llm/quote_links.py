"""Quotation linking: quoted passages of messages joined to the messages that said them.

Lines that begin with ``>`` are quoted, as deep as there are ``>``. Runs of lines
of one depth are passages. A passage and its paragraphs are normalised (letters
and digits only, lower case) and hashed; a message's own lines, paragraphs and
whole are hashed alike. A quoted passage is linked to the earliest message that
has its hash among its own: an earlier turn of the conversation first, then any
conversation. Of quotes of one depth from other conversations a short passage
gives way to longer ones. A message replies to the message of its shallowest linked quote in
the conversation, the latest of equals, or else to the turn before it.

Conversations are built without quotes, in an order in which every message comes
after the one it replies to: by turn.

Defined cases: null and empty texts have no own text and no quotes; quotes
without a source count as unlinked; rows that repeat a turn each get a position,
ordered by role and text; null conv_id is a conversation of its own, a null turn
comes last in it; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import pick, settle

_MARK = re.compile(r"^\s*((?:>\s?)+)")
_PLAIN = re.compile(r"[\W_]+")
_BLANK = re.compile(r"\s+")
#: Shorter passages (in letters and digits) are short.
SHORT = 12


def normal(text: str) -> str:
    """Letters and digits in lower case; of a text without any, all that is not blank."""
    return _PLAIN.sub("", text.lower()) or _BLANK.sub("", text)


def normal_hash(text: str) -> int | None:
    """64 bits of the normalised text; None if it is empty."""
    plain = normal(text)
    return int.from_bytes(blake2b(plain.encode(), digest_size=8).digest(), "little", signed=True) if plain else None


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The text without its quotes, and the quoted passages as (depth, passage)."""
    own: list[str] = []
    quotes: list[tuple[int, list[str]]] = []
    last = 0
    for line in (text or "").split("\n"):
        mark = _MARK.match(line)
        depth = mark.group(1).count(">") if mark else 0
        body = line[mark.end() :] if mark else line
        if not depth:
            own.append(body)
        elif depth == last:
            quotes[-1][1].append(body)
        else:
            quotes.append((depth, [body]))
        last = depth
    return "\n".join(own).strip("\n") if quotes else (text or ""), [(d, "\n".join(b)) for d, b in quotes]


def passages(text: str) -> set[str]:
    """What of a text may be quoted: all of it, its paragraphs and its lines."""
    return {text, *re.split(r"\n\s*\n", text), *text.split("\n")}


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own, said, quoted = [], [], []
        for text in b.column(3).to_pylist():
            mine, quotes = parse(text)
            own.append(mine)
            said.append(sorted({h for p in passages(mine) if (h := normal_hash(p)) is not None}))
            hashed = {(d, h, len(normal(x)) < SHORT) for d, p in quotes for x in passages(p) if (h := normal_hash(x)) is not None}
            quoted.append([{"depth": d, "hash": h, "short": s} for d, h, s in sorted(hashed)])
        kind = pa.list_(pa.struct([("depth", pa.int32()), ("hash", pa.int64()), ("short", pa.bool_())]))
        yield pa.RecordBatch.from_arrays(
            [*[b.column(i) for i in range(3)], pa.array(own, pa.string()), pa.array(said, pa.list_(pa.int64())), pa.array(quoted, kind)],
            ["conv_id", "turn", "role", "text", "said", "quoted"],
        )


def parsed(conversations: DataFrame) -> DataFrame:
    """Each message with its own text, the hashes that it says, and those that it quotes."""
    rows = pick(conversations, conv_id="long", turn="long", role="string", text="string")
    return rows.mapInArrow(_parse, "conv_id long, turn long, role string, text string, said array<long>, quoted array<struct<depth:int,hash:long,short:boolean>>")


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, depth, hash, short, from_conv, from_turn): every quoted hash with its source, or null.

    What is said is pre-aggregated to the earliest message by hash and
    conversation, and to the two least conversations by hash (one may be the
    quoting one), so a line that everybody says is no hot key.
    """
    said = messages.where("turn IS NOT NULL").select("conv_id", "turn", F.explode("said").alias("hash"))
    quotes = messages.select("conv_id", "turn", F.inline("quoted")).distinct()
    here = said.groupBy("hash", "conv_id").agg(F.min("turn").alias("here"))
    place = F.struct("conv_id", F.col("here").alias("turn"))
    nth = here.withColumn("nth", F.row_number().over(Window.partitionBy("hash").orderBy("conv_id"))).where("nth <= 2")
    first = nth.groupBy("hash").agg(F.min(F.when(F.col("nth") == 1, place)).alias("first"), F.min(F.when(F.col("nth") == 2, place)).alias("second"))
    own = here.select(F.col("hash").alias("h"), F.col("conv_id").alias("c"), "here")
    q = quotes.join(own, (quotes["hash"] == own["h"]) & quotes["conv_id"].eqNullSafe(own["c"]) & (own["here"] < F.coalesce(quotes["turn"], F.lit(2**62))), "left")
    q = q.drop("h", "c").join(first, "hash", "left")
    elsewhere = F.when(~F.col("first.conv_id").eqNullSafe(F.col("conv_id")), F.col("first")).otherwise(F.col("second"))
    return q.select(
        "conv_id", "turn", "depth", "hash", "short", F.when(F.col("here").isNotNull(), F.col("conv_id")).otherwise(elsewhere["conv_id"]).alias("from_conv"),
        F.coalesce(F.col("here"), elsewhere["turn"]).alias("from_turn"),
    )


def threads(conversations: DataFrame, turns_per_run: int = 1000) -> DataFrame:
    """Every message in reply order, without quotes: position, what it replies to, and how many of its quotes are linked.

    Positions are counted within runs of turns whose sizes are summed before
    them, so a conversation with most of the messages is spread over tasks.
    """
    m = settle(parsed(conversations), "messages")
    found = links(m)
    local = F.col("from_conv").eqNullSafe(F.col("conv_id")) & F.col("from_turn").isNotNull()
    per = found.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_quotes"), F.count("from_turn").alias("n_linked"), F.max("depth").alias("deepest"),
        F.min(F.when(local, F.struct("depth", (-F.col("from_turn")).alias("t")))).alias("reply"),
        F.min(F.when(~local & F.col("from_turn").isNotNull(), F.struct("depth", "short", "from_conv", "from_turn"))).alias("abroad"),
    )
    per = per.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "n_quotes", "n_linked", "deepest", (-F.col("reply.t")).alias("reply_turn"), F.col("abroad.from_conv").alias("abroad_conv"), F.col("abroad.from_turn").alias("abroad_turn"))
    rows = m.select("conv_id", "turn", "role", "text").withColumn("run", F.floor(F.coalesce("turn", F.lit(2**62)) / turns_per_run))
    runs = rows.groupBy("conv_id", "run").agg(F.count("*").alias("n"), F.max("turn").alias("last"))
    past = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("conv_id").alias("rc"), F.col("run").alias("rr"), F.coalesce(F.sum("n").over(past), F.lit(0)).alias("start"), F.max("last").over(past).alias("before"))
    inside = Window.partitionBy("conv_id", "run").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    earlier = Window.partitionBy("conv_id", "run").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("nth", F.row_number().over(inside)).withColumn("prior", F.max("turn").over(earlier))
    rows = rows.join(runs, F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("run") == F.col("rr")))
    rows = rows.join(per, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")), "left")
    return rows.select(
        "conv_id", "turn", "role", (F.col("start") + F.col("nth") - 1).cast("long").alias("position"),
        F.coalesce("reply_turn", "prior", "before").alias("reply_turn"), F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.coalesce("deepest", F.lit(0)).alias("deepest"), "abroad_conv", "abroad_turn", "text",
    )
