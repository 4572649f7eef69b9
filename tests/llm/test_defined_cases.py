"""The defined cases of every operator and stage: empty tables, nulls everywhere, repeated rows, very long texts, ties, clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import byte_bpe, hash_index, iblt, jaccard_join, quote_links, secret_forest, shard_tree, source_mix, toxicity, url_reputation
from quern.llm.base import WORD

SF = "/root/testdata/sf0.001"
#: Columns of tables within the operators, of other types here.
CLASH = "node string, token string, n string, segment string, uid string, chunk string, draw string, bin string, shard string, run string, cluster string, times string, f string"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
LONG = "\n".join(f"Sentence {k} of a very long text, with words enough to count. " * 3 for k in range(1500))
TEXTS = [
    (None, None, None), (None, None, None), (None, "nobody owns this text at all", "a"), (None, "nobody owns this text at all", None), (1, None, "a"), (1, "said twice, once unlike", "a"),
    (2, "", "a"), (2, "", "a"), (3, "   \n\t ", None), (4, LONG, "b"), (5, LONG, "b"), (5, LONG, "b"), (6, LONG + " and an end of its own", "c"), (7, "\x00 odd � é\U0001f600", ""), (8, "one", "c"),
    (-9, "password=hunter2!x and no more", "a"), (2**62, "the last of all the ids is here", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, s, None if t is None else len(t), *["x"] * len(CLASH.split(","))) for i, t, s in TEXTS]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, int(i % 5 == 0)) for i in range(-9, 9)] + [(None, 1, 1), (3, None, None), (4, 0, 1), (4, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def operators(labels, forest):
    return {
        "mix": source_mix.mix, "iblt": iblt.fingerprints, "toxicity": lambda d: toxicity.judge(d, labels), "bpe": byte_bpe.encode_documents,
        "shards": shard_tree.shard_documents, "join": jaccard_join.join_components, "secrets": lambda d: secret_forest.scan(d, forest),
    }


def test_empty_tables(spark, docs, labels):
    empty = docs.where("doc_id = 12345")
    forest = secret_forest.train(spark)
    for name, run in operators(labels, forest).items():
        assert run(empty).count() == 0, name
    assert toxicity.judge(docs, labels.where("false")).count() == len(TEXTS)
    talks = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert quote_links.threads(talks).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_reputation.judge(pages, url_reputation.outcomes_from_labels(labels)).count() == 0
    assert not toxicity.keep_clean(empty, labels).count() + source_mix.apply_mix(empty).count() + secret_forest.redact(empty, forest).count()


def test_tokens(docs):
    got = Counter((r["doc_id"], r["decoded_sha256"]) for r in byte_bpe.encode_documents(docs).collect())
    assert got == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in TEXTS)


def near_order():
    """The texts by doc_id, null last, then by text; null counts as empty."""
    return sorted(((i is None, i or 0, t or "") for i, t, _ in TEXTS), key=lambda r: (r[0], r[1], r[2].encode()))


def test_fingerprints(docs):
    def pieces(t):
        return {p for x in t.split("\n") if x for p in (re.split(r"(?<=[.!?]) ", x) if len(x) > iblt.LONG else [x])}

    def near(a, b):
        d, n = len(pieces(a) ^ pieces(b)), len(pieces(a)) + len(pieces(b))
        return round((n - d) / (n + d), 9) if n else 1.0

    order, want = near_order(), []
    for k, (none, i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][2]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        want.append((none, i, len(t), hashlib.sha256(edited.encode()).hexdigest(), near(t, edited), near(t, after)))
    got = [(r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in iblt.fingerprints(docs).collect()]
    assert sorted(got) == sorted(want)


def test_shard_slots(docs):
    got = shard_tree.shard_documents(docs).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in TEXTS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    for shard in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in got)


def test_join_classes(docs):
    got = jaccard_join.join_components(docs).collect()
    sizes = Counter()
    for i, t, _ in TEXTS:
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sizes[i, len({tuple(w[k : k + 5]) for k in range(len(w) - 4)}) if len(w) >= 5 else min(len(w), 1)] += 1
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == sizes
    assert {r["component_id"] for r in got if r["doc_id"] in (4, 5, 6)} == {4}
    assert all(r["component_id"] == r["doc_id"] for r in got if r["doc_id"] not in (4, 5, 6))


def test_mix_of_odd_rows(docs):
    got = source_mix.mix(docs).collect()
    size = lambda t: len(re.findall(WORD, t or ""))
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((i, s, size(t)) for i, t, s in TEXTS)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert {r["source_size"] for r in own} == {sum(r["size"] for r in own)} and own[0]["target"] <= 2 * own[0]["source_size"]
    assert Counter(map(tuple, got)) == Counter(map(tuple, source_mix.mix(docs.repartition(3)).collect()))
    taken = Counter((r["doc_id"], r["source"], r["n"]) for r in source_mix.apply_mix(docs).select("doc_id", "source", F.length("text").alias("n")).collect())
    assert all(n is not None for *_, n in taken)
    told = Counter()
    for r in got:
        told[r["doc_id"], r["source"]] += r["times"]
    rows = Counter((i, s, t) for i, t, s in TEXTS)
    once = {(i, s) for (i, s, t), c in rows.items() if c == 1}
    assert all(sum(c for (i, s, _), c in taken.items() if (i, s) == k) == told[k] for k in once)


def test_secrets_of_odd_rows(spark, docs):
    forest = secret_forest.train(spark)
    for r in secret_forest.scan(docs, forest).collect():
        texts = [t for i, t, _ in TEXTS if i == r["doc_id"] and t]
        cut = [t[r["start"] : r["start"] + r["length"]] for t in texts]
        assert r["value_sha256"] in {hashlib.sha256(c.encode()).hexdigest() for c in cut}
    out = secret_forest.redact(docs, forest)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == Counter((i, t.replace("hunter2!x", secret_forest.MASK) if t else t) for i, t, _ in TEXTS)


def test_toxicity_of_odd_rows(docs, labels):
    got = toxicity.judge(docs, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, *_ in TEXTS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 2}) == 1


def test_pages_of_odd_rows(spark):
    rows = [(1, "http://h.org:80/a", "x", 0), (1, "http://h.org:80/a", "x", 0), (None, "http://h.org/", None, 0), (2, None, "x", None), (3, "://", "x", 0), (4, "http://" + "a." * 20_000 + "com/x", "x", 0), (5, "HTTP://U@É.NET/es/?q", None, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, n int")
    outcomes = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "page_id long, bad int")
    got = url_reputation.judge(pages, outcomes).collect()
    seen = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"] if r["rule"] else None) for r in got)
    assert seen == Counter([
        (1, "h.org:80", "/a", None, None), (1, "h.org:80", "/a", None, None), (None, "h.org", "/", None, None), (2, "", "", None, None), (3, "", "", None, None),
        (4, "a." * 20_000 + "com", "/x", "com/", "allow"), (5, "u@É.net", "/es/", "net/es/", "block"),
    ])
    assert {(r["n"], r["n_bad"]) for r in got if r["site"] == "h.org"} == {(2, 2)}


def test_quotes_of_odd_rows(spark):
    said = "what was said at the beginning of it"
    rows = [(1, 0, None, said), (1, 1, "a", f"> {said}\nyes"), (1, 1, "a", f"> {said}\nyes"), (1, None, "a", f"> {said}"), (None, None, None, None), (None, 0, "b", ">" * 3000 + " deep"), (2, 0, "b", "> x\n" * 20_000 + LONG), (2, 5, "b", "")]
    talks = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], "conv_id long, turn long, role string, text string, run string, hash string, depth string")
    got = quote_links.threads(talks).collect()
    assert Counter((r["conv_id"], r["turn"]) for r in got) == Counter((c, t) for c, t, *_ in rows)
    for conv in (1, 2, None):
        assert sorted(r["position"] for r in got if r["conv_id"] == conv) == list(range(sum(c == conv for c, *_ in rows)))
    one = [r for r in got if r["conv_id"] == 1 and r["turn"] == 1]
    assert [(r["reply_turn"], r["n_quotes"], r["n_linked"], r["text"]) for r in one] == [(0, 1, 1, "yes")] * 2
    assert next(r for r in got if (r["conv_id"], r["turn"]) == (None, 0))["deepest"] == 3000 and next(r for r in got if (r["conv_id"], r["turn"]) == (2, 5))["reply_turn"] == 0


def test_vectors_that_repeat(spark):
    rows = [(0, [1.0, 0.0], "x"), (0, [1.0, 0.0], "x"), (3, [1.0, 0.0], "x"), (None, None, None)]
    got = hash_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")).collect()
    assert {(r["query_id"], r["vec_id"], r["score"]) for r in got} == {(0, 3, 1.0)}


def test_stages_on_odd_rows(spark, docs):
    """Stages take nulls, repeats and other names of columns, and keep the columns (of the join's, another test tells)."""
    odd = docs.select([F.col(c).alias(c.upper()) for c in docs.columns])
    for name, stage in corpus_pipeline.STAGES:
        if name != "jaccard_join":
            out = stage(spark, odd, SF)
            assert out.collect(), name
            assert name == "byte_bpe" or out.columns == odd.columns, name
