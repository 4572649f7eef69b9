"""The whole pipeline on sf0.001; each stage is held against its own input."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
from quern.llm import source_mix, toxicity
from quern.llm.base import WORD

SF = "/root/testdata/sf0.001"


def least_of_groups(rows):
    """The least doc_id of each component, by comparing every two documents."""
    sets = {}
    for i, text in rows:
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    near = {i: {j for j in sets if i != j and (c := len(sets[i] & sets[j])) and 100 * c >= 75 * len(sets[i] | sets[j])} for i in sets}
    out, left = set(), set(sets)
    while left:
        out.add(min(left))
        group, todo = set(), {min(left)}
        while todo:
            group |= todo
            todo = set().union(*(near[i] for i in todo)) - group
        left -= group
    return out


def test_stages(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    settle, written = corpus_pipeline.settle, []
    monkeypatch.setattr(corpus_pipeline, "settle", lambda df, label: written.append((label, settle(df, label))) or written[-1][1])
    monkeypatch.setattr(corpus_pipeline, "release", lambda *_: None)
    last = corpus_pipeline.run(spark, SF)
    found = {label.removeprefix("pipeline-"): df for label, df in written if label.startswith("pipeline-")}
    kept = {"documents": docs, **found, "byte_bpe": last}
    assert list(kept) == ["documents", *(name for name, _ in corpus_pipeline.STAGES)]
    assert all(df.columns == docs.columns for df in found.values())
    ids = {n: [r[0] for r in d.select("doc_id").collect()] for n, d in kept.items()}
    toxic = {r[0] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").select("doc_id").collect()}
    gone = set(ids["documents"]) - set(ids["toxicity"])
    labelled = {r[0] for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id").collect()}
    assert gone & labelled <= toxic and len(gone) < len(ids["documents"]) / 4
    assert set(ids["jaccard_join"]) < set(ids["toxicity"]) and sorted(ids["secret_forest"]) == sorted(ids["jaccard_join"])
    verdicts = toxicity.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert sorted(ids["toxicity"]) == sorted(r["doc_id"] for r in verdicts if not r["predicted"])
    assert sorted(ids["jaccard_join"]) == sorted(least_of_groups(kept["toxicity"].select("doc_id", "text").collect()))
    assert Counter(ids["source_mix"]) == Counter({r["doc_id"]: r["times"] for r in source_mix.mix(kept["secret_forest"]).collect() if r["times"]})
    texts = {r["doc_id"]: r["text"] for r in kept["secret_forest"].collect()}
    assert not any(re.search(r"AKIA[A-Z0-9]{16}|password=[0-9a-f]{18}", t) for t in texts.values())
    assert all(ids["source_mix"].count(i) <= 2 for i in set(ids["source_mix"])) and sorted(ids["byte_bpe"]) == sorted(ids["source_mix"])
    for r in kept["byte_bpe"].collect():
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (2, text + " x"), (3, "other words entirely"), (None, text), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "DOC_ID long, text string")
    out = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert out.columns == docs.columns and sorted((r[0] or 0) for r in out.collect()) == [0, 1, 3, 4, 5]
    assert corpus_pipeline.drop_near_copies(spark, docs.where("false"), SF).count() == 0
