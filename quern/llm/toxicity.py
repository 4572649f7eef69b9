"""Toxicity scores: gradient-boosted trees over dense features, isotonically calibrated.

Features of a text: densities of a lexicon, how close second persons stand to
its words, capitals, punctuation, marks and obfuscated words. The lexicon is a
short fixed list and the word beginnings that labelled rows tie to toxicity
beyond chance (a likelihood ratio test, corrected for the number of beginnings
tried). Lexicon, trees and calibration are learned from a bounded sample of
labelled rows (``sample_rows``, lowest hash of the id first); the scores cover
every row and the whole of its text.

Defined cases: null and empty texts have zero features and get the score of
such; repeated rows get equal scores; without labels of both kinds the score is
the share of toxic labels (0 without any); an empty table gives no rows; extra
columns are ignored. Labels, lang, source and doc_id are no features.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import pick, settle

#: Insults known beforehand, as beginnings of words.
INSULTS = (
    "idiot", "moron", "stupid", "imbecil", "loser", "scum", "trash", "garbage", "pathetic", "worthless",
    "disgust", "clown", "dumb", "jerk", "vermin", "hate you", "shut up",
    "arschloch", "blödmann", "dummkopf", "widerlich", "abschaum",
    "connard", "crétin", "ordure", "salaud",
    "estúpid", "basura", "gilipollas", "asqueros",
)
#: Words of the second person.
SECOND = frozenset("you your yours yourself du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre tú ti usted ustedes".split())
#: Characters that stand for letters.
LEET = str.maketrans("013457@$!|", "oieastasii")

BEGIN, END = 4, 8  # lengths of the word beginnings tried
_WORD = re.compile(r"[^\W\d_]+")
_HIDDEN = re.compile(r"[^\W\d_]+(?:[0-9@$!|*.\-_]+[^\W\d_]+)+")
_INNER = re.compile(r"[*.\-_]")
FEATURES = (
    "hits_per_100", "log_hits", "distinct_hits", "fixed_per_100", "near_second", "near_share", "hidden_hits", "hidden_per_100",
    "capitals", "exclaim", "question", "marks", "digits", "log_words", "densest",
)


def beginnings(text: str) -> set[str]:
    """The distinct beginnings of a text's words."""
    out: set[str] = set()
    for word in set(_WORD.findall(text.lower())):
        out.update(word[:k] for k in range(BEGIN, min(END, len(word)) + 1))
    return out


def count_beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(beginning, documents, toxic documents) of one partition of (text, toxic)."""
    seen: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for w in beginnings(text or ""):
                at = seen.setdefault(w, [0, 0])
                at[0] += 1
                at[1] += toxic
    names = ["w", "n", "k"]
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *[pa.array([v[i] for v in seen.values()], pa.int64()) for i in (0, 1)]], names)


def learn_lexicon(sample: DataFrame, entries: int = 400) -> list[str]:
    """Word beginnings tied to toxicity; at most ``entries``, the surest first."""
    total = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).first()
    n, k = total["n"], total["k"] or 0
    if not 0 < k < n:
        return []
    counts = sample.select("text", "toxic").mapInArrow(count_beginnings, "w string, n long, k long")
    counts = counts.groupBy("w").agg(F.sum("n").cast("double").alias("n"), F.sum("k").cast("double").alias("k"))
    tried = counts.where("n >= 2")
    part = lambda x, e: F.when(x > 0, x * F.ln(x / e)).otherwise(F.lit(0.0))
    a, b = F.col("k"), F.col("n") - F.col("k")
    c, d = F.lit(float(k)) - a, F.lit(float(n - k)) - b
    rate = k / n
    g = 2 * (part(a, F.col("n") * rate) + part(b, F.col("n") * (1 - rate)) + part(c, (n - F.col("n")) * rate) + part(d, (n - F.col("n")) * (1 - rate)))
    tests = max(2, tried.count())
    rows = tried.select("w", "n", "k", g.alias("g")).where((F.col("g") > 2 * np.log(tests) + 6) & (a / F.col("n") > 0.5 + rate / 2))
    best = [r["w"] for r in rows.orderBy(F.desc("g"), F.length("w"), "w").limit(entries * 4).collect()]
    kept: list[str] = []
    for w in best:  # a beginning of, or begun by, a surer one adds little
        if not any(w.startswith(x) or x.startswith(w) for x in kept):
            kept.append(w)
    return kept[:entries]


class Features:
    """Dense features of texts for one lexicon."""

    def __init__(self, lexicon: list[str]):
        self.automaton = ahocorasick.Automaton()
        for w in sorted({*INSULTS, *lexicon}):
            self.automaton.add_word(w, (w, w in INSULTS))
        self.automaton.make_automaton()
        kinds = np.zeros((256, 7))
        kinds[[9, 10, 11, 12, 13, 32], 0] = 1
        kinds[65:91, 1] = 1
        kinds[ord("!"), 2] = kinds[ord("?"), 3] = 1
        kinds[[ord(c) for c in "#$%&*@^~|<>{}[]\\/+=_"], 4] = 1
        kinds[48:58, 5] = 1
        kinds[[b for b in range(256) if not 128 <= b < 192], 6] = 1  # characters
        self.kinds = kinds

    def found(self, low: str) -> list[tuple[int, str, bool]]:
        out = []
        for end, (w, fixed) in self.automaton.iter(low):
            start = end - len(w) + 1
            if not start or not low[start - 1].isalpha():
                out.append((start, w, fixed))
        return out

    def row(self, text: str) -> list[float]:
        raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
        blanks, caps, exclaim, question, marks, digits, chars = np.bincount(raw, minlength=256) @ self.kinds
        words, chars = blanks + 1.0, max(chars, 1.0)
        low = text.lower()
        hits = self.found(low)
        hidden = list(_HIDDEN.finditer(low))
        plain = " ".join(_INNER.sub("", m.group()).translate(LEET) for m in hidden)
        secret = len(self.found(plain)) if plain else 0
        places = sorted({h[0] for h in hits})
        near = sum(any(w in SECOND for w in _WORD.findall(low[max(0, p - 40) : p + 60])) for p in places)
        densest = 0
        lo = 0
        for hi, p in enumerate(places):
            while p - places[lo] > 300:
                lo += 1
            densest = max(densest, hi - lo + 1)
        n = len(places) + secret
        return [
            100 * n / words, np.log1p(n), float(len({h[1] for h in hits})), 100 * sum(h[2] for h in hits) / words, float(near), near / max(n, 1), float(secret),
            100 * len(hidden) / words, caps / chars, exclaim / chars, question / chars, marks / chars, digits / chars, np.log(words), float(densest),
        ]

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.row(t or "") for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


class Boosted:
    """Boosted trees of depth 3 with logistic loss on quantile bins."""

    def __init__(self, rounds: int = 80, rate: float = 0.15, depth: int = 3, bins: int = 32, least: float = 4.0):
        self.rounds, self.rate, self.depth, self.bins, self.least = rounds, rate, depth, bins, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = self._bin(x)
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, y - p, p * (1 - p))
            self.trees.append(tree)
            margin += self._walk(tree, binned)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], 1)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = 2 ** (self.depth + 1) - 1
        column, cut, value = np.full(size, -1), np.zeros(size, dtype=np.int64), np.zeros(size)
        node = np.zeros(len(g), dtype=np.int64)
        for k in range(size):
            own = node == k
            if not own.any():
                continue
            gs, hs = g[own].sum(), h[own].sum()
            value[k] = self.rate * gs / (hs + 1.0)
            if k >= size // 2:
                continue
            best, where = 1e-6, None
            for j in range(b.shape[1]):
                gl = np.cumsum(np.bincount(b[own, j], g[own], self.bins + 1))[:-1]
                hl = np.cumsum(np.bincount(b[own, j], h[own], self.bins + 1))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(hl < self.least * 0.1) | (hs - hl < self.least * 0.1)] = 0
                i = int(gain.argmax())
                if gain[i] > best:
                    best, where = gain[i], (j, i)
            if where:
                column[k], cut[k] = where
                node[own] = np.where(b[own, where[0]] <= where[1], 2 * k + 1, 2 * k + 2)
        return column, cut, value

    @staticmethod
    def _walk(tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        column, cut, value = tree
        node, at = np.zeros(len(b), dtype=np.int64), np.arange(len(b))
        while True:
            inner = column[node] >= 0
            if not inner.any():
                return value[node]
            down = np.where(b[at, np.maximum(column[node], 0)] <= cut[node], 2 * node + 1, 2 * node + 2)
            node = np.where(inner, down, node)

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        b = self._bin(x)
        return self.base + sum((self._walk(t, b) for t in self.trees), np.zeros(len(x)))


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled neighbours: rising knots (margin, share of toxic), each level smoothed by half a case of either kind."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum, count, sum of margins
    for m, v in zip(margin[order], y[order], strict=True):
        blocks.append([v, 1.0, m])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    level = np.maximum.accumulate([(s + 0.5 * y.mean()) / (n + 0.5) for s, n, _ in blocks])
    return np.array([t / n for _, n, t in blocks]), level


class Model:
    """Lexicon, trees and calibration."""

    def __init__(self, lexicon: list[str], x: np.ndarray, y: np.ndarray, folds: int = 4):
        self.lexicon = lexicon
        self.share = float(y.mean()) if len(y) else 0.0
        self.trees = None
        if len(y) and 0 < y.sum() < len(y):
            self.trees = Boosted().fit(x, y)
            fold = np.arange(len(y)) % folds
            held = np.zeros(len(y))
            for f in range(folds):
                rest = fold != f
                held[~rest] = Boosted().fit(x[rest], y[rest]).margin(x[~rest]) if 0 < y[rest].sum() < rest.sum() else self.trees.margin(x[~rest])
            self.knots, self.levels = isotonic(held, y)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        return np.clip(np.interp(self.trees.margin(x), self.knots, self.levels), 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 9_000) -> Model:
    """Learn from labelled rows whose crc32(doc_id as text) mod 3 is not 1; of rows that share a doc_id one stands for all."""
    known = pick(labels, doc_id="long", toxic="int").where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = pick(docs, doc_id="long", text="string").join(F.broadcast(known), "doc_id")  # at most sample_rows ids
    sample = settle(texts.select("doc_id", "text", "toxic"), "toxic-sample")
    lexicon = learn_lexicon(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Features(lexicon)
        for b in batches:
            x = own.matrix(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    rows = sample.mapInArrow(run, "doc_id long, toxic int, x array<double>").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("x").alias("x")).toPandas().sort_values("doc_id", kind="stable")
    rows = rows.iloc[np.argsort(pd.util.hash_array(rows["doc_id"].to_numpy(np.int64)), kind="stable")]
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return Model(lexicon, x, rows["toxic"].to_numpy(np.float64))


def scores(docs: DataFrame, model: Model, rows: int = 1000) -> DataFrame:
    """The score of every document: (doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Features(model.lexicon)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                s = model.score(own.matrix(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_rows: int = 9_000) -> DataFrame:
    """Every document with its held-out mark, score and verdict."""
    out = scores(docs, train(docs, labels, sample_rows))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_rows: int = 9_000, rows: int = 1000) -> DataFrame:
    """The documents that are not rejected, with their columns, in one pass over the texts."""
    model = train(docs, labels, sample_rows)
    names = [c for c in docs.columns if c == "text"] or [c for c in docs.columns if c.lower() == "text"]
    if not names:
        raise ValueError("documents need a text")
    at_text = docs.columns.index(names[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Features(model.lexicon)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield part.filter(pa.array(model.score(own.matrix(part.column(at_text).to_pylist())) < threshold))

    return docs.mapInArrow(run, docs.schema)
