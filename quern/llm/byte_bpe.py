"""Byte-level BPE encoding and decoding over Arrow batches.

The tokenizers library runs the merges. Texts are cut into chunks at each place
where a blank follows a visible character: no match of the pattern crosses such
a place, so a text's ids are its chunks' ids in order. Each worker keeps the ids
of chunks that it has met last, and passes only others, many at once, to the
library.

Ids decode by the reverse byte table. A token may hold a part of a character, so
decoding yields bytes; ``spans`` tells which characters a token touches.

Defined cases: null and empty texts have no tokens, and decode to no bytes; very
long texts are cut as any other; repeated rows repeat; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import pick

#: Chunks that a worker remembers at most; a slice of rows may need more for its own time. Their memory stays with the
#: worker in later operators, as what lives beside them keeps Python from giving it back.
MEMORY = 200_000


def byte_table() -> list[str]:
    """The visible character that stands for each byte: printable Latin-1 for itself, others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that makes each token: what is left of it when only earlier merges apply."""
    pairs = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) == 1:
            continue
        left = [token[i : i + 1] for i in range(len(token))]
        while len(left) > 2:
            best, at = min((ranks.get(left[i] + left[i + 1], rank), i) for i in range(len(left) - 1))
            if best >= rank:
                break
            left[at : at + 2] = [left[at] + left[at + 1]]
        if len(left) == 2:
            pairs.append((left[0], left[1]))
    return pairs


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, table = load_ranks(path), byte_table()
        shown = lambda b: "".join(table[x] for x in b)
        model = models.BPE(vocab={shown(k): v for k, v in ranks.items()}, merges=[(shown(a), shown(b)) for a, b in merges_of(ranks)])
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        back = {c: b for b, c in enumerate(table)}
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = bytes(back[c] for c in shown(token))
        self.width = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.known: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def spans(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """For each token the characters [start, end) that it touches; tokens that split a character share it."""
        owner = np.repeat(np.arange(len(text)), [len(c.encode("utf-8", "surrogatepass")) for c in text])
        ends = np.cumsum(self.width[ids]) if ids else []
        return [(int(owner[e - self.width[i]]), int(owner[e - 1]) + 1) for i, e in zip(ids, ends, strict=True)]

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The text in pieces, each but the first beginning with a blank after a visible character."""
        first, *rest = text.split(" ")
        out = [first]
        for part in rest:
            if out[-1] and not out[-1][-1].isspace():
                out.append(" " + part)
            else:  # white space goes on: the pattern may match over it
                out[-1] += " " + part
        return out

    def learn(self, new: set[str]) -> None:
        """Encode new chunks in long runs, and cut the ids at the chunks' ends by the tokens' widths."""
        # A run may be cut only where a blank follows a visible character.
        safe = [c for c in new if c[0] == " " and c[1:2] and not c[1].isspace() and not c[-1].isspace()]
        odd = new.difference(safe)
        for at in range(0, len(safe), 2000):
            run = safe[at : at + 2000]
            ids = np.array(self.ids("".join(run)), dtype=np.int64)
            stops = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(c.encode()) for c in run])) + 1
            ids, start = ids.tolist(), 0
            for chunk, stop in zip(run, stops.tolist(), strict=True):
                own = ids[start:stop]
                self.known[chunk], start = (" ".join(map(str, own)), self.decode(own)), stop
        for chunk in odd:
            own = self.ids(chunk) if chunk else []
            self.known[chunk] = (" ".join(map(str, own)), self.decode(own))

    def remember(self, need: set[str]) -> None:
        """Have the ids of all these chunks in ``known``. Of others those met last stay: what fills ``known`` becomes ``older``."""
        new = need.difference(self.known)
        if len(self.known) + len(new) > MEMORY // 2:
            self.older, self.known = self.known, {}
            new = need
        again = new.intersection(self.older)
        self.known.update((c, self.older[c]) for c in again)
        self.learn(new.difference(again))

    def digests(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Token count, digest of the ids, digest of the decoded bytes."""
        cut = [self.chunks(t) if t else [] for t in texts]
        self.remember({c for one in cut for c in one})
        known = self.known
        if len(known) > MEMORY // 2:
            self.known = {}
        for one in cut:
            got = [known[c] for c in one]
            ids = " ".join([g[0] for g in got if g[0]])
            whole = b"".join([g[1] for g in got])
            yield (ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(whole).hexdigest())


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The process's own codec for a rank file."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _default(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, rows: int = 100) -> DataFrame:
    """Every document's token count and the digests of its ids and of the bytes they decode to."""
    path, pattern = _default(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                n, ids, decoded = zip(*own.digests(part.column(1).to_pylist()), strict=True)
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenize(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Every document's ids with the bytes and characters that each token covers."""
    path, pattern = _default(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [own.ids(t) for t in texts]
            spans = [own.spans(t, i) for t, i in zip(texts, ids, strict=True)]
            lists = [ids, [[a for a, _ in s] for s in spans], [[b for _, b in s] for s in spans]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.list_(pa.int32())) for x in lists]], ["doc_id", "ids", "char_start", "char_end"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, ids array<int>, char_start array<int>, char_end array<int>")


def decode_ids(tokens: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The bytes of each row's ids, and its text where the bytes are whole characters."""
    path, pattern = _default(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            whole = [None if i is None else own.decode(i) for i in batch.column(1).to_pylist()]
            texts = [None if b is None else b.decode("utf-8", "replace") for b in whole]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "bytes", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary, text string")
