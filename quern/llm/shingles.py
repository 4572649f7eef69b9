"""Hashed word shingles of whole texts, many texts at a time."""

from __future__ import annotations

import numpy as np

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_P = np.uint64(0x9E3779B97F4A7C15)


def scramble(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = scramble(np.arange(256, dtype=np.uint64), 11)


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), _P)]), dtype=np.uint64)


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """For each text the ascending distinct 64-bit hashes of its shingles.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A text of
    fewer words than ``width`` has its whole sequence as its one shingle; one
    without words has none.
    """
    raw = [(t or "").encode("utf-8", "replace").lower() for t in texts]  # bytes.lower() changes A-Z only
    sizes = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    seen = ~_BLANK[data]
    edge = np.diff(seen.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    empty = np.zeros(0, np.uint64)
    if not len(starts):
        return [empty for _ in texts]
    lengths = ends - starts
    at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    with np.errstate(over="ignore"):
        words = np.add.reduceat(_BYTE[data[seen]] * _powers(int(lengths.max()))[place], at)
        words = scramble(words + lengths.astype(np.uint64))
        doc = np.searchsorted(np.cumsum(sizes), starts, side="right")
        count = np.bincount(doc, minlength=len(texts))
        weight = _powers(width + 1)[1:]
        rolled = np.zeros(max(len(words) - width + 1, 0), np.uint64)
        for j in range(width):
            rolled += words[j : j + len(rolled)] * weight[j]
        rolled = scramble(rolled, 1)
        first = np.concatenate([[0], np.cumsum(count)])
        out = []
        for i, n in enumerate(count.tolist()):
            a = int(first[i])
            if n >= width:
                out.append(np.unique(rolled[a : a + n - width + 1]))
            elif n:
                out.append(scramble((words[a : a + n] * weight[:n]).sum(keepdims=True, dtype=np.uint64), 1 + n))
            else:
                out.append(empty)
    return out
