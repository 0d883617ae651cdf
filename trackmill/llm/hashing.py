"""Hashes of words and word shingles over many texts at once.

A word's hash is a polynomial of random 64-bit values of its bytes modulo 2^64, from sums over prefixes, then
mixed; a shingle's is a mixed sum of its words' hashes, each times a constant of its place. Both depend on the
words alone, so they are alike in all tasks. Two different values share a hash with a probability near 2^-58.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

from trackmill.llm.tokens import chunks

U = np.uint64
#: Bytes handled at once; a longer text is handled alone.
CHUNK = 1 << 19
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _RANDOM.integers(0, 1 << 64, 256, np.uint64)
_PLACES = _RANDOM.integers(0, 1 << 64, 16, np.uint64) | U(1)
_BASE = int(_RANDOM.integers(0, 1 << 62, dtype=np.uint64)) * 4 + 3
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers or more of the base and of its inverse."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    kept = CHUNK + (CHUNK >> 3)
    made = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, kept), b & (1 << 64) - 1, np.uint64))]) for b in (_BASE, _UNBASE)]
    if n <= kept:
        _powers[:] = made  # those of a longer text go when it is done
    return made[0], made[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_table(separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes end a word, and each byte's lower case (A to Z only)."""
    cut, lower = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
    cut[list(separators)] = True
    lower[65:91] += 32
    return cut, lower


#: Words end at ASCII white space.
WHITE = byte_table(b"\t\n\v\f\r ")
#: Words end at any ASCII byte that is neither a letter nor a digit.
MARKS = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))


@dataclass
class Words:
    """All words of some texts: the text of each, its first and end byte in that text, its hash."""

    texts: int
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Of each text and the end: its first word."""
        return np.searchsorted(self.doc, np.arange(self.texts + 1))


def words(raw: Sequence[bytes], table: tuple[np.ndarray, np.ndarray] = WHITE) -> Words:
    cut, lower = table
    data = np.frombuffer(b"\n".join([b"", *raw, b""]), np.uint8)
    lengths = np.array([len(r) + 1 for r in raw], np.int64)
    begins = np.concatenate([[1], 1 + np.cumsum(lengths)])
    inside = ~cut[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    up, down = powers(len(data) + 1)
    sums = np.cumsum(_BYTES[lower[data]] * up[: len(data)])
    value = mix((sums[end - 1] - sums[start - 1]) * down[start])
    doc = np.searchsorted(begins, start, "right") - 1
    return Words(len(raw), doc, start - begins[doc], end - begins[doc], value)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each run of size words; a text with fewer words has its whole sequence as one."""
    n = len(w.hash)
    docs, out = [], []
    if n >= size:
        total = np.zeros(n - size + 1, np.uint64)
        for j in range(size):
            total += w.hash[j : n - size + 1 + j] * _PLACES[j]
        whole = w.doc[: n - size + 1] == w.doc[size - 1 :]
        docs.append(w.doc[: n - size + 1][whole])
        out.append(mix(total[whole]))
    first = w.first
    count = np.diff(first)
    for k in range(1, size):
        few = np.flatnonzero(count == k)
        if len(few):
            total = np.full(len(few), k, np.uint64)
            for j in range(k):
                total += w.hash[first[few] + j] * _PLACES[j]
            docs.append(few)
            out.append(mix(total))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(out)


def shingle_sets(texts: Sequence[str | None], size: int, table: tuple[np.ndarray, np.ndarray] = WHITE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text (null: none)."""
    raw = [(t or "").encode() for t in texts]
    for a, b in chunks(raw, CHUNK):
        doc, value = shingles(words(raw[a:b], table), size)
        order = np.argsort(value, kind="stable")
        order = order[np.argsort(doc[order], kind="stable")]
        doc, value = doc[order], value[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        doc, value = doc[new], value[new]
        at = np.searchsorted(doc, np.arange(b - a + 1))
        for i in range(b - a):
            yield value[at[i] : at[i + 1]]
