"""Whole texts to token ids with the tokenizers library, a unit of white space and word at a time.

Both vocabularies used here split a text at every change from a word to white space before they merge
bytes, so a text's ids are its units' ids in order. A task looks units up in a table of fixed size, by all
their bytes, and has the library encode those that are not there. Texts with unusual white space, on which
regex dialects disagree, and those that hold the string of a special token are encoded whole. Ids are those of the
library with add_special_tokens=False and nothing else set: a special token's string in a text is that token.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from trackmill import shared

ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Between an ASCII letter and one of these there is always a cut as well.
MARK, LETTER = np.zeros(256, bool), np.zeros(256, bool)
MARK[list(b"!#$%&*,.:;?|")] = True
LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 20
#: Units of at most this many bytes and ids are kept.
KEPT_BYTES, KEPT_IDS = 16, 8
SLOT_BITS = 19
#: Bytes of text of a batch that a worker turns into Python objects at once.
SLICE = 2 << 20
FILLED = np.arange(KEPT_IDS) < np.arange(KEPT_IDS + 1)[:, None]
_LOW = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def chunks(texts: Sequence[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about limit bytes each."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches' rows, in batches with about limit bytes in column: a batch of Spark's is bounded by rows alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < len(batch):
            before = ends[begin - 1] if begin else 0
            end = max(int(np.searchsorted(ends, before + limit, "right")), begin + 1)
            yield batch.slice(begin, end - begin)
            begin = end


def small_batches(spark: SparkSession, limit: int = 2 * SLICE) -> None:
    """Have Spark send texts to Python in batches of about limit bytes (64 MB by default), where the session does not ask for less.

    It stays so for the session: plans are made when their results are asked for.
    """
    shared.small_batches(spark, limit)


class UnitEncoder:
    """Encodes texts into ids as the library does."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.whole = re.compile("|".join([ODD_SPACE.pattern, *map(re.escape, special)]))
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        n = 1 << SLOT_BITS
        self.low, self.high, self.size = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.uint8)
        self.count, self.ids = np.zeros(n, np.uint8), np.zeros((n, KEPT_IDS), self.dtype)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: Sequence[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        raw = [t.encode() for t in texts]
        for a, b in chunks(raw):
            yield from self._chunk(raw[a:b], texts[a:b])

    def _chunk(self, raw: list[bytes], texts: Sequence[str]) -> list[np.ndarray]:
        whole = {i: np.array(self._library([t])[0], self.dtype) for i, t in enumerate(texts) if self.whole.search(t)}
        buf = b"".join([b"" if i in whole else r for i, r in enumerate(raw)])
        lengths = np.array([0 if i in whole else len(r) for i, r in enumerate(raw)], np.int64)
        if not buf:
            return [whole.get(i, np.zeros(0, self.dtype)) for i in range(len(raw))]
        data = np.frombuffer(buf + bytes(24), np.uint8)
        n = len(buf)
        first = np.concatenate([[0], np.cumsum(lengths)])
        space = SPACE[data[:n]]
        cut = np.zeros(n + 1, bool)
        cut[1:n] = (space[1:] & ~space[:-1]) | (MARK[data[1:n]] & LETTER[data[: n - 1]])
        cut[first] = True
        cut[n] = False
        start = np.flatnonzero(cut)
        size = np.diff(start, append=n)
        eight = np.ndarray((n + 16,), "<u8", data, strides=(1,))
        low = eight[start] & _LOW[np.minimum(size, 8)]
        high = eight[start + np.minimum(size, 8)] & _LOW[np.clip(size - 8, 0, 8)]
        mixed = (low ^ (high * np.uint64(0x9E3779B97F4A7C15)) ^ size.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        slot = (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        small = size <= KEPT_BYTES
        short = size.astype(np.uint8)
        hit = small & (self.low[slot] == low) & (self.high[slot] == high) & (self.size[slot] == short)
        rest = np.flatnonzero(small & ~hit)
        other = slot[rest] ^ 1
        found = (self.low[other] == low[rest]) & (self.high[other] == high[rest]) & (self.size[other] == short[rest])
        slot[rest] = other
        hit[rest] = found
        count = self.count[slot].astype(np.int64)
        ids = self.ids[slot]
        miss = np.flatnonzero(~hit)
        apart: dict[int, list[int]] = {}
        if len(miss):
            keys, at, back = np.unique(mixed[miss], return_index=True, return_inverse=True)
            lead = miss[at]
            same = (low[lead][back] == low[miss]) & (high[lead][back] == high[miss]) & (size[lead][back] == size[miss]) & small[miss]
            alone = miss[~same]
            todo = np.concatenate([lead, alone])
            got = self._library([buf[s : s + z].decode() for s, z in zip(start[todo].tolist(), size[todo].tolist(), strict=True)])
            new_count = np.array([len(x) for x in got[: len(lead)]], np.int64)
            new_ids = np.zeros((len(lead), KEPT_IDS), self.dtype)
            fits = new_count <= KEPT_IDS
            flat = np.array([x for y in got[: len(lead)] if len(y) <= KEPT_IDS for x in y], self.dtype)
            new_ids[(np.arange(KEPT_IDS) < new_count[:, None]) & fits[:, None]] = flat
            count[miss], ids[miss] = new_count[back], new_ids[back]
            for j, i in zip(back[same & ~fits[back]].tolist(), miss[same & ~fits[back]].tolist(), strict=True):
                apart[i] = got[j]
            for i, x in zip(alone.tolist(), got[len(lead) :], strict=True):
                apart[i] = x
                count[i] = len(x)
            keep = fits & small[lead]
            where, to = lead[keep], slot[lead[keep]]
            to = np.where(self.size[to ^ 1] == 0, to ^ 1, to)
            to, pick = np.unique(to, return_index=True)  # of units dealt to one slot, one stays
            where, new = where[pick], np.flatnonzero(keep)[pick]
            self.low[to], self.high[to], self.size[to] = low[where], high[where], short[where]
            self.count[to], self.ids[to] = new_count[new], new_ids[new]
        kept = np.minimum(count, KEPT_IDS)
        for i in apart:
            kept[i] = 0
        flat = ids[FILLED[kept]]
        if apart:
            ends, parts, last = np.cumsum(kept), [], 0
            for i in sorted(apart):
                parts += [flat[last : ends[i]], np.array(apart[i], self.dtype)]
                last = ends[i]
            flat = np.concatenate([*parts, flat[last:]])
        ends = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(start, first)]
        return [whole[i] if i in whole else flat[ends[i] : ends[i + 1]] for i in range(len(raw))]


@functools.lru_cache(2)
def encoder(path: str) -> UnitEncoder:
    """This process's encoder for a tokenizer file: a Python worker keeps it, and its table, from task to task."""
    return UnitEncoder(path)
