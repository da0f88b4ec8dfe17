"""Token ids of whole texts, by a public tokenizer whose words do not touch.

The tokenizer drops white space, lower-cases, and splits letters from the marks after
them, so that a text's ids are those of its words in a row. Words are hashed with the
kernels of ``_text``, looked up in sorted arrays that a worker keeps, and only those not
met lately go to the tokenizer. What a worker keeps is bounded.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from veilframe.llm import _text

_MOST = 1_000_000
_FRESH = 50_000
#: No hash of a longer word is kept.
_LONG = 64
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,!?;:"]] = True
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True
_AS_IS = np.arange(256, dtype=np.uint8)


def _gather(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """flat[start : start + n] of each row, one after another."""
    before = np.cumsum(n) - n
    return flat[np.repeat(start - before, n) + np.arange(n.sum())]


class _Table:
    """Hash to ids: sorted keys, and where their ids lie."""

    def __init__(self) -> None:
        self.key, self.start, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(0, np.uint32), np.zeros(0, bool)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it is not there."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = self.key[at] == key
        self.used[at[hit]] = True
        return np.where(hit, at, -1)

    def add(self, key: np.ndarray, n: np.ndarray, flat: np.ndarray) -> None:
        """Takes new keys in; beyond the bound, those not used since last time go."""
        keep = self.used if len(self.key) > _MOST else np.ones(len(self.key), bool)
        kept = _gather(self.flat, self.start[keep], self.n[keep])
        key, n, flat = np.concatenate([self.key[keep], key]), np.concatenate([self.n[keep], n]), np.concatenate([kept, flat])
        order = np.argsort(key)
        self.key, self.n, self.start, self.flat = key[order], n[order], (np.cumsum(n) - n)[order], flat
        self.used = np.zeros(len(key), bool)


class Encoder:
    """The ids of texts, ``end`` after each."""

    def __init__(self, path: str, end: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        self.tables = [_Table(), _Table()]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, n+1 offsets) of a chunk of UTF-8."""
        start, end = _text.words(data, offsets)
        # A single mark after a letter is a word of its own.
        last, before = data[end - 1], data[np.maximum(end - 2, 0)]
        lead = data[np.maximum(end - 3, 0)]
        letter = _ASCII[before] | ((lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (end - start > 2))
        cut = np.flatnonzero(_MARK[last] & letter & (end - start > 1))
        start = np.insert(start, cut + 1, end[cut] - 1)
        ends = np.insert(end, cut + 1, end[cut])
        ends[cut + np.arange(len(cut))] -= 1
        end = ends
        key = _text.span_hash(_text.prefix_hashes(data), start, end)
        if (data == 60).any():  # a special token's string counts in its own letters only
            angle = np.concatenate([[0], np.cumsum(data == 60)])
            own = angle[end] > angle[start]
            key[own] = _text.mix(_text.span_hash(_text.prefix_hashes(data, _AS_IS), start[own], end[own]))
        distinct, first, word = np.unique(key, return_index=True, return_inverse=True)
        n, at = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        parts, size, todo = [], 0, np.ones(len(distinct), bool)
        for table in self.tables:
            place = table.find(distinct)
            hit = todo & (place >= 0)
            n[hit] = table.n[place[hit]]
            parts.append(_gather(table.flat, table.start[place[hit]], n[hit]))
            at[hit] = size + np.cumsum(n[hit]) - n[hit]
            size += len(parts[-1])
            todo &= ~hit
        new = np.flatnonzero(todo)
        if len(new):
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)]
            found = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            n[new] = [len(x) for x in found]
            parts.append(np.fromiter((i for x in found for i in x), np.uint32, n[new].sum()))
            at[new] = size + np.cumsum(n[new]) - n[new]
            short = (end - start)[first[new]] <= _LONG
            main, fresh = self.tables
            fresh.add(distinct[new[short]], n[new[short]], _gather(parts[-1], (np.cumsum(n[new]) - n[new])[short], n[new[short]]))
            if len(fresh.key) > _FRESH:
                main.add(fresh.key, fresh.n, _gather(fresh.flat, fresh.start, fresh.n))
                self.tables = [main, _Table()]
        count = n[word]
        ids = _gather(np.concatenate(parts), at[word], count)
        total = np.concatenate([[0], np.cumsum(count)])[_text.counts_by_doc(start, offsets)]
        return np.insert(ids, total[1:], self.end), total + np.arange(len(total))


@lru_cache(2)
def encoder(path: str, end: int) -> Encoder:
    return Encoder(path, end)
