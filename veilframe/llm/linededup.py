"""Near-duplicate lines by a segment-partition edit join over words.

A line is a sequence of words, and an edit inserts, deletes or replaces one: a changed
word, or an accented letter put in, is one edit. The threshold depends on the number of
words (``Tolerance``).

1. Every line becomes a 128-bit name and a place; equal lines collapse to one class by
   partial aggregation.
2. A class is cut into threshold + 1 segments of words. Of two lines within the threshold
   one segment of the shorter is untouched in the longer, near the same place: the index
   has (length, number, segment), and a line probes it with its own runs of words for
   each length it may pair with (multi-match-aware windows).
3. Classes that meet in the index are read again, each at one of its places. A key of two
   classes is a pair to verify. Of larger ones: where segment number i is the first
   that no edit touches, at most i edits stand before it and the rest of the threshold
   behind it. So what the two lines share is taken out, and the gaps before and behind it
   go through the same index with these smaller thresholds, inside their block, until a
   gap of one edit is short: it is looked up without each of its words, and all lines that
   meet there are within the threshold. Lines that only share a half are told apart so.
4. A block of a few thousand lines at most is finished in one task, which narrows the gaps in
   memory, compares those of lines that it has not joined yet once few lines are left, and
   returns fewer links than lines. A larger one forms a star about
   one line (see ``graph.Stars``), never all pairs, and goes to the next level. A candidate
   is verified by edit distance, with bit-parallel arithmetic on a band. Blocks that are
   joined, and blocks of one line, are left out of the next level.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.columns import unused
from veilframe.llm import _text
from veilframe.llm._bloom import Bloom
from veilframe.llm._store import keep, scratch, sized
from veilframe.llm._vectors import arrow_rows
from veilframe.llm.graph import Stars

_U = np.uint64
#: A-Z in lower case, and all white space as 32.
_NORMAL = np.where(_text.SPACE, 32, _text.LOWER).astype(np.uint8)
_LINES = "doc_id long, h long, line long, bytes long, id binary, id8 long, place long, probes array<long>"
_SIZE = _U(0x9E3779B97F4A7C15)
#: Gaps of so many words at most are looked up without each of their words, and done with.
_GAP = 32
#: Bytes of gaps in a batch.
_HELD = 1 << 22
#: A block of so many lines, with so many bytes of gaps, at most is finished in one task.
_FEW, _FEW_BYTES = 4096, 1 << 22
#: There, blocks of so many lines at most are compared line by line, larger ones are narrowed.
_PAIRS = 48
#: Words of all pairs that are verified side by side.
_SIDE = 1 << 21


@dataclass(frozen=True)
class Tolerance:
    """Edits that lines of n words may differ by: none below ``least`` words, one from there, two from ``twice`` on.

    The shorter line of a pair counts. Two edits ask for 12 keys a line in place of 4.
    """

    least: int = 8
    twice: int = 48

    def __post_init__(self) -> None:
        if self.least < 3:
            raise ValueError("lines of one or two words have no tolerance")

    def of(self, n: np.ndarray) -> np.ndarray:
        return (n >= self.least).astype(np.int64) + ((n >= self.least) & (n >= self.twice))


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, number in it, start, end) of each line, white space at its ends left out."""
    cut = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], cut + 1]))
    edges = edges[edges < len(data)]
    doc = np.searchsorted(offsets, edges, "right") - 1
    end = np.minimum(np.append(edges[1:], len(data)), offsets[doc + 1]) if len(edges) else edges
    # A document's k-th line follows k line breaks of its own.
    number = np.searchsorted(cut, edges) - np.searchsorted(cut, offsets[doc])
    return doc, number, *_trim(data, edges, end)


def _trim(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines without white space at their ends; a blank one is empty."""
    for _ in range(4):
        some = start < end
        front = some & _text.SPACE[data[np.where(some, start, 0)]] if len(some) else some
        back = some & _text.SPACE[data[np.where(some, end - 1, 0)]] if len(some) else some
        if not front.any() and not back.any():
            return start, end
        start = start + front
        end = np.maximum(end - back, start)
    black = np.flatnonzero(~_text.SPACE[data])  # long runs of white space
    first, last = np.searchsorted(black, start), np.searchsorted(black, end) - 1
    some = last >= first
    black = black if len(black) else np.zeros(1, np.int64)
    return np.where(some, black[np.minimum(first, len(black) - 1)], start), np.where(some, black[np.maximum(last, 0)] + 1, start)


def normal(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of lines one after another: A-Z lower-cased, a run of white space as one space.

    start: where the lines of data that are not blank begin, all of them.
    """
    out = _NORMAL[data]
    black = out != 32
    on = black.copy()
    on[:-1] |= black[1:]  # of a run of white space the last byte stays
    before = start[start > 0] - 1
    on[before] &= black[before]  # but not before a line
    return out[on], np.append(start - np.searchsorted(np.flatnonzero(~on), start), np.count_nonzero(on))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, n+1 positions) of the words of normal lines.

    A word is a run of what is no white space; a character of three bytes or more (of
    East Asian scripts, for the most part) is a word by itself.
    """
    black = data != 32
    first, last = black.copy(), black.copy()
    first[1:] &= ~black[:-1]
    last[:-1] &= ~black[1:]
    edge = offsets[:-1][np.diff(offsets) > 0]
    first[edge] = True
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True
    if (data >= 0xE0).any():
        lead = (data & 0xC0) != 0x80
        char = np.cumsum(lead) - 1
        wide = (data[lead] >= 0xE0)[char] if lead[0] else np.zeros(len(data), bool)
        turn = lead & (wide | np.concatenate([[False], wide[:-1]])) & black
        first |= turn
        last[:-1] |= turn[1:] & black[:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


def windows(n: np.ndarray, edits: Tolerance) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray, bool]]:
    """(lines, length asked for, segment, start, size, own) of the probes of lines of n words.

    own: it is the line's segment itself, and may be found by others.
    """
    for less in range(3):
        asked = n - less
        allowed = edits.of(asked)
        for t in (1, 2):
            rows = np.flatnonzero((allowed == t) & (less <= t))
            if not len(rows):
                continue
            long = asked[rows]
            short, more = long // (t + 1), long % (t + 1)
            for i in range(t + 1):
                at = i * short + np.maximum(0, i - (t + 1 - more))
                size = short + (i >= t + 1 - more)
                for shift in range(max(-i, less - (t - i)), min(i, less + (t - i)) + 1):
                    ok = (at + shift >= 0) & (at + shift + size <= n[rows])
                    yield rows[ok], long[ok], i, (at + shift)[ok], size[ok], less == 0 and shift == 0


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time; for keys, which only make candidates."""
    n = end - start
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    out = _text.loads(padded, start, n)
    rows, k = np.flatnonzero(n > 8), 8
    while len(rows) and k < 64:
        out[rows] = _text.mix(out[rows]) + _text.loads(padded, start[rows] + k, n[rows] - k)
        k += 8
        rows = rows[n[rows] > k]
    if len(rows):
        raw = data.tobytes()
        out[rows] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start[rows].tolist(), end[rows].tolist(), strict=True)]
    return _text.mix(out + n.astype(np.uint64) * _SIZE)


def _places(doc_id: np.ndarray, h: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the place of each line."""
    return _text.combine([x.astype(np.int64).view(np.uint64) for x in (doc_id, h, line)]).view(np.int64)


def _lists(rows: list[np.ndarray], keys: list[np.ndarray], n: int) -> pa.ListArray:
    row, key = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, keys))
    order = np.argsort(row, kind="stable")
    return pa.ListArray.from_arrays(np.searchsorted(row[order], np.arange(n + 1)).astype(np.int32), pa.array(key[order].astype(np.int64)))


def _read(edits: Tolerance, short: bool):
    """The places and names of lines, and their keys: own ones are odd, those that only ask are even.

    A line that a chunk holds again has its keys once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, h = (batch.column(k).to_numpy() for k in (0, 1))
            for lo, _, data, offsets in _text.text_chunks(batch.column(2)):
                doc, number, start, end = lines(data, offsets)
                some = end > start
                doc, number, start, end = doc[some] + lo, number[some], start[some], end[some]
                flat, at = normal(data, start)
                first, last, place = tokens(flat, at)
                n = np.diff(place)
                raw, ends = flat.tobytes(), at.tolist()
                names = [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
                at8 = np.frombuffer(b"".join(names), np.int64)[::2]
                fresh = np.zeros(len(n), np.int64)
                fresh[np.unique(at8, return_index=True)[1]] = 1
                prefix = _text.sequence_hashes(_word_hashes(flat, first, last))
                rows, keys = [], []
                for r, asked, i, shift, size, own in windows(n * fresh, edits):
                    a = place[r] + shift
                    key = _text.combine([_text.span_hash(prefix, a, a + size), asked.astype(np.uint64), np.full(len(r), i, np.uint64)])
                    rows.append(r)
                    keys.append((key | _U(1) if own else key & ~_U(1)).view(np.int64))
                places = _places(doc_id[doc], h[doc], number)
                columns = (doc_id[doc], h[doc], number, end - start, pa.array(names, pa.binary()), at8, places, _lists(rows, keys, len(n)))
                out = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["doc_id", "h", "line", "bytes", "id", "id8", "place", "probes"])
                yield out if short else out.filter(pa.array(n >= edits.least))

    return run


def _fetch(wanted: Bloom):
    """(id, text) of lines whose place passes the filter, as normal lines; no other line is made normal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, h = (batch.column(k).to_numpy() for k in (0, 1))
            for lo, _, data, offsets in _text.text_chunks(batch.column(2)):
                doc, number, start, end = lines(data, offsets)
                found = np.flatnonzero(wanted.has(_places(doc_id[doc + lo], h[doc + lo], number)) & (end > start))
                start, end = start[found], end[found]
                held = b"".join([data[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
                flat, at = normal(np.frombuffer(held, np.uint8), np.cumsum(end - start) - (end - start))
                raw, at = flat.tobytes(), at.tolist()
                rows = {xxhash.xxh3_128_digest(x): x for x in (raw[a:b] for a, b in zip(at, at[1:], strict=False))}
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.binary()) for x in (rows, rows.values())], ["id", "text"])

    return run


# --- gaps --------------------------------------------------------------------------------
# A gap is a number of edits and the words that they may touch, 8 bytes a word.


def _key(*parts: bytes | int) -> int:
    raw = b"".join(p if isinstance(p, bytes) else struct.pack("<q", p) for p in parts)
    return struct.unpack("<q", xxhash.xxh3_64_digest(raw))[0]


def _ends(words: bytes, free: int, less: int) -> Iterator[bytes]:
    """What is left of a short gap if ``less`` of its words go and ``free`` others may be any word."""
    each = [words[k : k + 8] for k in range(0, len(words), 8)]
    for gone in combinations(range(len(each)), less):
        left = [w for k, w in enumerate(each) if k not in gone]
        for any_ in combinations(range(len(left)), min(free, len(left))):
            yield b"".join(b"*" * 8 if k in any_ else w for k, w in enumerate(left))


def narrower(block: int, words: bytes, allowed: list[int], rest: list[tuple[int, bytes]], first: bool = False) -> Iterator[tuple[int, bool, list[tuple[int, bytes]]]]:
    """(block, own, gaps) of each way to narrow a line's gap of these words.

    allowed: the edits of a pair whose shorter gap has 0, 1, 2 words less; rest: the line's
    other gaps, which stay; first: the gap is the whole line, which is cut whatever its length.
    """
    n = len(words) // 8
    for less, t in enumerate(allowed):
        asked = n - less
        if asked < 0 or less > t:
            continue
        if t == 1 and asked <= _GAP and not first:
            # What is left without each of the words: all lines that share it are one edit apart.
            each = [words[: 8 * k] + words[8 * k + 8 :] for k in range(n)]
            if less:
                yield from ((_key(block, asked, b"all", left), False, rest) for left in dict.fromkeys(each))
            else:
                yield _key(block, asked, b"all", words), True, rest
                yield from ((_key(block, asked, k, left), True, rest) for k, left in enumerate(each))
            continue
        if asked <= t:
            # Two edits at most: a longer line has lost ``less`` words and else replaced some.
            for left in _ends(words, t - less, less):
                yield _key(block, t, asked, less, left), less == 0, rest
            for other in range(1, t + 1) if less == 0 else ():
                for left in _ends(words, t - other, 0):
                    yield _key(block, t, asked, other, left), True, rest
            continue
        short, more = asked // (t + 1), asked % (t + 1)
        for i in range(t + 1):
            at = i * short + max(0, i - (t + 1 - more))
            size = short + (i >= t + 1 - more)
            for shift in range(max(-i, less - (t - i)), min(i, less + (t - i)) + 1):
                a = at + shift
                if a < 0 or a + size > n:
                    continue
                key, left = _key(block, t, asked, i, words[8 * a : 8 * (a + size)]), []
                for edits, part in ((i, words[: 8 * a]), (t - i, words[8 * (a + size) :])):
                    if edits:
                        left.append((edits, part))
                    else:  # no edit here: both lines have the same
                        key = _key(key, part)
                yield key, less == 0 and shift == 0, left + rest


_BLOCKS = "block long, id binary, centre boolean, gaps array<struct<edits:int,words:binary>>"
_NAMES = "block long, id binary, centre boolean, bytes long"


def _names(rows: Iterator[tuple[bytes, int, bytes, list[int], list]], first: bool) -> Iterator[pa.RecordBatch]:
    """``_blocks`` with the number of bytes of the gaps in place of these."""
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.bool_(), pa.int64())
        columns = zip(*out, strict=True) if out else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "id", "centre", "bytes"])

    for name, block, words, allowed, rest in rows:
        out += [(key, name, own, sum(len(w) for _, w in gaps)) for key, own, gaps in narrower(block, words, allowed, rest, first)]
        if len(out) > 1 << 14:
            yield batch()
            out = []
    yield batch()


def _blocks(rows: Iterator[tuple[bytes, int, bytes, list[int], list]], first: bool) -> Iterator[pa.RecordBatch]:
    """Batches of ``narrower`` of (line, block, words, allowed, other gaps)."""
    kind = pa.list_(pa.struct([("edits", pa.int32()), ("words", pa.binary())]))
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        block, name, own, gaps = zip(*out, strict=True) if out else ((),) * 4
        gaps = [[{"edits": e, "words": w} for e, w in g] for g in gaps]
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(name, pa.binary()), pa.array(own, pa.bool_()), pa.array(gaps, kind)], ["block", "id", "centre", "gaps"])

    held = 0
    for name, block, words, allowed, rest in rows:
        for key, own, gaps in narrower(block, words, allowed, rest, first):
            out.append((key, name, own, gaps))
            held += 100 + sum(len(w) for _, w in gaps)
            if held > _HELD:  # in the middle of a line too: each of its keys may hold all of it
                yield batch()
                out, held = [], 0
    yield batch()


def _first_level(edits: Tolerance, make=_blocks):
    """(id, text) to the blocks of the index."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            data, offsets = _binary(batch.column(1))
            start, end, place = tokens(data, offsets)
            word = _text.word_hashes(data, start, end)[0].tobytes()
            n = np.diff(place)
            allowed = np.column_stack([edits.of(n - less) for less in range(3)]).tolist()
            for k, name in enumerate(batch.column(0).to_pylist()):
                yield name, 0, word[8 * place[k] : 8 * place[k + 1]], allowed[k], []

    return lambda batches: make(rows(batches), True)


def _next_level(make=_blocks):
    """(block, id, gaps) to blocks whose first gap is narrower."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for block, name, gaps in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                (t, words), *rest = [(g["edits"], g["words"]) for g in gaps]
                yield name, block, words, [t] * (t + 1), rest

    return lambda batches: make(rows(batches), False)


def _same(x: bytes, y: bytes, order: str) -> int:
    """Bytes of the words that both begin with ("little") or end with ("big")."""
    m = min(len(x), len(y))
    one, two = (x[:m], y[:m]) if order == "little" else (x[len(x) - m :], y[len(y) - m :])
    apart = int.from_bytes(one, order) ^ int.from_bytes(two, order)
    return m if not apart else ((apart & -apart).bit_length() - 1) // 64 * 8


def near(x: bytes, y: bytes, edits: int) -> bool:
    """Whether so many words at most are inserted, deleted or replaced; 8 bytes a word."""
    if x == y:
        return True
    if not edits or abs(len(x) - len(y)) > 8 * edits:
        return False
    head = _same(x, y, "little")
    x, y = x[head:], y[head:]
    tail = _same(x, y, "big")
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    # Both ends differ now, so that the first word takes an edit.
    if max(len(x), len(y)) <= 8 * edits:
        return True
    return edits > 1 and any(near(a, b, edits - 1) for a, b in ((x[8:], y[8:]), (x[8:], y), (x, y[8:])))


class _Parts:
    """What links join in a block; a link is noted if it joins two parts."""

    def __init__(self, names: list[bytes]) -> None:
        self.of = {name: name for name in names}
        self.members = {name: [name] for name in self.of}
        self.links: list[tuple[bytes, bytes]] = []

    def join(self, a: bytes, b: bytes) -> None:
        x, y = self.of[a], self.of[b]
        if x == y:
            return
        self.links.append((a, b))
        if len(self.members[x]) < len(self.members[y]):
            x, y = y, x
        gone = self.members.pop(y)
        self.members[x] += gone
        self.of.update(dict.fromkeys(gone, x))

    def compare(self, one: tuple, others: list[tuple]) -> None:
        """Joins a line with those of other parts that are linked with it: each of their gaps is within its edits."""
        a, _, left = one
        for b, _, right in others:
            if self.of[a] != self.of[b] and len(left) == len(right):
                if all(e == f and near(x, y, e) for (e, x), (f, y) in zip(left, right, strict=True)):
                    self.join(a, b)


def finish(block: list[tuple[bytes, bool, list[tuple[int, bytes]]]], parts: _Parts) -> None:
    """Joins what links join among lines (id, own, gaps) of a block; in a pair one is indexed there.

    A large block is a star first, and then narrowed as in the next level; blocks of one
    part are done with.
    """
    block = sorted(block, key=lambda m: not m[1])
    own = sum(m[1] for m in block)
    if not own or len({parts.of[m[0]] for m in block}) < 2:
        return
    if len(block) <= _PAIRS:
        for k in range(own):
            parts.compare(block[k], block[k + 1 :])
        return
    parts.compare(block[0], block[1:])
    if len({parts.of[m[0]] for m in block}) < 2:
        return
    blocks: dict[int, list[tuple]] = {}
    for name, _, gaps in block:
        if gaps:  # lines without a gap are linked with the first, if that has none
            (t, words), *rest = gaps
            for key, own_, left in narrower(0, words, [t] * (t + 1), rest):
                blocks.setdefault(key, []).append((name, own_, left))
    while blocks:
        finish(blocks.popitem()[1], parts)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(members) of blocks to links (id, other) that join what the block's links join."""
    for batch in batches:
        links = []
        members = batch.column(0).flatten()
        names, own, gaps = (members.field(c) for c in ("id", "centre", "gaps"))
        each = list(zip(*[gaps.flatten().field(c).to_pylist() for c in ("edits", "words")], strict=True))
        at = np.concatenate([[0], np.cumsum(gaps.value_lengths().to_numpy(zero_copy_only=False))]).tolist()
        lines_ = [(n, c, each[a:b]) for n, c, a, b in zip(names.to_pylist(), own.to_pylist(), at, at[1:], strict=False)]
        ends = np.concatenate([[0], np.cumsum(batch.column(0).value_lengths().to_numpy(zero_copy_only=False))]).tolist()
        for lo, hi in zip(ends, ends[1:], strict=False):
            block = lines_[lo:hi]
            parts = _Parts([m[0] for m in block])
            finish(block, parts)
            links += parts.links
        one, two = zip(*links, strict=True) if links else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(one, pa.binary()), pa.array(two, pa.binary())], ["id", "other"])


# --- verification ------------------------------------------------------------------------


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column."""
    texts = column.cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def within(a: list[np.ndarray], b: list[np.ndarray], tau: int) -> np.ndarray:
    """Whether each pair's edit distance is at most tau (below 31); values are whole numbers from 0.

    Hyyro's bit-parallel recurrence on a band, for all pairs at once: a word's top
    2 tau + 1 bits are the rows about the diagonal, and move down a row each column. The
    distance is followed along the lower edge of the band, then along the last row.
    """
    out = np.zeros(len(a), bool)
    n, m = (np.array([f(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64) for f in (max, min))
    rows = np.flatnonzero(n - m <= tau)
    if not len(rows):
        return out
    # An equal start changes no distance, and keeps lengths above tau.
    edge = tau + 1
    n, m = n[rows] + edge, m[rows] + edge
    width = int(m.max())
    x = np.full((int(n.max()) + 2 * edge + width + 1, len(rows)), -1, np.int32)
    y = np.full((width, len(rows)), -2, np.int32)
    for k, r in enumerate(rows):
        long, short = (a[r], b[r]) if len(a[r]) >= len(b[r]) else (b[r], a[r])
        x[edge : 2 * edge, k] = 0
        x[2 * edge : edge + n[k], k] = long.astype(np.int32) + 1
        y[:edge, k] = 0
        y[edge : m[k], k] = short.astype(np.int32) + 1
    up = np.full(len(rows), (~_U(0)) << _U(63 - tau))
    down = np.zeros(len(rows), np.uint64)
    distance, flat = np.full(len(rows), tau, np.int64), np.full(len(rows), 1 << 62, np.uint64)
    for i in range(width):
        match = np.zeros(len(rows), np.uint64)
        for k in range(2 * tau + 1):
            at = edge + tau + i - k
            match |= (x[at] == y[i]).astype(np.uint64) << _U(63 - k)
        diagonal = (((match & up) + up) ^ up) | match | down
        right, left = down | ~(diagonal | up), diagonal & up
        slant = i < n - tau
        step = np.where(slant, (diagonal >> _U(63)) == 0, ((right & flat) != 0).astype(np.int64) - ((left & flat) != 0))
        distance += np.where(i < m, step, 0)
        flat = np.where(slant, flat, flat >> _U(1))
        up, down = left | ~((diagonal >> _U(1)) | right), (diagonal >> _U(1)) & right
    out[rows] = distance <= tau
    return out


def _trimmed(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without what they begin and end with alike; their distance stays."""
    m = min(len(x), len(y))
    apart = np.flatnonzero(x[:m] != y[:m])
    if not len(apart):
        return x[m:], y[m:]
    head = int(apart[0])
    apart = np.flatnonzero(x[len(x) - m :] != y[len(y) - m :])
    tail = min(m - 1 - int(apart[-1]) if len(apart) else m, m - head)
    return x[head : len(x) - tail], y[head : len(y) - tail]


def alike(texts: list[pa.Array], edits: Tolerance) -> np.ndarray:
    """Whether each pair of normal lines is within the tolerance of the shorter one."""
    data, offsets = _binary(pa.concat_arrays(texts))
    start, end, place = tokens(data, offsets)
    body, at = data[data != 32], np.concatenate([[0], np.cumsum(end - start)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(body)])
    code = words.dictionary_encode().indices.to_numpy()
    half = len(texts[0])
    n = np.diff(place)
    allowed = edits.of(np.minimum(n[:half], n[half:]))
    pairs = [_trimmed(code[place[k] : place[k + 1]], code[place[half + k] : place[half + k + 1]]) for k in range(half)]
    size = np.array([max(len(x), len(y)) for x, y in pairs], np.int64)
    # What is left differs at both ends, so that one edit is not enough for two words and more.
    out = size <= allowed
    todo = np.flatnonzero((allowed > 1) & ~out)
    todo = todo[np.argsort(size[todo])]
    while len(todo):  # as many side by side as memory is set aside for
        fit = max(1, int(np.searchsorted(size[todo] * np.arange(1, len(todo) + 1), _SIDE, "right")))
        mine, todo = todo[:fit], todo[fit:]
        out[mine] = within([pairs[k][0] for k in mine], [pairs[k][1] for k in mine], 2)
    return out & (allowed > 0)


def _verify(edits: Tolerance):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array(alike([batch.column(2), batch.column(3)], edits)) if batch.num_rows else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(ok) for c in batch.columns[:2]], ["a", "b"])

    return run


# --- the join ----------------------------------------------------------------------------


def _candidates(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes by id8 that share a key with another, one of the two indexed there.

    Those of keys of two classes as pairs (id, other); and all as (id8, more), more where a
    key has others besides.
    """
    probes = found.where(F.size("probes") > 0).select(F.col("id8").alias("id"), F.explode("probes").alias("probe"))
    keys = probes.select(F.col("probe").bitwiseAND(F.lit(-2)).alias("block"), "id", F.col("probe").bitwiseAND(F.lit(1)).alias("own"))
    # A line of repeated words, or with copies, may have a key twice: such a block has no other line.
    many = keys.groupBy("block").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("own").alias("any"))
    many = keep(many.where("lo < hi and any = 1").select("block"), "line-keys")
    rows = keep(keys.join(sized(many), "block", "left_semi").select("block", "id").distinct(), "line-asks")
    each = rows.groupBy("block").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n"))
    pairs = keep(each.where("n = 2").select(F.col("lo").alias("id"), F.col("hi").alias("other")).distinct(), "line-twos")
    more = rows.join(each.where("n > 2").select("block"), "block", "left_semi").select(F.col("id").alias("id8"), F.lit(True).alias("more"))
    two = pairs.select(F.explode(F.array("id", "other")).alias("id8"), F.lit(False).alias("more"))
    return pairs, keep(more.union(two).groupBy("id8").agg(F.max("more").alias("more")), "line-ids")


def _linked(rows: DataFrame, found: DataFrame, edits: Tolerance) -> DataFrame | None:
    """(id, component) of classes that links join; None without links."""
    with scratch(rows.sparkSession) as stay:
        pairs, ids = _candidates(found.select("id8", "probes"))
        if ids.isEmpty():
            return None
        # One place of each class is read again.
        wanted = keep(found.join(ids, "id8").groupBy("id", "id8", "more").agg(F.min("place").alias("place")), "line-wanted")
        texts = rows.mapInArrow(_fetch(Bloom(wanted, F.col("place"))), "id binary, text binary").join(wanted.select("id", "more"), "id")
        texts = keep(texts.groupBy("id", "more").agg(F.first("text").alias("text")), "line-texts")
        names = wanted.select("id8", F.col("id").alias("name"))
        twos = pairs.join(names.withColumnsRenamed({"id8": "id", "name": "a"}), "id").join(names.withColumnsRenamed({"id8": "other", "name": "b"}), "other")
        twos = keep(twos.select(F.col("a").alias("id"), F.col("b").alias("other")), "line-twos")
        stay += [texts, twos]

    def verify(pairs: DataFrame) -> DataFrame:
        one = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
        two = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
        return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(_verify(edits), "a binary, b binary")

    stars, pairs = Stars(verify, "line"), twos
    level, source = partial(_first_level, edits), texts.where("more").select("id", "text")
    while True:
        # The gaps are made once the blocks of two lines and more are known.
        names = source.mapInArrow(level(_names), _NAMES)
        many = names.groupBy("block").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("centre").alias("any"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
        few = (F.col("n") <= _FEW) & (F.col("bytes") <= _FEW_BYTES)
        many = keep(many.where("lo < hi and any").select("block", few.alias("few")), "line-many")
        if many.isEmpty():
            if pairs is not None:
                stars.compare(pairs)
            return stars.found
        blocks = source.mapInArrow(level(), _BLOCKS)
        blocks = keep(blocks.join(sized(many), "block"), "line-level")
        small = blocks.where("few").groupBy("block").agg(F.collect_list(F.struct("id", "centre", "gaps")).alias("members"))
        with arrow_rows(rows.sparkSession, 8):
            links = keep(small.select("members").mapInArrow(_finish, "id binary, other binary"), "line-finished")
        # Verified outside: there a batch has as many pairs as usual.
        stars.compare(links if pairs is None else links.union(pairs))
        if many.where("not few").isEmpty():
            return stars.found
        left = stars.open(stars.turn(blocks.where("not few").drop("few")))
        source, level, pairs = keep(left.where(F.size("gaps") > 0).select("block", "id", "gaps"), "line-left"), _next_level, None


def _classes(docs: DataFrame, edits: Tolerance = Tolerance(), short: bool = False) -> DataFrame:
    """(doc_id, h, line, bytes, name, copies) of every line; name is (doc_id, line, h) of its class's first."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull())
    found = keep(rows.mapInArrow(_read(edits, short), _LINES), "lines")
    places = found.select("doc_id", "h", "line", "bytes", "id")
    with scratch(docs.sparkSession) as stay:
        linked = _linked(rows, found, edits)
        # Lines of which there is one, and which are linked with none, name themselves.
        some = found.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
        if linked is None:
            some = some.withColumn("part", F.col("id"))
        else:
            some = some.join(linked, "id", "full").select("id", F.coalesce("component", "id").alias("part"))
        some = keep(some, "line-parts")
        names = places.join(some, "id").groupBy("part").agg(F.min(F.struct("doc_id", "line", "h")).alias("name"), F.count(F.lit(1)).alias("copies"))
        some = keep(some.join(names, "part").select("id", "name", "copies"), "line-some")
        stay.append(some)
    out = places.join(some, "id", "left")
    return out.select("doc_id", "h", "line", "bytes", F.coalesce("name", F.struct("doc_id", "line", "h")).alias("name"), F.coalesce("copies", F.lit(1)).alias("copies"))


def line_classes(docs: DataFrame, edits: Tolerance = Tolerance(), short: bool = False) -> DataFrame:
    """(doc_id, line, bytes, class_doc_id, class_line, copies, kept) of every line that is compared.

    docs: doc_id long, text string; other columns are ignored. A line is what stands
    between line breaks, without ASCII white space at its ends, with A-Z in lower case and
    runs of white space as one space; blank ones are left out. Words are runs of what is no
    white space; characters of three bytes or more are words by themselves. Two lines are
    linked if they are equal, or if the shorter has a tolerance (``edits``) and at most so
    many words are inserted, deleted or replaced. Lines without a tolerance are not
    returned, or with ``short`` in classes of equal lines. line counts from 0 in the text. A
    class is what links reach, and its first line by (doc_id, line) is its name
    (class_doc_id, class_line). copies counts the lines of the class, kept says whether the
    row is the first. Null or empty text has no lines, and rows without a doc_id take no
    part. Lines of repeated rows are copies, those with the place of the first are kept too;
    rows that repeat a doc_id with another text have lines of their own. An empty table has
    none.
    """
    found = _classes(docs, edits, short)
    kept = F.col("name") == F.struct("doc_id", "line", "h")
    return found.select("doc_id", "line", "bytes", F.col("name.doc_id").alias("class_doc_id"), F.col("name.line").alias("class_line"), "copies", kept.alias("kept"))


def without_repeats(docs: DataFrame, rest: bool = False, **options) -> DataFrame:
    """docs without the lines that are not kept (see ``line_classes``).

    A document that loses lines and keeps no line that was compared goes altogether; with
    ``rest`` it goes only if nothing but white space is left of it. Documents that lose
    nothing, and rows without a doc_id or without text, stay as they are. Rows that repeat
    a doc_id lose what repeats in their own text; rows that repeat doc_id and text both
    keep what the first of them keeps. Columns stay, and n_chars, if there is one, counts
    the new text. An empty table stays empty.
    """
    doc, h, lost, some = (unused(docs, c) for c in ("lost_doc", "lost_text", "lost_lines", "lost_some"))
    kept = F.col("name") == F.struct("doc_id", "line", "h")
    gone = F.collect_set(F.when(~kept, F.col("line").cast("int")))
    each = _classes(docs, **options).groupBy(F.col("doc_id").alias(doc), F.col("h").alias(h)).agg(gone.alias(lost), F.max(kept).alias(some))
    same = (docs["doc_id"].cast("long") == F.col(doc)) & (F.xxhash64(docs["text"].cast("string")) == F.col(h))
    out = docs.join(each.where(F.size(lost) > 0), same, "left")
    left = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(lost, i))
    whole = F.col(lost).isNull()
    text = F.when(whole, F.col("text")).otherwise(F.array_join(left, "\n"))
    out = out.where(whole | text.rlike(r"[^\x20\x09-\x0D]") if rest else F.coalesce(some, F.lit(True)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length(text).cast("long")))
    return out.withColumn("text", text).select(*docs.columns)
