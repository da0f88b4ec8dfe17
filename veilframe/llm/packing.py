"""Packing documents into sequences: shortest pack first over the length histogram.

1. Every text is tokenized once, and cut into pieces of a full sequence and a rest.
   What is kept of a piece is its place, length and checksum.
2. The rests' lengths make a histogram of at most ``size - 1`` numbers. On the driver
   they are placed from the longest down, each number of equal lengths at once, into the
   pack with most room; that changes the counts of packing patterns and nothing else, so
   the work does not grow with the number of documents.
3. Rests of one length are ranked, and ranges of ranks joined to the slots of the
   patterns. Ranks come from counts of salted groups, so that a length that a third of
   all documents have is not one task's work.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm import _text
from veilframe.llm._store import keep
from veilframe.llm._tokens import encoder

#: Pieces that are ranked together, about. Their groups are counted in one task for each
#: length: 2.5e7 rows of three numbers at 100 TB of documents.
_GROUP = 1_000
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, tie long"


def _cut(path: str, size: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, end)
        for batch in batches:
            for lo, _, data, offsets in _text.text_chunks(batch.column(1), 1 << 21):
                ids, ends = encode(data, offsets)
                raw = memoryview(ids.astype("<u4").tobytes())
                whole = np.diff(ends)
                pieces = -(-whole // size)
                doc = np.repeat(np.arange(len(whole)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * size
                length = np.minimum(size, whole[doc] - start)
                at = (ends[:-1][doc] + start) * 4
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
                rows = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(whole[doc]), batch.column(2).take(rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "tie"])

    return run


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths, longest first) and how often each is filled."""
    room: dict[int, Counter] = {}  # room left -> patterns
    rooms: list[int] = []  # as a heap, most room first

    def put(left: int, pattern: tuple[int, ...], n: int) -> None:
        if left not in room:
            room[left] = Counter()
            heapq.heappush(rooms, -left)
        room[left][pattern] += n

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            while rooms and not room.get(-rooms[0]):
                room.pop(-heapq.heappop(rooms), None)
            if not rooms or -rooms[0] < length:
                # A new pack has most room until it is full.
                fit = size // length
                for copies, packs in ((fit, n // fit), (n % fit, 1)):
                    if copies and packs:
                        put(size - copies * length, (length,) * copies, packs)
                break
            left = -rooms[0]
            pattern, have = next(iter(room[left].items()))
            use = min(n, have)
            n -= use
            if use == have:
                del room[left][pattern]
            else:
                room[left][pattern] -= use
            put(left - length, (*pattern, length), use)
    return [(p, n) for left in sorted(room) for p, n in sorted(room[left].items()) if n]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, copies, offset) of each run of slots.

    A run stands for a length in all sequences of a pattern: ``copies`` slots side by side in
    each, which the ranks fill one sequence after another.
    """
    out, taken, sequence = [], Counter(), 0
    for pattern, n in patterns:
        offset = 0
        for length, copies in Counter(pattern).items():  # equal lengths stand together
            out.append((length, taken[length], n * copies, sequence, copies, offset))
            taken[length] += n * copies
            offset += length * copies
        sequence += n
    return out


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 1) -> DataFrame:
    """A row for each piece of a document: where it lies in which sequence.

    docs: doc_id long, text string; other columns are ignored. A document's ids are
    those of its text by the tokenizer file, without special tokens, and ``end`` after
    them; null or empty text has ``end`` alone. Pieces cover each id once. doc_id, start
    (the document's ids before the piece), length, ids_crc32 (of little-endian unsigned
    32-bit ids), doc_tokens, sequence_id, offset (in the sequence, gapless from 0) and
    padded (the sequence's length with padding: ``size``, or what it holds if that is a
    power of two). Rows without a doc_id and repeated rows are packed like any other. An
    empty table has no pieces.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("doc_id", F.length("text")))
    pieces = keep(rows.mapInArrow(_cut(tokenizer, size, end), _PIECES), "packing-pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # ``size`` lengths at most
    patterns = [((size,), counts[size])] if size in counts else []
    patterns += shortest_pack_first({k: n for k, n in counts.items() if k != size}, size)
    runs = slots(patterns)
    schema = "length long, first_rank long, ranks long, first_sequence long, copies long, offset long, held long"
    held = [sum(p) for p, _ in patterns for _ in set(p)]
    table = spark.createDataFrame([(*r, h) for r, h in zip(runs, held, strict=True)], schema) if runs else spark.createDataFrame([], schema)

    # Ranks within a length, from 0: groups of about _GROUP pieces, dealt by hash. What is
    # broadcast has a row for each length, ``size`` at most.
    parts = F.broadcast(spark.createDataFrame([(k, max(1, -(-n // _GROUP))) for k, n in sorted(counts.items())], "length long, parts long"))
    dealt = pieces.join(parts, "length").withColumn("group", F.pmod("tie", "parts"))
    before = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = dealt.groupBy("length", "group").agg(F.count(F.lit(1)).alias("n"))
    groups = groups.select("length", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "group").orderBy("tie", "doc_id", "start", "ids_crc32")
    dealt = dealt.repartition("length", "group").withColumn("rank", F.row_number().over(order) - 1).join(groups, ["length", "group"])
    dealt = dealt.withColumn("rank", F.col("rank") + F.col("before"))
    # The runs of a length cover its ranks without gaps: the run of a rank is found in
    # the sorted list of their first ranks.
    lists = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first_rank", "first_sequence", "copies", "offset", "held"))).alias("runs"))
    found = F.element_at(F.filter("runs", lambda r: r["first_rank"] <= F.col("rank")), -1)
    out = dealt.join(F.broadcast(lists), "length").withColumn("run", found)
    place = F.col("rank") - F.col("run.first_rank")
    sequence = F.col("run.first_sequence") + F.floor(place / F.col("run.copies"))
    offset = F.col("run.offset") + F.pmod(place, F.col("run.copies")) * F.col("length")
    whole = F.col("run.held")
    padded = F.when(whole.bitwiseAND(whole - 1) == 0, whole).otherwise(F.lit(size).cast("long"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence.alias("sequence_id"), offset.alias("offset"), padded.alias("padded"))
