"""Files cut by bytes and read record by record, whatever their records hold.

Spark's text source deals blocks of bytes to tasks, from any store, and reads whole lines of
each. What a line means depends on what stood before it: an open quote, bracket or comment.
So there is a grammar, a small automaton over lines, and three steps:

1. Each block is scanned from every state in which it could begin. This gives a function from
   states to states, and what it does to the depth of brackets.
2. The driver composes these functions, a few numbers a block, in the order of blocks. Now the
   state at the start of each block is known.
3. Each block is cut into records from there. What stands before its first cut and behind its
   last one belongs to records across edges: a piece or two a block, put together by a grouping.

Results do not depend on where blocks are cut.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.kept import keep

Step = tuple[int, bool, int, bool]  # state, whether depth begins anew, depth, whether a record may end here


class Grammar(Protocol):
    """States are 0, 1, ...; 0 is where a file begins."""

    states: int

    def line(self, state: int, text: str) -> Step: ...


class Delimited:
    """Records of delimited text: 0 is outside of quotes, 1 within. A quote opens only where a field begins."""

    states = 2

    def __init__(self, sep: str) -> None:
        s = re.escape(sep)
        quoted, rest = '"(?:[^"]++|"")*+"', f"[^{s}]*+"
        fields = f'(?:{quoted}{rest}|(?!"){rest})(?:{s}(?:{quoted}{rest}|(?!"){rest}))*+'
        self._from = (re.compile(fields, re.S), re.compile(f'(?:[^"]++|"")*+"{rest}(?:{s}{fields})?+', re.S))

    def line(self, state: int, text: str) -> Step:
        if '"' in text:
            m = self._from[state].match(text)
            state = 0 if m and m.end() == len(text) else 1
        return state, False, 0, state == 0


def lines_of(spark: SparkSession, path: str, code: str = "utf-8", end: str = "\n") -> DataFrame:
    """(block, value): the bytes of lines without their ends, and where their block of the file begins.

    The lines of a block come in order, and all of them in one task.
    """
    read = spark.read.option("lineSep", end)
    if code.startswith("utf-16"):
        read = read.option("encoding", code.upper().replace("-LE", "LE").replace("-BE", "BE"))
    return read.text(path).select(F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _texts(batch: pa.RecordBatch, code: str, end: str) -> Iterator[tuple[int, str]]:
    """(block, line with its end); the mark at the start of a file is taken off."""
    for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        text = raw.decode(code)
        yield block, (text.removeprefix("\ufeff") if block == 0 else text) + end


def _functions(grammar: Grammar, code: str, end: str):
    """Of each block and state at its start: the state at its end, the depth, and whether a line ended within a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[list]] = {}
        for batch in batches:
            for block, text in _texts(batch, code, end):
                at = found.setdefault(block, [[s, False, 0, False] for s in range(grammar.states)])
                done: dict[int, Step] = {}
                for x in at:
                    step = done.get(x[0]) or done.setdefault(x[0], grammar.line(x[0], text))
                    x[0], x[1], x[2] = step[0], x[1] or step[1], step[2] if step[1] else x[2] + step[2]
                    x[3] = x[3] or not step[3]
        rows = [(b, s, *x) for b, at in found.items() for s, x in enumerate(at)]
        names = ("block", "begin", "state", "anew", "depth", "open")
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], list(names))

    return run


@dataclass(frozen=True)
class Begins:
    """(state, depth) before and after the blocks that were scanned, in their order."""

    blocks: list[int]
    before: list[tuple[int, int]]
    after: list[tuple[int, int]]

    def of(self, block: int) -> tuple[int, int]:
        """How a block begins; one that was not scanned begins as the one before it ends."""
        k = bisect_left(self.blocks, block)
        if k < len(self.blocks) and self.blocks[k] == block:
            return self.before[k]
        return self.after[k - 1] if k else (0, 0)


def starts(lines: DataFrame, grammar: Grammar, code: str = "utf-8", end: str = "\n") -> tuple[Begins, bool]:
    """How blocks begin, and whether any line ends within a record.

    lines may leave out lines that change no state.
    """
    rows = lines.mapInArrow(_functions(grammar, code, end), "block long, begin int, state int, anew boolean, depth long, open boolean").toArrow()
    steps: dict[int, dict[int, tuple]] = {}
    for block, begin, *step in zip(*[rows[c].to_pylist() for c in rows.column_names], strict=True):
        steps.setdefault(block, {})[begin] = step
    state, depth, within = 0, 0, False
    out = Begins(sorted(steps), [], [])
    for block in out.blocks:
        out.before.append((state, depth))
        state, anew, change, open_ = steps[block][state]
        depth = change if anew else depth + change
        within = within or open_
        out.after.append((state, depth))
    return out, within


_PIECES = pa.schema([("block", pa.int64()), ("seq", pa.int64()), ("kind", pa.int32()), ("cut", pa.bool_()), ("text", pa.string())])
_BATCH = 1 << 22


class _Cutter:
    """Pieces of one block after another: kind 0 are whole records, 1 what stands up to the first cut, 2 what is behind the last."""

    def __init__(self, grammar: Grammar, begins: Begins, size: int) -> None:
        self.grammar, self.begins, self.size = grammar, begins, size
        self.block: int | None = None
        self.rows: list[tuple] = []
        self.ready = 0

    def flush(self, kind: int, cut: bool) -> None:
        self.rows.append((self.block, self.seq, kind, cut, "".join(self.held)))
        self.ready += self.n
        self.held, self.n, self.seq = [], 0, self.seq + 1

    def close(self) -> None:
        """At the end of a block."""
        if self.block is None:
            return
        if self.head:
            self.flush(1, False)
        elif self.held:
            self.flush(0 if self.whole else 2, self.whole)

    def add(self, block: int, text: str) -> None:
        if block != self.block:
            self.close()
            self.block, self.held, self.n, self.seq, self.head, self.whole = block, [], 0, 0, True, False
            self.state, self.depth = self.begins.of(block)
        self.held.append(text)
        self.n += len(text)
        self.state, anew, change, may = self.grammar.line(self.state, text)
        self.depth = change if anew else self.depth + change
        self.whole = may and self.depth == 0
        if self.whole and (self.head or self.n >= self.size):
            self.flush(1 if self.head else 0, True)
            self.head = False

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), _PIECES, strict=True)], schema=_PIECES)
        self.rows, self.ready = [], 0
        return out


def _cut(grammar: Grammar, sent, code: str, end: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(grammar, sent.value, size)
        for batch in batches:
            for block, text in _texts(batch, code, end):
                cutter.add(block, text)
                if cutter.ready > _BATCH or len(cutter.rows) >= 4096:
                    yield cutter.batch()
        cutter.close()
        if cutter.rows:
            yield cutter.batch()

    return run


def records(spark: SparkSession, path: str, grammar: Grammar, begins: Begins, code: str = "utf-8", end: str = "\n", size: int = 0) -> DataFrame:
    """(block, phase, seq, text): whole records with their ends, several in a row if they have less than ``size`` characters.

    In the order of these columns they are the file; block is -1 for the first of a file.
    """
    sent = spark.sparkContext.broadcast(begins)
    pieces = keep(lines_of(spark, path, code, end).mapInArrow(_cut(grammar, sent, code, end, size), "block long, seq long, kind int, cut boolean, text string"), "pieces")
    # The record that is open at the start of a block began behind the last cut before: one row a block.
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    owner = F.coalesce(F.last(F.when(F.col("cut"), F.col("block")), True).over(before), F.lit(-1).cast("long"))
    owners = pieces.where("kind = 1").select("block", "cut").withColumn("owner", owner).drop("cut")
    across = pieces.where("kind > 0").select("block", "kind", "text").join(owners, "block").withColumn("owner", F.when(F.col("kind") == 2, F.col("block")).otherwise(F.col("owner")))
    parts = F.array_sort(F.collect_list(F.struct("block", "text")))
    glued = across.groupBy("owner").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))
    whole = pieces.where("kind = 0").select("block", F.lit(0).alias("phase"), "seq", "text")
    return whole.union(glued.select(F.col("owner").alias("block"), F.lit(1), F.lit(0).cast("long"), "text"))
