"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is bound by multiplying
its letters' vectors, each permuted (rotated) by its place, and a text is the bundle
(sum) of its trigrams' vectors. A language's prototype is the bundle of all its training
texts; a text takes the language whose prototype has the largest cosine with it.

A chunk of texts is handled as counts of its distinct trigrams times their vectors, a block
of trigrams at a time, so that no vector is made for a letter of text and memory does not
grow with a chunk's trigrams. Bundles are whole numbers, and their sums
do not depend on order. Prototypes are ``dimensions`` numbers a language; where there are
very many languages they go to tasks in blocks, and a text takes the best of all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm._store import keep

_SYMBOLS = 1024
#: Languages whose prototypes go to tasks together, give or take what a hash deals to a block.
_MOST = 10_000
_CHARS = 1 << 18
#: Distinct trigrams, and counts of them in texts, that are held at a time.
_TRIGRAMS, _COUNTS = 2048, 1 << 22


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its symbol, 0 if it is no letter."""
    codes = np.arange(0x110000, dtype=np.uint32)
    symbol = np.where(codes < _SYMBOLS, codes, 1 + codes * np.uint32(2654435761) % np.uint32(_SYMBOLS - 1))
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return np.where(letter, symbol, 0).astype(np.int64)


@lru_cache(4)
def _vectors(dimensions: int) -> tuple[np.ndarray, ...]:
    """The symbols' vectors for the first, second and third letter of a trigram."""
    base = (np.random.default_rng(10_007).integers(0, 2, (_SYMBOLS, dimensions), dtype=np.int8) * 2 - 1).astype(np.int8)
    return tuple(np.roll(base, 2 - k, axis=1) for k in range(3))


def _trigram_vectors(codes: np.ndarray, dimensions: int) -> np.ndarray:
    a, b, c = _vectors(dimensions)
    return (a[codes >> 20] * b[(codes >> 10) & 1023] * c[codes & 1023]).astype(np.float32)


def profiles(texts: list[str], dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(bundle of each text, whether it has a letter)."""
    low = [t.lower() for t in texts]
    starts = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])])
    symbols = _letters()[np.frombuffer((" " + " ".join(low) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)]
    inside = symbols > 0
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # one gap after each word
    at = np.flatnonzero(keep)
    row = np.concatenate([[0], symbols[at], [0]])
    centre = np.flatnonzero(row[1:-1] > 0)
    codes = (row[centre] << 20) | (row[centre + 1] << 10) | row[centre + 2]
    doc = np.searchsorted(starts, at[centre], "right") - 1
    both, n = np.unique((doc << 30) | codes, return_counts=True)
    distinct, column = np.unique(both & ((1 << 30) - 1), return_inverse=True)
    kind = np.float32 if len(symbols) < 1 << 24 else np.float64  # sums stay whole numbers
    out = np.zeros((len(texts), dimensions), kind)
    order = np.argsort(column, kind="stable")
    doc, column, n = (both >> 30)[order], column[order], n[order]
    width = min(_TRIGRAMS, max(64, _COUNTS // max(1, len(texts))))
    for lo in range(0, len(distinct), width):
        mine = slice(*np.searchsorted(column, [lo, lo + width]))
        counts = np.zeros((len(texts), min(width, len(distinct) - lo)), kind)
        counts[doc[mine], column[mine] - lo] = n[mine]
        out += counts @ _trigram_vectors(distinct[lo : lo + width], dimensions)
    known = np.zeros(len(texts), bool)
    known[doc] = True
    return out, known


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about _CHARS characters together."""
    lo, size = 0, 0
    for k, t in enumerate(texts):
        if k > lo and size + len(t or "") > _CHARS:
            yield lo, [x or "" for x in texts[lo:k]]
            lo, size = k, 0
        size += len(t or "")
    if lo < len(texts):
        yield lo, [x or "" for x in texts[lo:]]


def _learn(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for lo, texts in _pieces(batch.column(0).to_pylist()):
                vectors, _ = profiles(texts, dimensions)
                mine = langs[lo : lo + len(texts)]
                for lang in set(mine):
                    total[lang] = total.get(lang, 0) + vectors[mine == lang].sum(axis=0, dtype=np.float64)
        for lang, v in total.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * dimensions), "at": pa.array(range(dimensions), pa.int32()), "value": pa.array(v.astype(np.int64))})

    return run


def prototypes(train: DataFrame, dimensions: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """Blocks of the learned languages, in order, and their unit prototypes."""
    parts = train.select("text", "lang").mapInArrow(_learn(dimensions), "lang string, at int, value long")
    sums = parts.groupBy("lang", "at").agg(F.sum("value").alias("value"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"])
    table = keep(sums.groupBy("lang").agg(whole.alias("sums")), "languages")
    blocks = -(-table.count() // _MOST)
    for k in range(blocks):
        mine = table.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == k).toArrow()
        if not mine.num_rows:
            continue
        found = mine["lang"].to_pylist()
        order = sorted(range(len(found)), key=found.__getitem__)
        flat = mine["sums"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        out = flat.reshape(len(found), dimensions)[order].astype(np.float64)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        yield [found[k] for k in order], np.divide(out, norm, out=np.zeros_like(out), where=norm > 0).astype(np.float32)


def _predict(block: Broadcast):
    """(doc_id, held_out, text, lang, cosine) with the best of this block where it is better; lang is null before the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, unit = block.value
        for batch in batches:
            for lo, texts in _pieces(batch.column(2).to_pylist()):
                vectors, known = profiles(texts, unit.shape[1])
                norm = np.linalg.norm(vectors, axis=1, keepdims=True)
                cosine = np.divide(vectors @ unit.T, norm, out=np.zeros((len(texts), len(langs)), np.float32), where=norm > 0)
                best = cosine.argmax(axis=1)
                score = cosine[np.arange(len(texts)), best].astype(np.float64).tolist()
                rows = batch.slice(lo, len(texts))
                old = zip(rows.column(3).to_pylist(), rows.column(4).to_pylist(), strict=True)
                new = [(langs[b], s) if k and (lang is None or (-s, langs[b]) < (-was, lang)) else (lang, was) for (lang, was), k, b, s in zip(old, known, best, score, strict=True)]
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array([x[0] for x in new], pa.string()), pa.array([x[1] for x in new], pa.float64())], ["doc_id", "held_out", "text", "lang", "cosine"])

    return run


def identify(docs: DataFrame, held_out: Column, dimensions: int = 1024) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of documents.

    docs: doc_id long, text string, lang string; other columns are ignored. Languages
    are learned from text and lang of rows that have both and for which ``held_out``, a
    condition on doc_id, is false. lang_pred is the learned language with the largest
    cosine, ties to the first by code point; score is that cosine, 0 if negative. Texts
    that are null or have no letter, and all texts if nothing was learned: ``und``,
    score 0. Rows without a doc_id are not held out and teach nothing. Repeated rows
    each count. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    train = rows.where("not held_out and doc_id is not null and lang is not null and text is not null")
    none = {"lang": F.lit(None).cast("string"), "cosine": F.lit(None).cast("double")}
    out = rows.select("doc_id", "held_out", "text").withColumns(none)
    for block in prototypes(train, dimensions):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        out = out.mapInArrow(_predict(sent), "doc_id long, held_out boolean, text string, lang string, cosine double")
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("cosine", F.lit(0.0))))
    return out.select("doc_id", "held_out", F.coalesce("lang", F.lit("und")).alias("lang_pred"), score.alias("score"))
