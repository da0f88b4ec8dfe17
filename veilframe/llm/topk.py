"""Exact top-k by inner product of integer vectors: MaxScore over shards.

A dimension is a term and a query's component its weight. A shard holds about
``shard`` rows and knows each term's least and largest value, so each term's share of a
score is bounded. A block of queries meets a shard with the terms in order of that
bound. With a threshold from some full scores, the terms from some place on could not
lift a row to it by themselves: those before are *essential*. Their columns are added up
for all rows of the shard. The other terms are probed a few at a time, only for rows that
can still reach the threshold (the product of the norms of what is left bounds it too, and
the smaller bound counts), or for all rows as long as many can. Rows equal to the threshold
stay, so ties are exact. The shards' best are merged by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm._store import keep
from veilframe.llm._vectors import arrow_rows, finite, matrix, packed, tiles

_PROBE = 8
_PAIRS = 1 << 16
_TOGETHER = 128
#: Share of rows from which on terms are added up for all of them.
_MANY = 0.05


def _products(queries: np.ndarray, rows: np.ndarray, i: np.ndarray, j: np.ndarray, terms: slice) -> np.ndarray:
    out = np.empty(len(i), rows.dtype)
    for lo in range(0, len(i), _PAIRS):
        at = slice(lo, lo + _PAIRS)
        out[at] = np.einsum("ij,ij->i", queries[i[at], terms], rows[j[at], terms])
    return out


def _tail(x: np.ndarray, start: int) -> np.ndarray:
    """Norms of what is left of each row, a little more to be safe from rounding."""
    return np.sqrt(np.einsum("ij,ij->i", x[:, start:], x[:, start:])) * x.dtype.type(1.001)


def maxscore(queries: np.ndarray, rows: np.ndarray, barred: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, row, score) that hold the k best rows of each query, ties included, and the products made.

    barred: queries x rows, what may not be returned.
    """
    low, high = rows.min(axis=0), rows.max(axis=0)
    most, least = np.maximum(queries * low, queries * high), np.minimum(queries * low, queries * high)
    order = np.argsort(-(most - least).sum(axis=0), kind="stable")  # one order of terms for the block
    queries, rows, d = np.ascontiguousarray(queries[:, order]), np.ascontiguousarray(rows[:, order]), len(order)
    # What the terms from each place on can add at most.
    rest = np.zeros((len(queries), d + 1), rows.dtype)
    rest[:, :-1] = np.cumsum(most[:, order][:, ::-1], axis=1)[:, ::-1]
    slack = np.zeros_like(rest)
    slack[:, :-1] = np.cumsum((most - least)[:, order][:, ::-1], axis=1)[:, ::-1]
    enough = min(k, rows.shape[0])
    few = min(4 * k, rows.shape[0])
    seeds = np.where(barred[:, :few], -np.inf, queries @ rows[:few].T)
    bar = np.partition(seeds, -enough, axis=1)[:, -enough]
    made = few * len(queries) * d
    # Essential terms: without them no row rises from the least total to the bar.
    cuts = np.clip((slack > (bar - least.sum(axis=1))[:, None]).sum(axis=1), 1, d)
    found = []
    by = np.argsort(cuts, kind="stable")
    for mine in np.array_split(by, max(1, len(by) // _TOGETHER)):  # queries with about as many essential terms
        if not len(mine):
            continue
        cut, q = int(cuts[mine].max()), queries[mine]
        part = np.where(barred[mine], -np.inf, q[:, :cut] @ rows[:, :cut].T)
        made += part.size * cut
        best = np.argpartition(part, -few, axis=1)[:, -few:]
        i = np.repeat(np.arange(len(mine)), few)
        full = (part[i, best.reshape(-1)] + _products(q, rows, i, best.reshape(-1), slice(cut, None))).reshape(best.shape)
        made += full.size * (d - cut)
        line = np.maximum(bar[mine], np.partition(full, -enough, axis=1)[:, -enough])

        def competes(place: int) -> np.ndarray:
            reach = np.minimum(rest[mine, place][:, None], _tail(q, place)[:, None] * _tail(rows, place))
            return ~barred[mine] & (part >= line[:, None] - reach)

        go = competes(cut)
        while cut < d and go.mean() > _MANY:  # most rows compete: the next terms for all of them
            to = min(cut + _PROBE, d)
            part += q[:, cut:to] @ rows[:, cut:to].T
            made += part.size * (to - cut)
            cut = to
            go = competes(cut)
        i, j = np.nonzero(go)
        score = part[i, j]
        while cut < d and len(i):
            to = min(cut + _PROBE, d)
            score = score + _products(q, rows, i, j, slice(cut, to))
            made += len(i) * (to - cut)
            on = score >= line[i] - np.minimum(rest[mine[i], to], _tail(q, to)[i] * _tail(rows, to)[j])
            i, j, score, cut = i[on], j[on], score[on], to
        found.append((mine[i], j, score))
    i, j, score = (np.concatenate(x) for x in zip(*found, strict=True))
    return i, j, score, made


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, held in zip(tiles(batch.column(0)), tiles(batch.column(1)), strict=True):
                q, x = matrix(asked, "v", np.int64), matrix(held, "v", np.int64)
                reach = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
                # Sums of whole numbers are exact in floating point up to here.
                kind = np.float32 if reach < 2**22 else np.float64 if reach < 2**51 else np.longdouble
                ids, names = np.asarray(held.field("vec_id")), np.asarray(asked.field("vec_id"))
                i, j, score, _ = maxscore(q.astype(kind), x.astype(kind), names[:, None] == ids[None, :], k)
                score = (q[i] * x[j]).sum(axis=1) if kind is np.longdouble else score.astype(np.int64)
                order = np.lexsort((ids[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                first = np.searchsorted(i, i, "left")
                top = np.arange(len(i)) - first < k
                yield pa.RecordBatch.from_arrays([pa.array(names[i[top]]), pa.array(ids[j[top]]), pa.array(score[top])], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64, shard: int = 4096, block: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query row.

    vectors: vec_id, embedding; other columns are ignored. queries: a condition on
    vec_id. A component x counts as floor(scale * x), x as double; the score is the
    integer inner product, ties go to the smaller vec_id, and rows of the query's own
    vec_id are left out. Vectors that are null or hold null or non-finite components,
    and rows without a vec_id, take no part; vectors are compared with those of equal
    length. A query with fewer candidates has fewer rows, and an empty table none. Of
    repeated rows each is a candidate; a repeated query is asked once, with the least of its
    vectors. Extra columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    v = v.where(F.col("vec_id").isNotNull()).where(finite(F.col("x"))).where(F.size("x") > 0)
    v = keep(v.select("vec_id", F.size("x").alias("d"), F.transform("x", lambda x: F.floor(x * scale)).alias("v")), "topk-rows")
    asked = v.where(queries).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))
    size = F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards")
    shards = v.groupBy("d").agg(size)
    held = v.join(shards, "d").withColumn("shard", F.pmod(F.xxhash64("vec_id"), "shards"))
    held = packed(held.repartition("d", "shard"), ["d", "shard"], ["vec_id", "v"], "held")
    blocks = asked.groupBy("d").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    asked = packed(asked.join(blocks, "d").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), "blocks")), ["d", "block"], ["vec_id", "v"], "asked")
    asked = asked.join(shards, "d").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("shard", F.col("shard").cast("long"))
    with arrow_rows(spark, 4):
        found = keep(asked.join(held, ["d", "shard"]).select("asked", "held").mapInArrow(_search(k), "query_id long, vec_id long, score long"), "topk-found")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
