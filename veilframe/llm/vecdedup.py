"""Near-duplicate vectors by PCA-ordered tiled comparison.

1. Equal vectors of a label collapse to one class with a count.
2. The second moments of all unit vectors, summed on the executors, give an orthonormal
   basis in order of variance. Rotation keeps every inner product. Each length of vectors has
   a basis; as many as ``MOST_BYTES`` hold are sent to tasks at a time.
3. Vectors within ``cosine >= t`` differ by ``sqrt(2 - 2t)`` at most in each coordinate.
   Leading coordinates, cut at that width, are cells: links lie inside a cell or between
   touching ones. There are two of them, or more as long as that leaves fewer products to
   make. A full cell is cut by hash into tiles of about ``tile`` rows.
4. A pair of tiles adds up leading coordinates first. What is missing from a product is
   at most the product of the suffix norms; a pair stops when it cannot reach t.
5. A pair of tiles returns, for each of its vectors, a link count and the least vector
   that its links reach here: at most a row a vector, however many links there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm._store import keep, sized
from veilframe.llm._vectors import arrow_rows, finite, matrix, packed, tiles
from veilframe.llm.graph import components

_MARGIN = 1e-9
_MOST_COORDINATES = 6
#: Bases of lengths that are sent to tasks together.
MOST_BYTES = 1 << 26


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        sizes = np.asarray(batch.column(0))
        for d in np.unique(sizes):
            x = np.stack([v.values.to_numpy() for v, n in zip(batch.column(1), sizes, strict=True) if n == d])
            total[d] = total.get(d, 0) + x.T @ x
    for d, m in total.items():
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array((i * d + j).astype(np.int32)), pa.array(m[i, j])], ["d", "at", "value"])


def touching(k: int) -> list[tuple[int, ...]]:
    """Half of the steps to the cells that touch one, itself first."""
    return [(0,) * k, *[c for c in product((-1, 0, 1), repeat=k) if c > (0,) * k]]


def groups(lengths: list[int]) -> Iterator[tuple[int, ...]]:
    """Lengths in order, together as long as their bases fit ``MOST_BYTES``."""
    group: list[int] = []
    for d in sorted(lengths):
        if group and 8 * sum(x * x for x in (*group, d)) > MOST_BYTES:
            yield tuple(group)
            group = []
        group.append(d)
    if group:
        yield tuple(group)


def basis(moments: DataFrame, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """For each of these lengths d, the d x d eigenvectors of the second moments (d, at, value)."""
    rows = moments.where(F.col("d").between(lengths[0], lengths[-1])).toArrow()  # half of ``MOST_BYTES``, or one length's
    size, at, value = (rows[c].to_numpy() for c in ("d", "at", "value"))
    out = {}
    for d in lengths:
        mine, half = size == d, np.zeros(d * d)
        half[at[mine]] = value[mine]
        out[d] = np.linalg.eigh(half.reshape(d, d), UPLO="U")[1][:, ::-1].copy()
    return out


def pair_links(a: np.ndarray, b: np.ndarray, t: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of a and j of b (rotated unit vectors) with a product of t or more."""
    d = a.shape[1]
    steps = [s for s in (8, 16, 32, 64, 128, 256, 512, 1024) if s < d] + [d]
    tail = lambda x, k: np.sqrt(np.einsum("ij,ij->i", x[:, k:], x[:, k:]))
    k = steps[0]
    part = a[:, :k] @ b[:, :k].T
    hit = part + tail(a, k)[:, None] * tail(b, k)[None, :] >= t - _MARGIN
    if same:
        hit = np.triu(hit, 1)
    i, j = np.nonzero(hit)
    part = part[i, j]
    for k, to in zip(steps, steps[1:], strict=False):
        for lo in range(0, len(i), 1 << 16):
            at = slice(lo, lo + (1 << 16))
            part[at] += np.einsum("ij,ij->i", a[i[at], k:to], b[j[at], k:to])
        go = part + tail(a, to)[i] * tail(b, to)[j] >= t - _MARGIN
        i, j, part = i[go], j[go], part[go]
    return i, j


def _compare(bases: dict[int, np.ndarray], t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, x, y in zip(batch.column(0).to_pylist(), tiles(batch.column(1)), tiles(batch.column(2)), strict=True):
                one, two = matrix(x, "unit", np.float64), matrix(y, "unit", np.float64)
                turn = bases[one.shape[1]]
                i, j = pair_links(one @ turn, two @ turn, t, same)
                exact = np.einsum("ij,ij->i", one[i], two[j]) >= t  # as given, without the rotation
                i, j = i[exact], j[exact]
                if not len(i):
                    continue
                ids = np.concatenate([np.asarray(x.field("rep")), np.asarray(y.field("rep"))])
                copies = np.concatenate([np.asarray(x.field("n")), np.asarray(y.field("n"))])
                j = j + (0 if same else len(one))
                links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
                root = ids.copy()
                while True:  # least reachable id inside this pair of tiles
                    least = np.minimum(root[i], root[j])
                    new = root.copy()
                    np.minimum.at(new, i, least)
                    np.minimum.at(new, j, least)
                    if (new == root).all():
                        break
                    root = new
                on = np.flatnonzero(links)
                yield pa.RecordBatch.from_pydict({"rep": pa.array(ids[on]), "links": pa.array(links[on].astype(np.int64)), "root": pa.array(root[on])})

    return run


def _place(bases: dict[int, np.ndarray], width: float):
    """Adds cell, the places of the leading coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, units = np.asarray(batch.column("d")), batch.column("unit")
            cell = np.zeros((len(sizes), _MOST_COORDINATES), np.int64)
            for d in np.unique(sizes):
                at, turn = np.flatnonzero(sizes == d), bases[d][:, :_MOST_COORDINATES]
                x = units.take(pa.array(at)).flatten().to_numpy().reshape(-1, d)
                cell[at, : turn.shape[1]] = np.floor(x @ turn / width)
            places = pa.ListArray.from_arrays(np.arange(len(sizes) + 1, dtype=np.int32) * _MOST_COORDINATES, pa.array(cell.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, places], [*batch.schema.names, "cell"])

    return run


def _cells(out: DataFrame, tile: int) -> DataFrame:
    """The rows with as much of their cell as makes for the least work.

    Each coordinate more makes cells smaller, and three times as many touch. The number of
    coordinates is the one, of two to ``_MOST_COORDINATES``, with the fewest products: the
    sum of squares over cells, and what sending each row to the cells that touch costs.
    """
    best, least = 2, math.inf
    for k in range(2, _MOST_COORDINATES + 1):
        sizes = out.groupBy("label", "d", F.slice("cell", 1, k).alias("cell")).agg(F.count(F.lit(1)).cast("double").alias("n"))
        square, rows = sizes.agg(F.sum(F.col("n") * F.col("n")), F.sum("n")).first()
        cost = (square or 0) * 3**k / 2 + (rows or 0) * len(touching(k)) * tile
        if cost >= least:
            break
        best, least = k, cost
    return out.withColumn("cell", F.slice("cell", 1, best))


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.98, tile: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors.

    vectors: vec_id, embedding (array of numbers), label; other columns are ignored. Two
    rows are linked if their labels are equal, their vectors equally long and the cosine
    in double precision is at least ``cosine``. Equal vectors of a label are always
    linked. Null, empty and zero vectors, and those that hold a null or non-finite
    component, and rows without a label link with nothing: n_links 0, component_id their
    own vec_id, kept. n_links counts other rows, repeated ones too; rows that repeat a vec_id
    with another vector each have the links of their own. An empty table gives an empty
    result.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    top = F.array_max(F.transform("v", F.abs))
    ok = finite(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (top > 0)
    v = v.withColumn("v", F.when(ok, F.transform("v", lambda x: x + F.lit(0.0))))  # -0.0 is 0.0
    v = v.withColumn("h1", F.when(F.col("v").isNotNull(), F.xxhash64("v", "label"))).withColumn("h2", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(7), "label", "v")))
    rows = keep(v, "vectors")
    classes = rows.where("v is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"), F.first("label").alias("label"))
    scaled = F.transform("v", lambda x: x / F.array_max(F.transform("v", F.abs)))
    classes = classes.withColumn("v", scaled).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    unit = classes.select("h1", "h2", "rep", "n", "label", F.size("v").alias("d"), F.transform("v", lambda x: x / F.col("norm")).alias("unit"))
    unit = keep(unit, "units")
    together = list(groups([r.d for r in unit.select("d").distinct().collect()]))  # a number a length
    width = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6
    out = rows.select("vec_id", "h1", "h2")
    if not together:
        none = {"n_links": F.lit(0).cast("long"), "component_id": F.col("vec_id"), "kept": F.lit(True)}
        return out.select("vec_id").withColumns(none)
    moments = unit.select("d", "unit").mapInArrow(_moments, "d int, at int, value double").groupBy("d", "at").agg(F.sum("value").alias("value"))
    moments = keep(moments, "moments")
    bases = lru_cache(1)(lambda lengths: basis(moments, lengths))  # of one group of lengths at a time

    def of(rows: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
        return rows.where(F.col("d").between(lengths[0], lengths[-1]))

    kind = T.StructType([*unit.schema.fields, T.StructField("cell", T.ArrayType(T.LongType()))])
    placed = [keep(of(unit, g).mapInArrow(_place(bases(g), width), kind), "placed") for g in together]
    placed = _cells(reduce(DataFrame.union, placed), tile)
    # A row for each cell; a full cell is dealt by hash into parts.
    count = placed.groupBy("label", "d", "cell").agg(F.ceil(F.count(F.lit(1)) / tile).alias("parts"))
    count = sized(keep(count, "cells"))
    placed = placed.join(count, ["label", "d", "cell"]).withColumn("sub", F.pmod(F.xxhash64("rep"), "parts"))
    own = ["label", "d", "cell", "sub"]
    tiled = keep(packed(placed.repartition(*own), own, ["rep", "n", "unit"], "members"), "tiles")
    depth = len(placed.select("cell").first().cell) if not placed.isEmpty() else 0
    steps = F.array(*[F.array(*[F.lit(x).cast("long") for x in s]) for s in touching(depth)])
    # A key for each pair of tiles, so that those of a full cell do not all meet in one place.
    step = tiled.select(*own, F.posexplode(steps).alias("at", "step")).withColumn("cell_", F.zip_with("cell", "step", lambda a, b: a + b))
    to = count.select("label", "d", F.col("cell").alias("cell_"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("sub_"))
    keys = step.join(to, ["label", "d", "cell_"]).where("at > 0 or sub <= sub_")
    one = tiled.withColumnRenamed("members", "left")
    two = tiled.select("label", "d", F.col("cell").alias("cell_"), F.col("sub").alias("sub_"), "members")
    pairs = keys.join(one, own).join(two, ["label", "d", "cell_", "sub_"])
    pairs = pairs.select(((F.col("at") == 0) & (F.col("sub") == F.col("sub_"))).alias("same"), "left", "members", "d")
    with arrow_rows(spark, 4):
        found = [keep(of(pairs, g).drop("d").mapInArrow(_compare(bases(g), cosine), "rep long, links long, root long"), "vector-links") for g in together]
    found = reduce(DataFrame.union, found)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "vectors")
    classes = unit.select("h1", "h2", "rep", "n").join(links, "rep", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    classes = classes.select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = out.join(classes, ["h1", "h2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
