"""Vector compression by whole-number product codes.

1. A component x becomes floor(scale * x), and a vector is cut into equal parts. A length
   that the number of parts does not divide is filled up with zeros at its end.
2. Each part position has a codebook. It begins with that part of the vectors with the
   smallest ids: the smallest of each partition meet, and no shuffle sees all ids.
3. A round sends the codebooks to all tasks. A batch makes all distances at once, as
   |x|^2 + |c|^2 - 2xc with an exact 64-bit matrix product, and takes the first least one.
   A partition returns sums and counts of its parts an entry; a grouped shuffle adds them
   up, and the driver sees the sums of codebooks only.
4. A last pass writes codes and errors, and errors are summed by label.

Codebooks in one broadcast have ``MOST_BYTES`` at most: with very many lengths of vectors
there are several, and as many passes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm._store import keep, looked_up

MOST_BYTES = 1 << 26
_LAST = np.iinfo(np.int64).max

Books = dict[int, np.ndarray]  # of a length: part x entry x place
Map = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _numbers(batch: pa.RecordBatch, parts: int, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows of the batch, their vectors as whole numbers) for each length of usable vectors."""
    column = batch.column("v")
    there = np.flatnonzero(np.asarray(pc.is_valid(column)))
    sizes = np.asarray(pc.list_value_length(column).drop_null(), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    begin = np.cumsum(sizes) - sizes
    for d in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == d)
        x = flat[begin[mine][:, None] + np.arange(d)]
        good = np.isfinite(x).all(1)
        if good.any():
            whole = np.zeros((int(good.sum()), -(-d // parts) * parts))
            whole[:, :d] = np.floor(x[good] * scale)
            yield d, there[mine[good]], whole


def _exact(whole: np.ndarray) -> np.ndarray:
    return whole.astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each row, and its squared distance."""
    square = lambda a: (a * a).sum(1)
    far = square(book)[None, :] - 2 * (x @ np.ascontiguousarray(book.T))
    code = far.argmin(1)
    return code, far[np.arange(len(x)), code] + square(x)


def _lengths(parts: int, scale: int) -> Map:
    """The lengths of vectors, and the largest whole number of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, float] = {}
        for batch in batches:
            for d, _, x in _numbers(batch, parts, scale):
                top[d] = max(top.get(d, 0.0), float(np.abs(x).max(initial=0.0)))
        yield pa.RecordBatch.from_pydict({"d": pa.array(list(top), pa.int32()), "top": pa.array(list(top.values()), pa.float64())})

    return run


def _smallest(wanted: set[int], entries: int, parts: int, scale: int) -> Map:
    """The vectors of a partition's smallest ids, for each length; of an id the least vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            all_ids = np.asarray(pc.fill_null(batch.column("vec_id"), int(_LAST)), np.int64)
            for d, rows, whole in _numbers(batch, parts, scale):
                if d not in wanted:
                    continue
                ids, x = all_ids[rows], _exact(whole)
                if d in held:
                    ids, x = np.concatenate([held[d][0], ids]), np.concatenate([held[d][1], x])
                least = np.unique(ids)[:entries]
                in_ = ids <= least[-1]
                ids, x = ids[in_], x[in_]
                order = np.lexsort((*x.T[::-1], ids))
                first = order[np.unique(ids[order], return_index=True)[1]]
                held[d] = ids[first], x[first]
        for d, (ids, x) in held.items():
            yield pa.RecordBatch.from_pydict({"d": pa.array([d] * len(ids), pa.int32()), "id": pa.array(ids), "x": pa.array(x.tolist(), pa.list_(pa.int64()))})

    return run


def _sums(books, parts: int, scale: int) -> Map:
    """For each length, part and entry: how many parts are nearest to it, and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {d: np.zeros((*b.shape[:2], b.shape[2] + 1), np.int64) for d, b in books.value.items()}
        for batch in batches:
            for d, _, whole in _numbers(batch, parts, scale):
                if d not in total:
                    continue
                x, book = _exact(whole).reshape(len(whole), parts, -1), books.value[d]
                for p in range(parts):
                    code, _ = nearest(x[:, p], book[p])
                    order = np.argsort(code, kind="stable")
                    used, first = np.unique(code[order], return_index=True)
                    total[d][p, used, 0] += np.diff(np.append(first, len(code)))
                    if x.shape[2]:
                        total[d][p, used, 1:] += np.add.reduceat(x[order, p], first, axis=0)
        for d, sums in total.items():
            part, entry = np.nonzero(sums[:, :, 0])
            yield pa.RecordBatch.from_pydict({"d": pa.array([d] * len(part), pa.int32()), "part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "sums": pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))})

    return run


def _codes(books, parts: int, scale: int) -> Map:
    """Id, label, code and error of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, whole in _numbers(batch, parts, scale):
                if d not in books.value:
                    continue
                x, book = _exact(whole).reshape(len(whole), parts, -1), books.value[d]
                code, far = zip(*[nearest(x[:, p], book[p]) for p in range(parts)], strict=True)
                digits = np.stack(code, 1).astype(np.uint8).tobytes().hex()
                each = [digits[k : k + 2 * parts] for k in range(0, len(digits), 2 * parts)]
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("label").take(at), pa.array([d] * len(rows), pa.int32()), pa.array(each), pa.array(np.sum(far, axis=0))], ["vec_id", "label", "d", "code", "error"])

    return run


def _first_books(v: DataFrame, wanted: set[int], parts: int, entries: int, scale: int) -> Books:
    found = v.mapInArrow(_smallest(wanted, entries, parts, scale), "d int, id long, x array<bigint>").groupBy("d", "id").agg(F.min("x").alias("x"))
    place = F.row_number().over(Window.partitionBy("d").orderBy("id"))
    rows = found.withColumn("place", place).where(F.col("place") <= entries).orderBy("d", "place").toArrow()  # the codebooks
    books: dict[int, list] = {}
    for d, x in zip(rows["d"].to_pylist(), rows["x"].to_pylist(), strict=True):
        books.setdefault(d, []).append(x)
    return {d: np.array(x, np.int64).reshape(len(x), parts, -1).transpose(1, 0, 2).copy() for d, x in books.items()}


def _improved(v: DataFrame, books: Books, parts: int, scale: int) -> Books:
    """The codebooks after a round; entries that no part is nearest to stay."""
    sent = v.sparkSession.sparkContext.broadcast(books)
    each = v.mapInArrow(_sums(sent, parts, scale), "d int, part int, entry int, sums array<bigint>").select("d", "part", "entry", F.posexplode("sums").alias("at", "x"))
    rows = each.groupBy("d", "part", "entry", "at").agg(F.sum("x").alias("x")).toArrow()  # as many numbers as the codebooks have
    out = {}
    d, part, entry, at, x = (rows[c].to_numpy() for c in ("d", "part", "entry", "at", "x"))
    for k, book in books.items():
        total = np.zeros((*book.shape[:2], book.shape[2] + 1), np.int64)
        mine = d == k
        total[part[mine], entry[mine], at[mine]] = x[mine]
        n = total[:, :, :1]
        out[k] = np.where(n > 0, total[:, :, 1:] // np.maximum(n, 1), book)
    sent.unpersist()
    return out


def _groups(lengths: list[int], entries: int, parts: int) -> Iterator[set[int]]:
    """Lengths whose codebooks fit one broadcast."""
    group: set[int] = set()
    size = 0
    for d in sorted(lengths):
        more = 8 * entries * (-(-d // parts) * parts + parts)
        if group and size + more > MOST_BYTES:
            yield group
            group, size = set(), 0
        group.add(d)
        size += more
    if group:
        yield group


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row with a usable vector.

    vectors: vec_id, embedding (array of numbers), label of any type; other columns are
    ignored. Rows whose vector is null or holds a null or non-finite component are left out.
    code has two hexadecimal digits a part; error sums the squared distances of the parts,
    label_error the errors of all rows with an equal label (those without a label are
    together), and codebooks_sha256 names the final codebooks.

    Repeated rows count as often as they stand. A vec_id that repeats gives one entry of
    the first codebooks, its least vector; rows without a vec_id count as one vec_id after
    all others. Fewer vec_ids than ``entries`` make shorter codebooks. Vectors of each length
    have codebooks of their own; empty vectors have code 0 and error 0. Numbers too large
    for exact 64-bit distances are an error that says so. An empty table gives an empty
    result.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes have two hexadecimal digits: 1 to 256 entries")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    seen = v.mapInArrow(_lengths(parts, scale), "d int, top double").groupBy("d").agg(F.max("top").alias("top")).collect()  # a row a length
    if any(4.0 * max(1, r.d + parts) * r.top**2 >= 2.0**62 for r in seen):
        raise ValueError("a component is too large for exact 64-bit distances")
    schema = T.StructType([T.StructField("vec_id", T.LongType()), v.schema["label"], T.StructField("d", T.IntegerType()), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded, names = v.sparkSession.createDataFrame([], schema), {}
    for wanted in _groups([r.d for r in seen], entries, parts):
        books = _first_books(v, wanted, parts, entries, scale)
        for _ in range(rounds):
            books = _improved(v, books, parts, scale)
        names |= {d: hashlib.sha256(",".join(map(str, b.reshape(-1).tolist())).encode()).hexdigest() for d, b in books.items()}
        sent = v.sparkSession.sparkContext.broadcast(books)
        coded = coded.union(v.mapInArrow(_codes(sent, parts, scale), schema))
    coded = keep(coded, "codes")
    sums = keep(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    out = looked_up(coded, sums, "label", ["label_error"])
    books = [x for d, name in names.items() for x in (F.lit(d), F.lit(name))]
    digest = F.element_at(F.create_map(*books), F.col("d")) if len(names) > 1 else F.lit(next(iter(names.values()), None))
    return out.select("vec_id", "code", "error", "label_error", digest.cast("string").alias("codebooks_sha256"))
