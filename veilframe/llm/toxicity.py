"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another. Each is a logistic model on hashed features
of the text (its words, and their first 4, 5 and 6 bytes) and on the probabilities of the
categories before it. While training, those probabilities are out-of-fold predictions,
so that a later model sees what it will see on new text. Copies of a text share a fold.

The chain is fitted by one task on a bounded sample of labelled rows (``sample``, those
with the least hash of doc_id); prediction reads every text. The weights that go to each
task take ``4 * 2**BITS`` bytes a category.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm import _text
from veilframe.llm._store import drop, keep

BITS = 18
_WIDTH = 1 << BITS
#: Bytes of text whose features are made at once: they take some fifty times that, which a worker keeps.
_CHUNK = 1 << 18


@dataclass(frozen=True)
class Category:
    """A 0/1 column of the labels, and the value that counts as positive."""

    name: str
    column: str
    positive: int = 1


#: In the order of the chain: junk first, then what it helps to tell from toxic text.
CHAIN = (Category("junk", "quality", 0), Category("toxic", "toxic", 1))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of all texts one after another, n+1 offsets); each once a text."""
    start, end = _text.runs(_text.LETTER[data], offsets)
    prefix = _text.prefix_hashes(data)
    doc = np.searchsorted(offsets, start, "right") - 1
    parts, docs = [_text.span_hash(prefix, start, end)], [doc]
    for k in (4, 5, 6):
        long = end - start >= k
        parts.append(_text.mix(_text.span_hash(prefix, start[long], start[long] + k) + np.uint64(k)))
        docs.append(doc[long])
    code = np.unique((np.concatenate(docs).astype(np.int64) << BITS) | (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64))
    return (code & (_WIDTH - 1)).astype(np.int32), np.searchsorted(code >> BITS, np.arange(len(offsets)))


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[ends[1:]] - total[ends[:-1]]


@dataclass
class Model:
    """A logistic model: weights of hashed features, of earlier categories, and a bias."""

    sparse: np.ndarray
    chain: np.ndarray
    bias: float

    def predict(self, at: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
        z = _sums(self.sparse[at], ends) + before @ self.chain + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Sample:
    """Features of labelled texts: a row and a column for each, columns counted from 0."""

    row: np.ndarray
    col: np.ndarray
    codes: np.ndarray  # the hashed feature that a column stands for
    rows: int

    @classmethod
    def of(cls, at: np.ndarray, ends: np.ndarray) -> Sample:
        """Features of three texts or more; others say little and would take room."""
        seen = np.bincount(at, minlength=_WIDTH)
        good = seen[at] > 2
        codes = np.flatnonzero(seen > 2)
        place = np.zeros(_WIDTH, np.int32)
        place[codes] = np.arange(len(codes))
        row = np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(ends))[good]
        return cls(row, place[at[good]], codes, len(ends) - 1)

    def take(self, keep: np.ndarray) -> Sample:
        """The rows for which keep is true, counted anew."""
        on = keep[self.row]
        return Sample((np.cumsum(keep) - 1).astype(np.int32)[self.row[on]], self.col[on], self.codes, int(keep.sum()))

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights.astype(np.float32)[self.col], self.rows)


def fit(x: Sample, before: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 40) -> Model:
    """Penalised maximum likelihood by L-BFGS; a constant if there is one class only.

    A feature stands for its log ratio of shares in the two classes, so that the penalty
    falls on features that tell little.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(_WIDTH, np.float32), np.zeros(before.shape[1]), 30.0 if y.sum() else -30.0)
    m, c = len(x.codes), before.shape[1]
    seen, positive = np.bincount(x.col, minlength=m), np.bincount(x.col, y.astype(np.float32)[x.row], m)
    ratio = np.log((positive + 0.5) / (y.sum() + 1)) - np.log((seen - positive + 0.5) / (len(y) - y.sum() + 1))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.sums(w[:m] * ratio) + before @ w[m : m + c] + w[-1]
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        value = np.logaddexp(0, z).sum() - (z * y).sum() + penalty / 2 * (w[:-1] @ w[:-1])
        grad = np.concatenate([np.bincount(x.col, err.astype(np.float32)[x.row], m) * ratio, before.T @ err, [err.sum()]])
        grad[:-1] += penalty * w[:-1]
        return value, grad

    w = np.zeros(m + c + 1)
    w[-1] = np.log(share / (1 - share))
    value, grad = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d, alpha = grad.copy(), []
        for s, g, rho in reversed(past):
            alpha.append(rho * (s @ d))
            d -= alpha[-1] * g
        d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(grad).sum())
        for (s, g, rho), a in zip(past, reversed(alpha), strict=True):
            d += s * (a - rho * (g @ d))
        step, slope = 1.0, grad @ d
        while True:
            new, new_grad = loss(w - step * d)
            if new <= value - 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        s, g = -step * d, new_grad - grad
        if s @ g > 1e-12:
            past = [*past[-7:], (s, g, 1 / (s @ g))]
        done = value - new < 1e-6 * max(1.0, abs(value))
        w, value, grad = w + s, new, new_grad
        if done:
            break
    sparse = np.zeros(_WIDTH, np.float32)
    sparse[x.codes] = w[:m] * ratio
    return Model(sparse, w[m : m + c], float(w[-1]))


def fit_chain(x: Sample, y: np.ndarray, fold: np.ndarray) -> list[Model]:
    """One model a column of y, each fed with out-of-fold predictions of those before."""
    models, before = [], np.zeros((len(y), 0))
    for k in range(y.shape[1]):
        models.append(fit(x, before, y[:, k]))
        if k + 1 == y.shape[1]:
            break
        out = np.zeros(len(y))
        for f in np.unique(fold):
            mine = fold == f
            part = fit(x.take(~mine), before[~mine], y[~mine, k]) if (~mine).any() else models[-1]
            z = x.take(mine).sums(part.sparse[x.codes]) + before[mine] @ part.chain + part.bias
            out[mine] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        before = np.column_stack([before, out])
    return models


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in _text.text_chunks(batch.column(0), _CHUNK):
            at, ends = features(data, offsets)
            rows = [batch.column(k).slice(lo, hi - lo) for k in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(at)), *rows], ["at", *batch.schema.names[1:]])


def learn(docs: DataFrame, labels: DataFrame, chain: tuple[Category, ...], sample: int, folds: int) -> list[Model]:
    """The chain's models, from the ``sample`` labelled rows with the least hash."""
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    ok = F.col("doc_id").isNotNull()
    for c in chain:
        ok = ok & F.col(c.column).isNotNull()
    marks = [F.max((F.col(c.column) == c.positive).cast("int")).alias(f"y{k}") for k, c in enumerate(chain)]
    some = labels.where(ok).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*marks)
    some = keep(some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "toxicity-labels")
    # At most ``sample`` rows of a few numbers: small whatever the size of the tables.
    known = docs.join(F.broadcast(some), "doc_id").select("text", F.pmod(F.xxhash64("text"), F.lit(folds)).cast("int").alias("fold"), "doc_id", *[f"y{k}" for k in range(len(chain))])
    schema = "at array<int>, fold int, doc_id long, " + ", ".join(f"y{k} int" for k in range(len(chain)))
    # Of rows that repeat a doc_id the least text counts.
    known = known.groupBy("doc_id").agg(F.min(F.struct("text", "fold", *[f"y{k}" for k in range(len(chain))])).alias("r")).select("r.text", "r.fold", "doc_id", *[f"r.y{k}" for k in range(len(chain))])
    rows = keep(known.mapInArrow(_featurise, schema), "toxicity-sample")
    # The sample is bounded: one task fits the chain, and the driver gets its weights only.
    found = rows.coalesce(1).mapInArrow(_fit(len(chain)), "place int, codes binary, weights binary, chain binary, bias double").collect()
    drop(some, rows)
    models = []
    for r in sorted(found, key=lambda r: r.place):
        sparse = np.zeros(_WIDTH, np.float32)
        sparse[np.frombuffer(r.codes, np.int32)] = np.frombuffer(r.weights, np.float32)
        models.append(Model(sparse, np.frombuffer(r.chain, np.float64), r.bias))
    return models or [Model(np.zeros(_WIDTH, np.float32), np.zeros(k), -30.0) for k in range(len(chain))]


def _fit(categories: int):
    """All rows of the sample to one row a category."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).sort_by("doc_id").combine_chunks()
        lists = table["at"].combine_chunks()
        x = Sample.of(lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]))
        y = np.column_stack([table[f"y{k}"].to_numpy() for k in range(categories)]).astype(float)
        for k, m in enumerate(fit_chain(x, y, table["fold"].to_numpy())):
            codes = np.flatnonzero(m.sparse).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"place": pa.array([k], pa.int32()), "codes": pa.array([codes.tobytes()], pa.binary()), "weights": pa.array([m.sparse[codes].tobytes()], pa.binary()), "chain": pa.array([m.chain.astype(np.float64).tobytes()], pa.binary()), "bias": pa.array([m.bias], pa.float64())})

    return run


def _chained(models: list[Model], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    at, ends = features(data, offsets)
    before = np.zeros((len(offsets) - 1, 0))
    for m in models:
        before = np.column_stack([before, m.predict(at, ends, before)])
    return before


def _predict(models: list[Model], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in _text.text_chunks(batch.column(0), _CHUNK):
                p = _chained(models, data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), *[pa.array(p[:, k]) for k in range(len(names))]], ["doc_id", *names])

    return run


def score(docs: DataFrame, labels: DataFrame, chain: tuple[Category, ...] = CHAIN, threshold: float = 0.3, sample: int = 8_000, folds: int = 3) -> DataFrame:
    """(doc_id, p_<category>..., toxic) of every row of documents.

    docs: doc_id long, text string; labels: doc_id and a 0/1 column for each category;
    other columns are ignored. p_<category> is the chain's probability, toxic whether
    the last one reaches ``threshold``. Null or empty text has no features: its
    probabilities are the models' base rates. Label rows with a null are left out, and
    repeated ones count once, as positive if one is; of rows that repeat a doc_id with other
    texts the least text is learned from. A category with one class only, or
    no labels at all, predicts a constant: that class, or 0. Rows without a doc_id and
    repeated rows are scored like any other. An empty table gives an empty result.
    """
    names = [f"p_{c.name}" for c in chain]
    models = learn(docs, labels, chain, sample, folds)
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    out = rows.mapInArrow(_predict(models, names), "doc_id long, " + ", ".join(f"{n} double" for n in names))
    return out.withColumn("toxic", F.col(names[-1]) >= threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, chain: tuple[Category, ...] = CHAIN, threshold: float = 0.3, sample: int = 8_000, folds: int = 3) -> DataFrame:
    """The rows of docs that ``score`` does not call toxic, in one pass and without a join.

    Rows are judged by their text alone: null, empty and blank texts have the models' base
    rates and stay unless most labelled documents are toxic; rows without a doc_id and
    repeated rows are judged like any other. Columns stay as they are, whatever their names.
    Labels are read as ``score`` reads them; without any, all rows stay. An empty table stays
    empty.
    """
    models = learn(docs, labels, chain, sample, folds)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in _text.text_chunks(batch.column(text), _CHUNK):
                yield batch.slice(lo, hi - lo).filter(pa.array(_chained(models, data, offsets)[:, -1] < threshold))

    return docs.mapInArrow(run, docs.schema)
