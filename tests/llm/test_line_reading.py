"""What op4_segment_join reads, and what it sends to be verified."""

import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from veilframe.llm import graph, linededup

SPACES = [" ", "\n", "\t", "\r", "\x0b", "\x0c"]


def plain(text):
    """Number and normal form of the lines of a text."""
    for k, line in enumerate(text.split("\n")):
        line = re.sub(r"[ \t-\r]+", " ", line).strip(" ")
        if line:
            yield k, re.sub("[A-Z]", lambda m: m[0].lower(), line).encode()


def odd_texts(seed, n=60):
    rng = random.Random(seed)
    some = [*SPACES, *SPACES, "a", "B", "é", "日", "Word", "longer-than-eight", "x" * 70, " "]
    return ["".join(rng.choice(some) * rng.choice([1, 1, 1, 9]) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["", " ", "\n", " " * 40 + "a" + "\t" * 40]


def batch(texts):
    ids = pa.array(range(len(texts)), pa.int64())
    return pa.RecordBatch.from_arrays([ids, pa.array([7 * k for k in range(len(texts))], pa.int64()), pa.array(texts)], ["doc_id", "h", "text"])


def test_lines_are_those_of_a_plain_reading():
    for seed in range(8):
        texts = odd_texts(seed)
        (got,) = linededup._read(linededup.Tolerance(), True)(iter([batch(texts)]))
        want = [(k, number, xxhash.xxh3_128_digest(line)) for k, text in enumerate(texts) for number, line in plain(text)]
        assert list(zip(*(got.column(c).to_pylist() for c in ("doc_id", "line", "id")), strict=True)) == want


def test_only_lines_that_are_wanted_are_made_normal(monkeypatch):
    """The filter is asked about places, before a line is made normal and named."""
    texts = odd_texts(3)
    (read,) = linededup._read(linededup.Tolerance(), True)(iter([batch(texts)]))
    places = read.column("place").to_numpy()[::5]

    class Wanted:
        def has(self, h):
            return np.isin(h, places)

    made, normal = [], linededup.normal
    monkeypatch.setattr(linededup, "normal", lambda data, *more: made.append(len(data)) or normal(data, *more))
    (got,) = linededup._fetch(Wanted())(iter([batch(texts)]))
    lines = [line for text in texts for _, line in plain(text)][::5]
    assert dict(zip(*(got.column(c).to_pylist() for c in ("id", "text")), strict=True)) == {xxhash.xxh3_128_digest(x): x for x in lines}
    assert sum(made) <= 2 * sum(map(len, lines)) + 100 < sum(len(t.encode()) for t in texts)


def test_pairs_are_verified_many_at_a_time_and_twos_make_no_blocks(spark, monkeypatch):
    """Lines that only meet one other are verified at once; verification has batches of the usual size."""
    setting, rows_of, sizes, old = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, [], linededup.keep

    def kept(df, name):
        if name == "line-links":
            sizes.append(spark.conf.get(setting))
        out = old(df, name)
        rows_of[name] = rows_of.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(linededup, "keep", kept)
    monkeypatch.setattr(graph, "keep", kept)
    usual, rng = spark.conf.get(setting), random.Random(5)
    line = lambda: [f"w{rng.randrange(10**6)}" for _ in range(60)]
    near = lambda words, *at: " ".join(f"new{k}" if k in at else w for k, w in enumerate(words))
    twos = [line() for _ in range(30)]
    texts = [near(w) for w in twos] + [near(w, 3, 50) for w in twos]
    found = lambda texts: {r.doc_id: r.class_doc_id for r in linededup.line_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found(texts) == {k: k % 30 for k in range(60)} and not rows_of.get("line-level")
    threes = [line() for _ in range(20)]
    assert found([near(w, *at) for at in ((), (3,), (50,)) for w in threes]) == {k: k % 20 for k in range(60)} and rows_of["line-level"] > 0
    assert set(sizes) == {usual}
