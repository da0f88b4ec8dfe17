import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.llm import _text
from veilframe.llm._bloom import Bloom
from veilframe.llm._store import keep, ranked
from veilframe.llm.graph import components
from pyspark.sql import functions as F


def union_find(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(int(a) + 1000, int(b) + 1000) for a, b in rng.integers(0, 80, (50, 2)) if a != b] + [(7, 6), (5, 5)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: v for k, v in union_find(pairs).items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ranked(spark):
    df = spark.createDataFrame([(s,) for s in ["b", None, "a", "é", "B", ""]], "s string")
    got = ranked(df, [F.col("s").isNull(), F.col("s").asc()], "r", "t").orderBy("r").collect()
    assert [(r.s, r.r) for r in got] == [("", 0), ("B", 1), ("a", 2), ("b", 3), ("é", 4), (None, 5)]


def test_bloom_loses_nothing(spark):
    h = spark.range(3000).select("id", F.xxhash64("id").alias("h"))
    b = Bloom(h.where("id % 7 = 0"), F.col("h"))
    rows = h.orderBy("id").collect()
    hit = b.has(np.array([r.h for r in rows]))
    assert all(hit[::7]) and hit.mean() < 0.3


def test_keep_is_read_again(spark):
    df = spark.range(5).withColumn("x", F.rand())
    kept = keep(df, "t")
    assert kept.collect() == kept.collect()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\tÉé.", max_size=20), max_size=6))
def test_words_and_hashes(texts):
    import pyarrow as pa

    data, offsets = _text.buffers(pa.array(texts, pa.string()))
    start, end = _text.words(data, offsets)
    raw = data.tobytes()
    got = [raw[a:b].decode() for a, b in zip(start, end)]
    assert got == [w for t in texts for w in "".join(" " if c in "\n\t" else c for c in t).split(" ") if w]
    h = _text.span_hash(_text.prefix_hashes(data), start, end)
    low = [w.encode().lower() for w in got]
    assert len(set(h.tolist())) == len(set(low))
    by = {}
    for w, x in zip(low, h.tolist()):
        assert by.setdefault(w, x) == x


def thue_morse(n):
    """2**n letters; such a string and its mirror collide in every polynomial hash modulo 2**64."""
    a, b = b"a", b"b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_word_hashes_tell_words_apart():
    a, b = thue_morse(11)
    texts = [a, b, b"", b"x", b"x\0", b"\0x", b"12345678", b"123456789", b"1234567890123456", b"12345678901234567", b"123456789012345678"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    start = end - np.array([len(t) for t in texts])
    for h in _text.word_hashes(data, start, end):
        assert len(set(h.tolist())) == len(texts)
    poly = _text.span_hash(_text.prefix_hashes(data), start, end)
    assert poly[0] == poly[1]  # why it is used for candidates alone
