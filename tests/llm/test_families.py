import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilframe.llm import _store, graph, minhash, toxicity

from .test_graph import union_find


def near_copies(n, seed=11):
    """Sets about one text, each with deviations of its own and shared ones; links neither all nor none."""
    rng = random.Random(seed)
    sides = [[1000 * s + k for k in range(14)] for s in range(1, 7)]
    sets = {}
    for i in range(n):
        own = set(range(60)) - set(rng.sample(range(60), rng.randint(0, 4))) | set(rng.sample(rng.choice(sides), rng.randint(0, 12)))
        sets[f"{i:04d}".encode()] = own | {10_000 + 10 * i + k for k in range(rng.randint(0, 4))}
    return sets


def linked(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


def tables(spark, sets, part=lambda i: i):
    open_ = spark.createDataFrame([(1, i, part(i)) for i in sets], "block long, id binary, component binary")
    return open_, spark.createDataFrame([(i, len(s), list(s)) for i, s in sets.items()], "id binary, n_shingles long, shingles array<long>")


def test_links_of_a_family_are_those_of_all_pairs():
    for seed in range(6):
        sets = list(near_copies(90, seed).values()) + [set(range(70_000, 70_000 + seed))] * (seed > 0)
        part = np.random.default_rng(seed).integers(0, [1, 90, 20][seed % 3], len(sets))
        arrays = [np.array(sorted(s), np.int64) for s in sets]
        got = minhash.joins(arrays, part, 80)
        before = [(a, b) for a in range(len(sets)) for b in range(a) if part[a] == part[b]]
        assert all(linked(sets[a], sets[b]) for a, b in got) and len(got) < len(sets)
        assert union_find(before + got) == union_find(before + [(a, b) for a in range(len(sets)) for b in range(a) if linked(sets[a], sets[b])])


@pytest.mark.parametrize("held", [8192, 3])
def test_families_are_finished_at_once_or_narrowed(spark, monkeypatch, held):
    """Both ways lose no link; a family of a few thousand members takes no rounds."""
    rounds, pairs = [], minhash._family_pairs
    monkeypatch.setattr(minhash, "_family_pairs", lambda rows, percent: rounds.append(1) or pairs(rows, percent))
    monkeypatch.setattr(minhash, "_HELD", held)
    sets = near_copies(120)
    ids = sorted(sets)
    got = {tuple(sorted((bytes(r.id), bytes(r.other)))) for r in minhash.rest_links(*tables(spark, sets), 80).collect()}
    want = union_find([(a, b) for k, a in enumerate(ids) for b in ids[:k] if linked(sets[a], sets[b])])
    assert union_find([(a, b) for a, b in got if linked(sets[a], sets[b])]) == want and bool(rounds) == (held == 3)


def test_elements_of_one_component_are_not_joined(spark, monkeypatch):
    """100 members of one component share ten elements that no other has: none of them is looked at."""
    rows_of, old = {}, minhash.keep
    monkeypatch.setattr(minhash, "keep", lambda df, name: rows_of.__setitem__(name, (out := old(df, name)).count()) or out)
    sets = {f"{i:03d}".encode(): set(range(100)) | (set(range(500, 510)) if i < 100 else {900 + i}) for i in range(250)}
    minhash.rest_pairs(*tables(spark, sets, lambda i: b"000" if i < b"100" else i), 80).count()
    assert rows_of["minhash-apart"] == 250 and rows_of["minhash-prefix"] == 0


def test_small_blocks_are_compared_pair_by_pair(spark):
    """A chain in one block is one component after one comparison, and nothing is left open."""
    names = [f"{i:02d}" for i in range(graph._PAIRS)]
    blocks = spark.createDataFrame([(7, i, i != "03") for i in names], "block long, id string, centre boolean")
    chain = lambda pairs: pairs.where(F.abs(F.col("a").cast("int") - F.col("b").cast("int")) == 1)
    found = graph.star_closure(blocks, lambda ids: chain, "chain", rest=None)
    assert {(r.id, r.component) for r in found.collect()} == {(i, "00") for i in names}


def test_features_of_text_are_made_in_small_chunks(monkeypatch):
    """Workers keep what a chunk of features took, so that chunks of 2 MB of texts are small ones."""
    sizes, old = [], toxicity.features
    monkeypatch.setattr(toxicity, "features", lambda data, offsets: sizes.append(len(data)) or old(data, offsets))
    texts = pa.array([f"word{i} " * 300 for i in range(1000)])
    out = list(toxicity._featurise(iter([pa.RecordBatch.from_arrays([texts], ["text"])])))
    assert sum(b.num_rows for b in out) == 1000 and sum(sizes) > 2_000_000 and max(sizes) <= 1 << 18


def test_narrowed_families_leave_no_join_to_the_caller(spark, monkeypatch):
    """Each family's pairs are kept on their own: a plan of all of them would broadcast all their tables at once."""
    monkeypatch.setattr(minhash, "_FEW", 4)
    got = minhash.rest_pairs(*tables(spark, near_copies(120)), 80)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_tables_that_grow_are_not_broadcast(spark, monkeypatch):
    """Spark would broadcast a table of 10 MB as a file, which takes many times that in the driver's memory."""
    keys, old, seen = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"), _store.keep, []
    before = [spark.conf.get(k, None) for k in keys]
    for module in (minhash, graph):
        monkeypatch.setattr(module, "keep", lambda df, name: seen.append([int(spark.conf.get(k) or -2) for k in keys]) or old(df, name))
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    docs = spark.createDataFrame([(i, " ".join([*words, *[f"{w}{i // 3}" for w in words], f"x{i}"])) for i in range(30)], "doc_id long, text string")
    out = minhash.near_duplicates(docs, width=2, percent=80)
    assert seen and all(0 < files <= 1 << 18 and 0 < rows <= 1 << 21 for files, rows in seen)
    assert [spark.conf.get(k, None) for k in keys] == before
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().sparkPlan().toString()
    assert {(r.doc_id, r.component_id) for r in out.collect()} == {(i, i // 3 * 3) for i in range(30)}


@pytest.mark.parametrize(("own", "files", "rows"), [("10485760b", 1 << 18, 1 << 21), ("64k", 1 << 16, 1 << 16), ("-1", -1, -1)])
def test_smaller_settings_of_the_session_hold(spark, own, files, rows):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    spark.conf.set(keys[0], own)
    try:
        with pytest.raises(ZeroDivisionError), _store.bounded(spark):
            assert [int(spark.conf.get(k)) for k in keys] == [files, rows]
            raise ZeroDivisionError
        assert spark.conf.get(keys[0]) == own and spark.conf.get(keys[1], None) is None
    finally:
        spark.conf.unset(keys[0])
