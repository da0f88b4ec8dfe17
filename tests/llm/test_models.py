"""Models and counts against plain versions of what they are said to compute, and odd tables."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import langid, toxicity
from veilframe.llm.langid import identify
from veilframe.llm.mixing import rates
from veilframe.llm.packing import pack, shortest_pack_first
from veilframe.llm.pii import digest, entities, find
from veilframe.llm.queries import TOKENIZER
from veilframe.llm.topk import maxscore, top_k
from veilframe.llm.vecdedup import near_duplicate_vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_later_categories_learn_from_predictions_out_of_fold():
    rng = np.random.default_rng(1)
    rows, width = 240, 60
    on = rng.random((rows, width)) < 0.2
    at = np.concatenate([np.flatnonzero(r) for r in on]).astype(np.int32)
    x = toxicity.Sample.of(at, np.concatenate([[0], np.cumsum(on.sum(axis=1))]))
    y = np.column_stack([on[:, 0] | (rng.random(rows) < 0.1), on[:, 0] & on[:, 1]]).astype(float)
    fold = rng.integers(0, 3, rows)
    models = toxicity.fit_chain(x, y, fold)
    out = np.zeros(rows)
    for f in range(3):
        part = toxicity.fit(x.take(fold != f), np.zeros(((fold != f).sum(), 0)), y[fold != f, 0])
        mine = x.take(fold == f)
        out[fold == f] = 1 / (1 + np.exp(-(mine.sums(part.sparse[x.codes]) + part.bias)))
    want = toxicity.fit(x, out[:, None], y[:, 1])
    inside = toxicity.fit(x, 1 / (1 + np.exp(-(x.sums(models[0].sparse[x.codes]) + models[0].bias)))[:, None], y[:, 1])
    assert np.allclose(models[1].sparse, want.sparse, atol=1e-4) and np.allclose(models[1].chain, want.chain, atol=1e-3)
    assert not np.allclose(want.chain, inside.chain, atol=1e-2)


def test_profiles_are_bound_permuted_and_bundled():
    d = 64
    a, b, c = langid._vectors(d)
    letters = langid._letters()
    texts = ["Ab cde.f", "", "12 !", "Éà 日本語 x", "zzz" * 50]
    got, known = langid.profiles(texts, d)
    for k, t in enumerate(texts):
        total, any_ = np.zeros(d), False
        for run in re.findall(r"[^\W\d_]+", t.lower()):
            row = [0, *[int(letters[ord(x)]) for x in run], 0]
            for p, q, r in zip(row, row[1:], row[2:]):
                total += a[p] * b[q] * c[r]  # each rotated by its place, and multiplied
                any_ = True
        assert np.array_equal(got[k], total) and known[k] == any_
    base = np.roll(a, -2, axis=1)
    assert np.array_equal(base, np.roll(b, -1, axis=1)) and np.array_equal(base, c)


def test_profiles_hold_few_trigrams_at_a_time():
    """Memory of a chunk of rare trigrams, and the same sums whatever the blocks."""
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FA5, 262))) for _ in range(1000)]
    tracemalloc.start()
    langid.profiles(texts, 1024)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150e6
    want, known = langid.profiles(texts[:40], 64)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(langid, "_TRIGRAMS", 7)
        got, also = langid.profiles(texts[:40], 64)
    assert np.array_equal(got, want) and np.array_equal(known, also)


def test_rates_solve_the_dual(spark):
    rng = random.Random(2)
    cells = [(s, size, rng.randint(1, 30)) for s in ("a", None) for size in (1, 3, 10, 50, 400)]
    whole = Counter()
    for s, size, n in cells:
        whole[s] += size * n
    wanted = {"a": 0.7 * whole["a"], None: 1.6 * whole[None]}
    target = spark.createDataFrame([(s, whole[s], wanted[s]) for s in wanted], "source string, source_size long, target double")
    got = {(r.source, r.size): r.rate for r in rates(spark.createDataFrame(cells, "source string, size long, n long"), target, 2.0).collect()}
    for s in wanted:
        mine = [(size, n) for t, size, n in cells if t == s]
        mean = sum(x * n for x, n in mine) / sum(n for _, n in mine)
        lo, hi = -500.0, 500.0
        for _ in range(200):
            m = (lo + hi) / 2
            words = sum(x * n * 2 / (1 + math.exp(-max(-700, min(700, m * x / mean)))) for x, n in mine)
            lo, hi = (m, hi) if words < wanted[s] else (lo, m)
        assert all(got[s, x] == pytest.approx(2 / (1 + math.exp(-lo * x / mean)), abs=1e-3) for x, _ in mine)


def test_patterns_are_those_of_shortest_pack_first():
    rng = random.Random(3)
    for _ in range(30):
        size = rng.choice([10, 37, 64])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(1, 200))]
        packs = []
        for n in sorted(lengths, reverse=True):  # the longest first, into the pack with most room
            k = min(range(len(packs)), key=lambda k: packs[k], default=None)
            if k is None or packs[k] + n > size:
                packs.append(n)
            else:
                packs[k] += n
        got = Counter()
        for pattern, n in shortest_pack_first(Counter(lengths), size):
            got[sum(pattern)] += n
        assert got == Counter(packs)


def naive_terms(rows, window=10, disclosure=0.9, prior=0.5):
    """{doc_id: spans} of disclosive terms, one (entity, term) pair after another."""
    word = re.compile(r"[^\W\d_]{3,}")
    docs, pairs, held, k = {}, {}, {}, Counter()
    for i, t in rows:
        base = entities(t)
        inside = lambda m, base=base: any(m.start() < b and a < m.end() for _, a, b in base)
        words = [m for m in word.finditer(t)]
        docs[i] = [m for m in words if not inside(m)]
        k.update({m[0].lower() for m in words})
        for kind, a, b in base:
            value = t[a:b].lower()
            names = [f"{kind}:{value}", *([f"{kind}@{value.rpartition('@')[2]}"] if kind == 0 else []), str(kind)]
            before = [m for m in words if m.end() <= a][-window:]
            after = [m for m in words if m.start() >= b][:window]
            for m in before + after:
                if not inside(m):
                    for e in names:
                        pairs.setdefault((e, m[0].lower()), set()).add(t)
                        held.setdefault(e, set()).add(i)
    out, total = {i: set() for i, _ in rows}, len(rows)
    for (e, w), texts in pairs.items():
        n, x = len(held[e]), len(texts)
        m = min(sum(any(o[0].lower() == w for o in docs[i]) for i in held[e]), k[w])
        if n == total:
            continue
        chance = (x * m / k[w] + prior * n / total) / (x + prior)
        if math.log(chance * total / n) / math.log(total / n) >= disclosure:
            for i in held[e]:
                out[i] |= {o.span() for o in docs[i] if o[0].lower() == w}
    return out


def test_disclosive_terms_are_those_of_the_plain_count(spark):
    rng = random.Random(4)
    common = ["".join(rng.choice("aeioustrn") for _ in range(5)) for _ in range(30)]
    rare = [f"name{c}" for c in "abcdefgh"]
    rows = []
    for i in range(150):
        ws = [rng.choice(common) for _ in range(40)]
        if i % 6 == 0:
            who = rng.randrange(8)
            ws[rng.randrange(40)] = f"u{who}@site{who % 2}.example"
            ws[rng.randrange(40)] = "".join(x for x in rare[who] if x.isalpha())
        if i % 10 == 1:
            ws[5:5] = ["Server", "10.0.0.1"]
        rows.append((i, " ".join(ws)))
    got = {r.doc_id: {(s.start, s.end) for s in r.terms} for r in find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = naive_terms(rows)
    assert got == want and any(want.values())


def test_no_word_within_an_entity_is_a_term(spark):
    text = "alpha.beta@gamma.example " + " ".join(f"10.0.{k}.1" for k in range(60)) + " outside"
    rows = [(i, text) for i in range(3)] + [(i, "other words here") for i in range(3, 90)]
    found = find(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 0").first()
    assert {text[s.start : s.end] for s in found.terms} <= {"outside"}


def test_maxscore_probes_no_more_than_all():
    rng = np.random.default_rng(5)
    few = np.zeros((500, 40), np.float32)  # sparse rows: most terms are not essential
    for r in few:
        r[rng.choice(40, 4, replace=False)] = rng.integers(1, 5, 4)
    queries = few[:20] * rng.integers(1, 9, 40).astype(np.float32)
    i, j, score, made = maxscore(queries, few, np.zeros((20, 500), bool), 5)
    full = queries @ few.T
    for k in range(20):
        best = np.sort(full[k])[::-1][:5]
        assert np.array_equal(np.sort(score[i == k])[::-1][:5], best)
    assert made < full.size * 40


def test_repeated_vectors(spark):
    rows = [(1, [1.0, 0.0], 0, 7), (1, [1.0, 0.0], 0, 7), (2, [1.0, 0.01], 0, 7), (20, [0.5, 0.5], 1, 7), (20, [0.5, 0.5], 1, 7), (20, [0.0, 1.0], 1, 7), (40, None, 1, 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cell int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(df).collect())
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (20, 1, 20, True), (20, 1, 20, True), (20, 0, 20, True), (40, 0, 40, True)])
    top = [(r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df, F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert top == [(20, 1, 1, 0), (20, 2, 1, 0), (20, 3, 2, 0)]  # asked once, with the least of its vectors; ties to the smaller vec_id


def test_odd_tables_of_languages(spark):
    rows = [(1, "", "xx"), (2, "a" * 200_000, "xx"), (3, " \n", None), (4, None, None), (5, "aaa", "xx"), (5, "aaa", "xx")]
    df = spark.createDataFrame([(*r, 0.5, True, "y") for r in rows], "doc_id long, text string, lang string, score double, held_out boolean, lang_pred string")
    got = sorted((r.doc_id, r.lang_pred) for r in identify(df, F.lit(False)).collect())
    assert got == [(1, "und"), (2, "xx"), (3, "und"), (4, "und"), (5, "xx"), (5, "xx")]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "write to a@b.example now", 1, 2, 3, 4), (1, "write to a@b.example now", 1, 2, 3, 4), (2, None, 1, 2, 3, 4)], "doc_id long, text string, length int, h int, base int, tie int")
    assert sorted((r.doc_id, r.start, r.doc_tokens) for r in pack(df, TOKENIZER).collect())[0][0] == 1 and pack(df, TOKENIZER).count() == 3
    assert sorted((r.doc_id, r.n_email) for r in digest(find(df)).collect()) == [(1, 1), (1, 1), (2, 0)]


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_rows(spark, tmp_path, stage):
    """Nulls in all columns, ties, repeated rows, empty and long texts, and extra columns with names of our own."""
    import corpus_pipeline

    long = " ".join(f"w{k % 977}" for k in range(30_000))
    rows = [(1, "a b c d e f g h i", "en", "s", 17), (1, "a b c d e f g h i", "en", "s", 17), (1, "another text of the same id", "en", None, 5), (None, "no id at all here", None, None, None), (None, "no id at all here", None, None, None), (2, None, None, None, None), (3, "", "en", "s", 0), (4, " \n\t", "en", "t", 3), (5, long, "en", "t", len(long)), (6, "x" * 100_000, "en", "t", 1)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, None) for r in rows], DOCS + ", tie int, row int, lost_lines int, near_row int, mix_n string")
    spark.createDataFrame([(1, 1, 0), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, docs, str(tmp_path)).collect()
    texts = Counter((r.doc_id, r.text) for r in out) if name != "packing" else None
    given = Counter((r[0], r[1]) for r in rows)
    if name == "toxicity" or name == "line dedup":
        assert set(texts) <= set(given) and texts[(2, None)] == 1 and texts[(5, long)] == 1
    elif name == "near dedup":
        assert texts == Counter(set(given))
    elif name == "mixing":
        assert set(texts) <= set(given) and all(texts[t] <= 2 * given[t] for t in texts)
    else:
        assert {r.doc_id for r in out} == {1, 2, 3, 4, 5, 6, None}
    if name != "packing":
        assert out[0].__fields__ == docs.columns
    assert run(spark, docs.where("false"), str(tmp_path)).count() == 0
