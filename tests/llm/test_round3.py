"""Product codes, filter interactions and benchmark passages against plain versions, and odd tables."""

import hashlib
import math
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import codes as codes_module
from veilframe.llm import decontaminate
from veilframe.llm import langid, linededup
from veilframe.llm import vecdedup
from veilframe.llm._store import keep, looked_up
from veilframe.llm.audit import interactions
from veilframe.llm.codes import compress
from veilframe.llm.decontaminate import contaminated
from veilframe.llm.pii import find
from veilframe.llm.vecdedup import near_duplicate_vectors

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_codes(rows, parts, entries, rounds, scale):
    """{length: (codebooks, [(vec_id, label, code, error)])} in pure Python."""
    whole = [(i, [math.floor(scale * x) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for d in {len(v) for _, v, _ in whole}:
        mine = [(i, v + [0] * (-d % parts), g) for i, v, g in whole if len(v) == d]
        w = len(mine[0][1]) // parts
        cut = lambda v, p: tuple(v[p * w : (p + 1) * w])  # noqa: E731, B023
        first = {}
        for i, v, _ in mine:
            key = (i is None, i)
            first[key] = min(first.get(key, v), v)
        least = [first[k] for k in sorted(first, key=lambda k: (k[0], k[1] or 0))][:entries]
        books = [[cut(v, p) for v in least] for p in range(parts)]

        def near(x, book):
            far = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in book]
            return far.index(min(far)), min(far)

        for _ in range(rounds):
            new = []
            for p, book in enumerate(books):
                held = [[] for _ in book]
                for _, v, _ in mine:
                    held[near(cut(v, p), book)[0]].append(cut(v, p))
                new.append([tuple(sum(c) // len(h) for c in zip(*h, strict=True)) if h else old for h, old in zip(held, book, strict=True)])
            books = new
        found = []
        for i, v, g in mine:
            each = [near(cut(v, p), books[p]) for p in range(parts)]
            found.append((i, g, "".join(f"{c:02x}" for c, _ in each), sum(f for _, f in each)))
        out[d] = books, found
    return out


def test_codes_are_those_of_a_plain_version(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.3, 0.7]) + rng.random() / 50 for _ in range(8)], rng.choice([1, 1, 2, None])) for i in range(90, 0, -1)]
    rows += [(500, None, 1), (501, [0.1] * 7 + [None], 1), (502, [0.1] * 7 + [float("nan")], 2), (503, [float("inf")] * 8, None), (7, [0.0] * 8, 1), (None, [0.5] * 8, 2), (None, [0.25] * 8, 2), (3, rows[5][1], 2)]
    rows += [(600 + k, [rng.random() for _ in range(6)], 3) for k in range(12)] + [(700, [], 4), (701, [], None)]
    df = spark.createDataFrame([(i, v, g, "x", 1) for i, v, g in rows], "vec_id long, embedding array<double>, label int, code string, d int")
    for most in (1 << 26, 1):  # all lengths in one broadcast, and one each
        monkeypatch.setattr(codes_module, "MOST_BYTES", most)
        got = compress(df, parts=4, entries=16, rounds=3, scale=64).collect()
        plain = plain_codes(rows, 4, 16, 3, 64)
        total = {}
        for _, found in plain.values():
            for _, g, _, e in found:
                total[g] = total.get(g, 0) + e
        want = []
        for books, found in plain.values():
            name = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
            want += [(i, code, e, total[g], name) for i, g, code, e in found]
        assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert compress(df.limit(0)).count() == 0 and compress(df).count() == len(want)
    with pytest.raises(ValueError):
        compress(spark.createDataFrame([(1, [1e30], 1)], "vec_id long, embedding array<double>, label int"))


def test_values_of_hot_and_other_keys_are_looked_up(spark):
    rows = [(None if k % 3 == 0 else k % 7 if k % 3 == 1 else k, k) for k in range(3000)]
    df = keep(spark.createDataFrame(rows, "g long, k long"), "rows")
    sums = keep(df.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total")), "sums")
    want = {}
    for g, k in rows:
        want[g] = want.get(g, 0) + k
    for most in (100_000, 5):
        got = looked_up(df, sums, "g", ["total"], most).collect()
        assert len(got) == 3000 and all(r.total == want[r.g] for r in got)


def plain_interactions(docs, labels):
    rows, first = [], {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        mine = [x for x in labels if x[0] == i and i is not None]
        rows.append((s or "", {k for k, v in fails.items() if v}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r[1:] for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                left = [r for r in mine if not r[0] & set(order[:k])]
                gone = [r for r in left if f in r[0]]
                failing = [r for r in mine if f in r[0]]
                out[part, "".join(order), k + 1] = [len(left) - len(gone), len(gone), len(failing) - len(gone), sum(r[0] == {f} for r in mine), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for f in "ABCDE":
            at = [key for key in out if key[0] == part and key[1][key[2] - 1] == f]
            total = sum(out[key][1] for key in at)
            for key in at:
                out[key].append(total)
    return out


def test_interactions_are_those_of_running_every_order(spark):
    rng = random.Random(5)
    docs = []
    for i in range(60):
        words = [rng.choice(["alpha", "Beta", "GAMMA", "d%e", "zeta", f"w{rng.randrange(99)}"]) for _ in range(rng.choice([3, 49, 50, 51, 90]))]
        docs.append((i, rng.choice([" ", "\n", "\x0b"]).join(words), rng.choice(["web", "book", None, ""])))
    docs += [(100 + k, docs[k % 4][1], "web") for k in range(20)] + [(5, docs[5][1], "book"), (5, "another " * 60, "web"), (None, docs[0][1], "web"), (None, docs[0][1], "web"), (None, None, None)]
    docs += [(200, None, "web"), (201, "", "book"), (202, "\n ", "book"), (203, "é" * 94 + "A" * 6, "web"), (204, "word " * 200_000, "web")]
    labels = [(i, i % 2, 1 if i % 3 == 0 else None) for i in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, source string, part string, n int")
    lf = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, text string")
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in interactions(df, lf).collect()}
    assert got == plain_interactions(docs, labels)
    assert interactions(df.limit(0), lf).count() == 0
    assert interactions(df, lf.limit(0)).count() == len(got)


def plain_contaminated(docs, items, width):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    held = {}
    for i, t in items:
        w = words(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            held.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in held}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in held:
                    hit.update(range(k, k + n))
                    found |= {x for x in held[tuple(w[k : k + n])] if x is not None}
        ids = sorted(map(str, found))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("rows", [100_000, 7])
def test_passages_are_those_of_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(decontaminate.matches, "__defaults__", (rows, rows))
    rng = random.Random(8)
    pool = ["The", "the", "cat", "Dog", "É", "é", "naïve", "日本", "x1", "42", "of"]
    passage = lambda n: [rng.choice(pool) for _ in range(n)]
    items = [(k, rng.choice([" ", ", ", "\n"]).join(passage(n))) for k, n in enumerate([30, 12, 10, 9, 3, 2, 1, 25, 10])]
    items += [(20, items[0][1]), (21, "of " * 40), (0, items[1][1]), (22, None), (23, " .,\x00"), (24, "only here are rare words which no text will hold at all"), (None, "unnamed " * 12)]
    docs = []
    for i in range(80):
        w = passage(rng.choice([0, 1, 5, 40]))
        for _ in range(rng.randrange(3)):
            src = re.split(r"[ ,\n]+", rng.choice(items[:9])[1])
            a = rng.randrange(len(src))
            w += src[a : a + rng.choice([5, 9, 10, 11, 30])] + passage(3)
        docs.append((i, rng.choice([" ", "-", ". "]).join(w)))
    docs += [(200 + k, items[0][1].upper()) for k in range(20)] + [(5, docs[5][1]), (5, items[2][1]), (None, items[0][1]), (None, None), (300, None), (301, ""), (302, "of " * 3000), (303, " ...unnamed" * 13)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, window string, n int")
    bf = spark.createDataFrame([(*b, "y") for b in items], "item_id long, text string, doc_id string")
    for width in (10, 3):
        got = sorted(repr(tuple(r)) for r in contaminated(df, bf, width).collect())
        assert got == plain_contaminated(docs, items, width)
    assert contaminated(df.limit(0), bf).count() == 0
    none = contaminated(df, bf.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.contaminated for r in none)
    assert not any(r.contaminated for r in contaminated(df, bf.where("item_id = 24")).collect())


def test_terms_of_one_text_are_no_evidence(spark):
    """Precision and recall of planted terms among words of which most are rare."""
    rng = random.Random(8)
    word = lambda n: "".join("bcdfghjklmnprstvz"[(n >> 4 * k) % 17] + "aeiou"[(n >> 3 * k) % 5] for k in range(4))
    rows, planted = [], {}
    for i in range(1200):
        ws = [word(int(2 ** (rng.random() * 17))) for _ in range(60)]
        if i % 8 == 0:  # an address of its own, half of them of one site with a word that tells it
            site = i % 16 == 0
            ws[30:30] = (["Zorblax"] if site else []) + [f"u{i}@{'one.example' if site else f's{i}.example'}"]
            planted[i] = site
        rows.append((i, " ".join(ws)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    share = {}
    for z, least in ((0.0, 0.0), (1.2816, 0.5)):
        got = {r.doc_id: [rows[r.doc_id][1][s.start : s.end] for s in r.terms] for r in find(df, deviations=z, least=least).collect()}
        assert all(("Zorblax" in got[i]) == bool(planted.get(i)) for i, _ in rows)
        spans = [w for ws in got.values() for w in ws]
        share[z] = spans.count("Zorblax") / len(spans)
    assert share[0.0] < 0.5 < 0.95 < share[1.2816], share


def test_vectors_of_a_hundred_lengths(spark, monkeypatch):
    rng = random.Random(6)
    rows = []
    for d in range(1, 101):
        one = [rng.gauss(0, 1) for _ in range(d)]
        rows += [(4 * d, one, d % 3), (4 * d + 1, [2 * x + 1e-3 for x in one], d % 3), (4 * d + 2, [-x for x in one], d % 3), (4 * d + 3, one, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b)
    want = {}
    for i, v, g in rows:
        near = [j for j, w, h in rows[4 * (i // 4 - 1) : 4 * (i // 4)] if j != i and h == g and cosine(v, w) >= 0.98]
        want[i] = (len(near), min([i, *near]))
    for most in (1 << 26, 1 << 20):  # all bases in one broadcast, and in three
        monkeypatch.setattr(vecdedup, "MOST_BYTES", most)
        assert len(list(vecdedup.groups(list(range(1, 101))))) == (1 if most == 1 << 26 else 3)
        assert {r.vec_id: (r.n_links, r.component_id) for r in near_duplicate_vectors(df).collect()} == want


def test_languages_in_blocks_and_by_plain_cosine(spark, monkeypatch):
    """Prototypes and the best cosine in NumPy alone, whatever the number of blocks."""
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcdefghijklmnop") for _ in range(3)) for _ in range(60)]
    rows = []
    for i in range(240):
        mine = random.Random(i % 24).sample(stems, 12)
        rows.append((i, " ".join(rng.choice(mine) for _ in range(rng.randint(1, 20))), f"x{i % 24}"))
    rows += [(900, None, "x1"), (901, "12 34", "x2"), (902, "", None), (904, "abc ABC", None), (905, "\u4e00" * 3000, None), (None, "abc", "never")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sums = {}
    for i, t, g in rows:
        if i is not None and i % 4 != 2 and t is not None and g is not None:
            sums[g] = sums.get(g, 0) + langid.profiles([t], 256)[0][0].astype(float)
    langs = sorted(sums)
    unit = np.array([sums[g] / max(np.linalg.norm(sums[g]), 1e-30) for g in langs])  # of a language without letters: zero
    want = {}
    for i, t, _ in rows:
        v, known = langid.profiles([t or ""], 256)
        if not known[0]:
            want[i] = {"und": 0.0}
            continue
        cosine = unit @ v[0] / max(np.linalg.norm(v[0]), 1e-30)
        want[i] = {g: min(1.0, max(0.0, c)) for g, c in zip(langs, cosine, strict=True) if c >= cosine.max() - 1e-6}
    for most in (10_000, 5):
        monkeypatch.setattr(langid, "_MOST", most)
        got = langid.identify(df, F.col("doc_id") % 4 == 2, dimensions=256).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.lang_pred in want[r.doc_id] and abs(r.score - want[r.doc_id][r.lang_pred]) < 1e-5, r
    assert {r.lang_pred for r in langid.identify(df.where("false"), F.lit(False)).collect()} == set()
    assert {(r.lang_pred, r.score) for r in langid.identify(df, F.lit(True)).collect() if r.doc_id is not None} == {("und", 0.0)}


@pytest.mark.parametrize("few", [1, 4, 48])
def test_blocks_narrowed_in_memory_have_the_parts_of_all_pairs(monkeypatch, few):
    monkeypatch.setattr(linededup, "_PAIRS", few)
    for seed in range(12):
        rng = random.Random(seed)
        t = 1 + seed % 2
        base = [[rng.randrange(6 if seed < 6 else 500) for _ in range(rng.choice([0, 3, 12, 40, 90]))] for _ in range(3)]
        lines = []
        for _ in range(120):
            x = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(x) + 1)
                x[k : k + rng.randint(0, 1)] = rng.choice([[], [rng.randrange(500)]])
            lines.append(np.array(x, np.int64).tobytes())
        names = [bytes([k]) for k in range(len(lines))]
        parts = linededup._Parts(names)
        linededup.finish([(n, True, [(t, x)]) for n, x in zip(names, lines, strict=True)], parts)
        want = list(range(len(lines)))
        for i in range(len(lines)):
            for j in range(i):
                if want[i] != want[j] and linededup.near(lines[i], lines[j], t):
                    a, b = sorted((want[i], want[j]))
                    want = [a if w == b else w for w in want]
        got = {}
        for k, n in enumerate(names):
            got.setdefault(parts.of[n], []).append(k)
        first = {k: g[0] for g in got.values() for k in g}
        assert [first[k] for k in range(len(lines))] == want, seed
        assert len(parts.links) == len(lines) - len(got)


def test_entities_and_words_of_a_text_are_not_all_put_together(spark, monkeypatch):
    """Only pairs that may tell something are shuffled: every join of texts is by the entity too, and rows are those of the possible pairs."""
    from veilframe.llm import pii

    kept, keep = {}, pii.keep
    monkeypatch.setattr(pii, "keep", lambda df, name: kept.setdefault(name, (df._jdf.queryExecution().optimizedPlan().toString(), keep(df, name)))[1] if name in ("pii-places", "pii-met") else keep(df, name))
    word = lambda k: "".join("abcdefghij"[int(c)] for c in f"{k:05d}")
    rows = []
    for i in range(60):  # a text has 20 addresses of its own beside rare words, and a shared one beside its word
        own = " ".join(f"{word(100 * i + k)} u{i}x{k}@s{i}x{k}.example {word(50_000 + 100 * i + k)}" for k in range(20))
        rows.append((i, f"{own} {'filler ' * 30} planted boss@corp.example planted" if i < 20 else own))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [rows[r.doc_id][1][t.start : t.end] for t in r.terms] for r in pii.find(df, deviations=1.2816, least=0.5).collect()}
    assert all(found[i] and set(found[i]) <= {"planted", "filler"} for i in range(20)) and not any(found[i] for i in range(20, 60))
    plan, met = kept["pii-met"]
    assert all("entity" in line for line in plan.splitlines() if "Join" in line) and "Join" in plan
    assert met.count() < 60 * 20
