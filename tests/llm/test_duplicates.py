import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_graph import thue_morse, union_find
from veilframe.llm.linededup import Tolerance, line_classes, near, within, without_repeats
from veilframe.llm.minhash import near_duplicates, signatures, without_near_duplicates
from veilframe.llm.topk import top_k
from veilframe.llm.vecdedup import near_duplicate_vectors, pair_links

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, width):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(ws[k : k + width]) for k in range(len(ws) - width + 1)) if len(ws) >= width else frozenset([tuple(ws)] if ws else [])


def brute(docs, width, percent):
    sets = {i: shingle_set(t, width) for i, t in docs}
    ids = list(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = union_find(pairs)
    return {i: (len(sets[i]), found.get(i, i)) for i in ids}


def near_copies(rng, n=150):
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    bases = [[rng.choice(words) for _ in range(rng.randint(2, 120))] for _ in range(6)]
    shared = [rng.choice(words) for _ in range(30)]
    out = []
    for i in range(n):
        ws = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 7, 12])):
            k = rng.randrange(len(ws))
            ws[k : k + 1] = rng.choice([[], [rng.choice(words)], [rng.choice(words), ws[k]]])
            ws = ws or ["x"]
        if rng.random() < 0.3:
            ws = ws[:20] + shared + ws[20:40]
        out.append((i, rng.choice([" ", "\n", "  "]).join(ws)))
    return out


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_minhash_is_brute_force(spark, width, percent):
    docs = near_copies(random.Random(4)) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "One"), (1004, "one"), (1005, "one two")]
    docs += [(2000 + k, docs[0][1].upper()) for k in range(20)]
    df = spark.createDataFrame([(i, t, i, "x") for i, t in docs], "doc_id long, text string, block long, component string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, width, percent).collect()}
    want = brute(docs, width, percent)
    assert got == want
    kept = {r.doc_id for r in without_near_duplicates(df, width=width, percent=percent).collect()}
    assert kept == {i for i, (_, c) in want.items() if c == i}


def test_minhash_edges(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (5, "a b c d e f"), (6, None), (None, None), (7, "x" * 200_000)]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(None, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (5, 2, 3, False), (6, 0, 6, True), (None, 0, None, True), (7, 1, 7, True)], key=str)


def test_densified_signatures_agree_as_jaccard():
    rng = np.random.default_rng(3)
    pool = rng.integers(1, 2**64 - 1, 4000, dtype=np.uint64)
    for n in (5, 40, 900):
        a = np.unique(pool[:n])
        b = np.unique(np.concatenate([pool[: n - n // 5], pool[2000 : 2000 + n // 5]]))
        s = signatures([a, b, np.zeros(0, np.uint64)], 128)
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - j) < 0.25 and not s[2].any() and s[0].all()


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_banded_edit_distance():
    rng = random.Random(2)
    a = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    b = []
    for x in a:
        y = bytearray(x)
        for _ in range(rng.randint(0, 5)):
            k = rng.randint(0, len(y))
            y[k : k + rng.randint(0, 1)] = rng.choice([b"", b"z", b"a"])
        b.append(bytes(y))
    for tau in (1, 2, 4):
        one, two = ([np.frombuffer(x, np.uint8) for x in xs] for xs in (a, b))
        assert within(one, two, tau).tolist() == [lev(x, y) <= tau for x, y in zip(a, b)]


def line_words(line):
    return re.findall("[\u0800-\U0010ffff]|[^\x20\x09-\x0D\u0800-\U0010ffff]+", line.translate(LOW))


def brute_lines(docs, edits, short=False):
    """{(doc_id, line): class} by comparing all lines."""
    flat = []
    for i, t in docs:
        for k, s in enumerate((t or "").split("\n")):
            line = re.sub(r"[\x20\x09-\x0D]+", " ", s.translate(LOW)).strip(" ")
            if line and i is not None:
                flat.append(((i, k), line, line_words(line)))
    allowed = lambda n: int(edits.of(np.array(n)))
    pairs = []
    for n, (p, line, ws) in enumerate(flat):
        for q, other, vs in flat[:n]:
            t = allowed(min(len(ws), len(vs)))
            if line == other or t and abs(len(ws) - len(vs)) <= t and lev(ws, vs) <= t:
                pairs.append((p, q))
    found = union_find(pairs)
    return {p: found.get(p, p) for p, _, ws in flat if short or allowed(len(ws))}


def test_near_is_edit_distance():
    rng = random.Random(8)
    for _ in range(4000):
        x = [rng.randrange(3) for _ in range(rng.randint(0, 7))]
        y = list(x) if rng.random() < 0.7 else [rng.randrange(3) for _ in range(rng.randint(0, 7))]
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(y) + 1)
            y[k : k + rng.randint(0, 1)] = rng.choice([[], [rng.randrange(3)]])
        for t in (0, 1, 2):
            assert near(np.array(x, np.int64).tobytes(), np.array(y, np.int64).tobytes(), t) == (lev(x, y) <= t)


@pytest.mark.parametrize("few", [2, 128])
@pytest.mark.parametrize(("edits", "n", "size"), [(Tolerance(3), 240, 14), (Tolerance(3, 3), 240, 14), (Tolerance(5, 9), 240, 14), (Tolerance(), 50, 150)])
def test_line_classes_are_brute_force(spark, monkeypatch, edits, n, size, few):
    monkeypatch.setattr("veilframe.llm.linededup._FEW", few)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3))) for _ in range(12)] + ["é", "春", "眠 眠"]
    base = [[rng.choice(words) for _ in range(rng.randint(size - 10, size))] for _ in range(8 if size < 20 else 2)]
    lines = []
    for _ in range(n):
        x = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(x) + 1)
            x[k : k + rng.randint(0, 1)] = rng.choice([[], ["z"], [rng.choice(words)]])
        lines.append(rng.choice([" ", "  ", " \t"]).join(x))
    lines += [rng.choice(lines).upper() for _ in range(40)]
    docs = [(i, "\n".join(lines[i * 3 : i * 3 + 3])) for i in range(len(lines) // 3)] + [(500, None), (501, ""), (502, "short\nshort"), (None, lines[0])]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, line int")
    want = brute_lines(docs, edits)
    got = {(r.doc_id, r.line): ((r.class_doc_id, r.class_line), r.kept) for r in line_classes(df, edits).collect()}
    assert got == {p: (c, p == c) for p, c in want.items()}


def test_lines_of_one_template_cost_what_their_number_does(spark):
    """Lines with one head and random words: what is written grows with the lines, not with their pairs."""
    from veilframe.llm import graph, linededup

    rng = random.Random(6)
    rand = lambda: "".join(rng.choice("abcdef0123456789") for _ in range(16))
    lines = [f"2024-01-01 info request handled for user in zone a with id {rand()} {rand()}" for _ in range(1500)]
    lines += [f"2024-01-01 info request handled for user in zone b with id {rand()}" for _ in range(1500)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "doc_id long, text string")
    written, real = [], graph.keep

    def counted(table, name):
        out = real(table, name)
        written.append(out.count())
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(graph, "keep", counted)
        m.setattr(linededup, "keep", counted)
        got = {r.doc_id: r.class_doc_id for r in line_classes(df).collect()}
    assert got == {i: i if i < 1500 else 1500 for i in range(3000)}
    assert max(written) < 20 * len(lines)


def test_lines_and_shingles_of_thue_morse_strings_stay_apart(spark):
    a, b = (x.decode() for x in thue_morse(11))
    df = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 1}
    assert {r.doc_id: r.class_doc_id for r in line_classes(df, short=True).collect()} == {1: 1, 2: 2, 3: 1}


def test_repeated_ids_are_judged_by_their_own_text(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(20)) for x in "abc")
    rows = [(1, f"{a}\n{b}"), (2, f"{a}\nx x"), (2, f"{c}\nonly here"), (2, f"{c}\nonly here"), (None, f"{a}\n{b}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in without_repeats(df, rest=True, short=True).collect()), key=str)
    assert got == sorted([rows[0], (2, "x x"), rows[2], rows[3], rows[4]], key=str)
    near = [(5, c), (5, a), (3, f"{c} z"), (None, f"{a} y"), (None, "q"), (None, "q"), (9, None), (9, None), (5, a)]
    df = spark.createDataFrame([(*r, 1) for r in near], "doc_id long, text string, near_row int")
    got = sorted(((r.doc_id, r.text) for r in without_near_duplicates(df).collect()), key=str)
    assert got == sorted([(3, f"{c} z"), (5, a), (None, "q"), (9, None), (9, None)], key=str)


def test_lines_that_repeat_go(spark):
    a, b, c = "the first line of some length that stands here", "another line that is long enough for a tolerance", "a third line, and the last of all of them"
    rows = [(1, f"{a}\nhi\n{b}", "s", 5), (2, f"{b}\nhi\n{c}", "s", 5), (3, f"{a}\nhi", "s", 5), (4, "hi", "s", 2), (5, None, None, None), (None, f"{a}", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in without_repeats(df).collect()}
    assert got == {1: (rows[0][1], 5), 2: (f"hi\n{c}", len(c) + 3), 4: ("hi", 2), 5: (None, None), None: (a, 1)}
    assert line_classes(df.where("false")).count() == 0 and without_repeats(df.where("false")).columns == df.columns


def test_documents_keep_what_repeats_nothing(spark):
    import corpus_pipeline

    a = "a licence line that many files have at their start"
    rows = [(1, f"{a}\nrose"), (2, f"{a}\nsaffron\n\nthyme"), (3, f"{a}\n \t\n"), (4, f"{a}\n春眠不覚暁")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, df, "").collect()}
    assert got == {1: rows[0][1], 2: "saffron\n\nthyme", 4: "春眠不覚暁"}


def test_short_lines_are_grouped_exactly(spark):
    import corpus_pipeline

    long = "a line of words that is long enough to be joined"
    rows = [(1, f"All rights.\n\n{long}\nIetzte."), (2, f" ietzte.\nIetzte,\n{long}s\n春眠\n "), (3, "春眠\nown"), (4, "ietzte.\nIetzte.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.line): (r.class_doc_id, r.class_line, r.copies, r.kept) for r in line_classes(df, short=True).collect()}
    want = {(1, 0): (1, 0, 1, True), (1, 2): (1, 2, 2, True), (1, 3): (1, 3, 4, True), (2, 0): (1, 3, 4, False), (2, 1): (2, 1, 1, True), (2, 2): (1, 2, 2, False)}
    want |= {(2, 3): (2, 3, 2, True), (3, 0): (2, 3, 2, False), (3, 1): (3, 1, 1, True), (4, 0): (1, 3, 4, False), (4, 1): (1, 3, 4, False)}
    assert got == want
    left = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, df, "").collect()}
    assert left == {1: rows[0][1], 2: "Ietzte,\n春眠\n ", 3: "own"}


def test_vectors_are_brute_force(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(12, 16))
    rows = [(int(i), (base[i % 12] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.12])).astype(np.float32).tolist(), int(i % 2) if i % 11 else None) for i in range(260)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [], 1), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1), (907, [-0.0, 1.0], 1), (908, [0.0, 3.0], 1)]
    df = spark.createDataFrame([(i, v, lab, 0) for i, v, lab in rows], "vec_id long, embedding array<float>, label int, n long")
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(a[0], b[0]) for k, a in enumerate(ok) for b in ok[:k] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.98]
    found = union_find(links)
    n = {i: 0 for i, _, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(df, tile=16).collect()}
    assert links and got == {i: (n[i], found.get(i, i), found.get(i, i) == i) for i, _, _ in rows}
    assert near_duplicate_vectors(df.where("false")).count() == 0


def test_suffix_bounds_lose_no_pair():
    x = np.random.default_rng(1).normal(size=(60, 40))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = pair_links(x, x, 0.2, True)
    assert set(zip(i, j)) == set(zip(*np.nonzero(np.triu(x @ x.T >= 0.2 - 1e-12, 1))))


def test_top_k_is_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(int(i), (rng.normal(size=12) * 0.05).astype(np.float32).tolist()) for i in range(300)]
    rows += [(400, None), (401, [float("inf")] * 12), (402, [None] * 12), (420, [1e7] * 12), (440, [-3e12] + [0.0] * 11), (460, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    ok = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    want = {}
    for i, q in ok:
        if i % 20 == 0:
            best = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i))[:7]
            want[i] = [(j, -s) for s, j in best]
    got = {}
    for r in top_k(df, F.col("vec_id") % 20 == 0, k=7, shard=40, block=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want
    assert top_k(df.limit(3), F.col("vec_id") % 20 == 0, k=7).count() == 2
    assert top_k(df.where("false"), F.lit(True)).count() == 0


@pytest.mark.parametrize("few", [2, 5, 64])
def test_families_within_families_lose_no_link(spark, monkeypatch, few):
    """Members of one block with shared deviations: components are those of all pairs, however few are compared at once."""
    from veilframe.llm import minhash

    monkeypatch.setattr(minhash, "_FEW", few)
    rng = random.Random(11)
    sides = [[1000 * s + k for k in range(14)] for s in range(1, 7)]
    sets = {}
    for i in range(160):
        own = set(range(60)) - set(rng.sample(range(60), rng.randint(0, 4))) | set(rng.sample(rng.choice(sides), rng.randint(0, 12)))
        sets[f"{i:04d}".encode()] = own | {10_000 + 10 * i + k for k in range(rng.randint(0, 4))}
    open_ = spark.createDataFrame([(1, i, i) for i in sets], "block long, id binary, component binary")
    full = spark.createDataFrame([(i, len(s), list(s)) for i, s in sets.items()], "id binary, n_shingles long, shingles array<long>")
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    got = {tuple(sorted((bytes(r.id), bytes(r.other)))) for r in minhash.rest_pairs(open_, full, 80).collect()}
    ids = sorted(sets)
    assert union_find([p for p in got if linked(*p)]) == union_find([(a, b) for k, a in enumerate(ids) for b in ids[:k] if linked(a, b)])


def test_a_member_of_many_shared_elements_is_in_few_families(spark):
    """Ten elements of which each misses one of 100 members make one family of theirs; too large for that, one each."""
    from veilframe.llm.minhash import _hot

    rows = [(1, 10 * i + e, e, f"{i:03d}".encode()) for i in range(100) for e in range(10) if i != 90 + e]
    each = spark.createDataFrame([(f, e, i) for f, _, e, i in rows], "family long, e long, id binary")
    first = each.groupBy("family", "e").agg(F.min("id").alias("lead"))
    for members, families, most in ((200, 1, 100), (150, 10, 990)):
        got = _hot(each, first, spark.createDataFrame([(1, members)], "family long, members long"))
        assert (got.select("family").distinct().count(), got.count(), got.distinct().count()) == (families, most, most)


def test_members_that_few_have_first_make_no_family(spark, monkeypatch):
    """An element that many members have, but none among its first, is no reason to compare them."""
    from veilframe.llm import minhash

    rounds, pairs = [], minhash._family_pairs
    monkeypatch.setattr(minhash, "_family_pairs", lambda rows, percent: rounds.append(rows.count()) or pairs(rows, percent))
    monkeypatch.setattr(minhash, "_FEW", 20)
    # 80 of 200 share 40 elements, but 70 of these have 50 rarer ones each, shared with one other member.
    side = set(range(500, 540))
    rare = lambda i: {1000 + 50 * (i // 2) + k for k in range(50)} if i < 70 else set()
    sets = {i: set(range(100)) | (side | rare(i) if i < 80 else {900 + i}) for i in range(200)}
    ids = {i: f"{i:04d}".encode() for i in sets}
    open_ = spark.createDataFrame([(1, x, x) for x in ids.values()], "block long, id binary, component binary")
    full = spark.createDataFrame([(ids[i], len(s), list(s)) for i, s in sets.items()], "id binary, n_shingles long, shingles array<long>")
    minhash.rest_pairs(open_, full, 80).count()
    assert rounds == [200]
