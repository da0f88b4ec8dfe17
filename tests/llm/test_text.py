import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm.langid import identify
from veilframe.llm.mixing import mix, mixed, targets, word_count
from veilframe.llm.packing import pack, shortest_pack_first, slots
from veilframe.llm.pii import KINDS, digest, entities, find, luhn, sanitise
from veilframe.llm.queries import TOKENIZER
from veilframe.llm.secrets import BASE, MORE, find_secrets, trigram_query
from veilframe.llm.toxicity import score, without_toxic

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t", "x" * 150_000, "é" * 50_000, "a<|endoftext|>b 's IT'S", "ΑΣ. ½ 一二\x85y", "same", "same"]


def odd(spark):
    return spark.createDataFrame([(i, t, "en", None, 0) for i, t in enumerate(ODD)] + [(None, "no id", "en", "s", 0)], DOCS)


def test_packing(spark):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Alpha", "beta,", "gamma.", "é.", "12", "don't", "x!!"]) for _ in range(rng.choice([1, 9, 60, 700]))) for _ in range(120)]
    rows = [(100 + i, t, "en", "s", 0) for i, t in enumerate(texts)]
    df = odd(spark).where("doc_id is not null").union(spark.createDataFrame(rows, DOCS))
    tok = Tokenizer.from_file(TOKENIZER)
    got = pack(df, TOKENIZER, size=256).collect()
    by, seq = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
    docs = dict([*enumerate(ODD), *[(r[0], r[1]) for r in rows]])
    assert set(by) == set(docs)
    for i, t in docs.items():
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for rs in seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256 and rs[0].padded == (at if at & (at - 1) == 0 else 256)
    assert sorted(seq) == list(range(len(seq)))
    padded = sum(rs[0].padded for rs in seq.values())
    assert 1 - sum(r.length for r in got) / padded < 0.02
    assert pack(df.where("false"), TOKENIZER).count() == 0


def test_shortest_pack_first():
    h = {7: 3, 5: 2, 3: 4, 1: 6}
    patterns = shortest_pack_first(h, 10)
    assert Counter({k: sum(p.count(k) * n for p, n in patterns) for k in h}) == Counter(h)
    assert all(sum(p) <= 10 and list(p) == sorted(p, reverse=True) for p, _ in patterns)
    assert shortest_pack_first({3: 8}, 10) == [((3, 3, 3), 2), ((3, 3), 1)]
    ranks = {}
    for length, first, n, *_ in slots(patterns):
        ranks.setdefault(length, []).extend(range(first, first + n))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in h.items()}


def labelled(rng, n):
    words = ["".join(rng.choice("aeioustrn") for _ in range(5)) for _ in range(200)]
    out = []
    for i in range(n):
        ws = [rng.choice(words) for _ in range(30)]
        toxic, junk = i % 5 == 0, i % 4 == 1
        if toxic:
            ws[rng.randrange(30)] = rng.choice(["Vile!", "vileness", "rotten"])
        if junk:
            ws += ["click", "here"] * 3
        out.append((i, " ".join(ws), int(not junk), int(toxic)))
    return out


def test_toxicity(spark):
    rows = labelled(random.Random(1), 400)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t, _, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, q, x, "z") for i, _, q, x in rows[:250]] + [(1, None, 1, "z"), (9999, 1, 1, "z"), (0, 1, 1, "z")], "doc_id long, quality int, toxic int, text string")
    got = {r.doc_id: r for r in score(docs, labels).collect()}
    held = [r for r in rows[250:]]
    assert all(got[i].toxic == bool(x) for i, _, _, x in held)
    assert np.mean([(got[i].p_junk > 0.5) == (not q) for i, _, q, _ in held]) > 0.95
    kept = without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if not got[i].toxic}
    assert [tuple(r) for r in score(docs, labels).orderBy("doc_id").collect()] == [tuple(got[i]) for i in sorted(got)]


def test_toxicity_edges(spark):
    docs = odd(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.toxic for r in score(docs, none).collect()} == {False} and score(docs, none).count() == docs.count()
    one = spark.createDataFrame([(7, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.toxic for r in score(docs, one).collect()} == {False}
    assert score(docs.where("false"), one).count() == 0


E_ = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
I_ = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
C_ = re.compile(r"[0-9]([\x20-]?[0-9])+")
P_ = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(t):
    out = []
    for k, p in enumerate((E_, I_, C_, P_)):
        for m in p.finditer(t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 12 <= len(d) <= 19 and luhn(d) or k == 3 and 9 <= len(d) <= 15:
                out.append((k, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def test_pii_patterns():
    rng = random.Random(1)
    bits = ["a", "b@", "@", ".", "c", "-", "1", "22", "4", "+", "(", ")", " ", "_", "%", "é", "\n", "4111 1111 1111 1111", "+1 555", "1.2.3.4", ".5", "256", "a@b.c"]
    for _ in range(5000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert entities(t) == brute_pii(t), t
    assert entities("1" * 200_000) == [] and entities("a" * 200_000) == [] and entities("a.b" * 50_000 + "@") == []


def test_pii_terms_and_digest(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("aeioustrn") for _ in range(6)) for _ in range(60)]
    rows = []
    for i in range(200):
        ws = [rng.choice(words) for _ in range(20)]
        if i % 20 == 0:
            ws[10:10] = ["Zorblax", "bob@corp.example", rng.choice(words)]
        rows.append((100 + i, " ".join(ws), "en", "s", 0))
    df = spark.createDataFrame(rows, DOCS).union(odd(spark))
    found = {r.doc_id: r for r in digest(find(df)).collect()}
    for i, t, *_ in rows:
        base = brute_pii(t)
        joined = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert found[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and found[i].n_email == len([b for b in base if b[0] == 0])
        terms = [s.split(":") for s in found[i].spans.split(",") if s.startswith("term")]
        assert {t[int(a) : int(b)] for _, a, b in terms} == ({"Zorblax"} if base else set())
    assert found[100].spans == f"term:{rows[0][1].index('Zorblax')}:{rows[0][1].index('Zorblax') + 7},email:{rows[0][1].index('bob@')}:{rows[0][1].index('bob@') + 16}"
    clean = {r.doc_id: r.text for r in sanitise(df).collect()}
    assert "<TERM> <EMAIL>" in clean[100] and clean[101] == rows[1][1] and clean[None] == "no id"
    assert digest(find(df.where("false"))).count() == 0


def test_pii_terms_of_rare_entities(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("aeioustrn") for _ in range(6)) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(300)]
    rows[7] = (7, rows[7][1] + " Quixby ann@one.example " + rows[8][1])  # a value of one text
    for i in range(20, 26):  # six values, each of one text, one word beside them
        rows[i] = (i, rows[i][1] + f" Helpdesk u{i}@site{i}.example " + rows[i + 50][1])
    found = {r.doc_id: r.terms for r in find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    told = {i: {t[s.start : s.end] for s in found[i]} for i, t in rows}
    assert told == {i: {"Quixby"} if i == 7 else {"Helpdesk"} if 20 <= i < 26 else set() for i, _ in rows}


def test_pii_terms_stand_in_the_whole_document(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioustrn") for _ in range(6)) for _ in range(40)]
    fill = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, fill(60)) for i in range(200)]
    for i in range(8):  # beside the entity in four texts only, far from it in all
        near = "Zorblax" if i < 4 else "aaaaaa"
        rows[i] = (i, f"Zorblax {fill(30)} {near} bob@corp.example {fill(30)} zorblax.")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.end) for s in r.terms] for r in find(df).collect()}
    want = {i: [m.span() for m in re.finditer("zorblax", t.lower())] for i, t in rows}
    assert {i: [p for p in found[i] if p in want[i]] for i in want} == want
    assert not any("zorblax" in r.text.lower() for r in sanitise(df).collect())


def brute_secrets(t):
    out = []
    for k, r in enumerate(BASE + MORE):
        for m in re.finditer(r.pattern, t or "", re.A):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), k, m.end(), r.kind))
    return sorted(out)


def test_secrets_are_brute_force(spark):
    rng = random.Random(3)
    bits = ["password", "PassWD", "secret", "token", "api_key", "apikey", "=", ":", '"', "'", " ", "abcdefghijkl", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "😀", "\n", "ghp_" + "a1" * 18, "eyJhbGciOiJ.eyJzdWIiOiIx.abcdefghij", "-----BEGIN RSA PRIVATE KEY-----", "xoxb-1234567890-a", "/", "hello"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(400)] + ODD
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, 'token="abcdefghijklmnop"', 1)], "doc_id long, text string, rules int")
    got = {r.doc_id: r for r in find_secrets(df).collect()}
    assert len(got) == len(texts) + 1 and got[None].spans == "assign:0:23"
    for i, t in enumerate(texts):
        want = brute_secrets(t)
        base = ",".join(f"{k}:{a}:{b}" for a, n, b, k in want if n < 3)
        assert got[i].spans == ",".join(f"{k}:{a}:{b}" for a, _, b, k in want), t
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(w[1] == n for w in want) for n in range(3))
    assert find_secrets(df.where("false")).count() == 0


def test_trigram_queries():
    assert trigram_query("[0-9a-f]+") == [] and trigram_query("abc|d") == [] and trigram_query("(ab)?cdef") == [frozenset({"cde", "def"})]
    assert trigram_query("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})] and trigram_query("a.c") == []
    assert trigram_query("abcdefgh") == [frozenset({"abc", "fgh"})]
    assert set(trigram_query("(?:foo|bars)x?")) == {frozenset({"foo"}), frozenset({"bar", "ars"})}


def water(sizes, weights, share, most):
    names = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, got, left = share * sum(sizes.values()), {}, set(names)
    while left:
        rest = total - sum(got.values())
        unit = rest / sum(w[n] for n in left)
        full = {n for n in left if w[n] * unit >= most * sizes[n]}
        if not full:
            return got | {n: w[n] * unit for n in left}
        for n in full:
            got[n] = most * sizes[n]
        left -= full
    return got


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 80, 400, 3000]))), "en", rng.choice(["a", "a", "a", "b", "c", "é", "D", None]), 0) for i in range(500)]
    df = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", size int").union(odd(spark).withColumn("size", F.lit(1)))
    got = [r.asDict() for r in mix(df).collect()]
    source = {r[0]: r[3] for r in rows}
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    text = {r[0]: r[1] for r in rows[len(ODD) :]}
    sizes = Counter()
    for r in df.collect():
        sizes[r.source] += size(r.text)
    want = water(dict(sizes), (5.0, 2.0, 1.0), 1.5, 2)
    assert len(got) == df.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert all(r["size"] == size(text[r["doc_id"]]) for r in got if r["doc_id"] in text)
    taken = Counter()
    for r in got:
        if r["doc_id"] in text:
            s = source[r["doc_id"]]
            assert abs(r["target"] - want[s]) < 1e-6 * max(1, want[s]) and r["source_size"] == sizes[s]
        taken[r["target"]] += r["taken"]
    assert all(abs(taken[t] - t) <= max(1, 0.01 * t) for t in taken)
    key = lambda r: str(sorted(r.items(), key=str))
    assert sorted(map(key, got)) == sorted(map(key, (r.asDict() for r in mix(df.repartition(7)).collect())))
    out = mixed(df)
    assert out.columns == df.columns and out.select(F.sum(word_count(F.col("text")))).first()[0] == sum(r["taken"] for r in got)
    assert mix(df.where("false")).count() == 0


def test_the_pipeline_mixes_whole_texts(spark):
    import corpus_pipeline

    rng = random.Random(7)
    rows = [(i, "\n".join("w" * rng.randint(1, 9) for _ in range(rng.choice([3, 40, 200]))), "en", rng.choice("abc"), 0) for i in range(120)]
    rows += [(500, "one\ntwo three", "en", "c", 0)] * 40
    df = spark.createDataFrame(rows, DOCS)
    out = corpus_pipeline.mixing(spark, df, "").collect()
    text = {r[0]: r[1] for r in rows}
    assert out and all(r.text == text[r.doc_id] for r in out)
    got, dealt = Counter(r.doc_id for r in out), Counter(r[0] for r in rows)
    assert all(got[i] <= 2 * dealt[i] for i in got) and 0 < got[500] < 80
    longest = max(len(t.split()) for t in text.values())
    target = {r.source_size: r.target for r in mix(df).collect()}
    for s in "abc":
        size = sum(len(r[1].split()) for r in rows if r[3] == s)
        assert abs(sum(len(r.text.split()) for r in out if r.source == s) - target[size]) <= longest


def test_targets_stop_at_their_caps(spark):
    sizes = {"a": 10, "b": 1000, "c": 0, None: 100}
    got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (5.0, 2.0, 1.0), 1.5, 2).collect()}
    assert got == pytest.approx(water(sizes, (5.0, 2.0, 1.0), 1.5, 2))


def test_languages(spark):
    rng = random.Random(8)
    kinds = {"xx": "aeioulmn", "yy": "schtzkrwü", "zz": "日月火水木金"}
    rows = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(5)) for _ in range(20)), k, "s", 0) for i in range(120) for k in [sorted(kinds)[i % 3]]]
    df = spark.createDataFrame(rows + [(900, "123 !?", "xx", "s", 0), (901, None, "yy", "s", 0), (902, "aeiou", None, "s", 0), (None, "schtz", "zz", "s", 0)], DOCS)
    got = {r.doc_id: r for r in identify(df, F.crc32(F.col("doc_id").cast("string")) % 4 == 2).collect()}
    assert all(got[i].lang_pred == k and 0 < got[i].score <= 1 for i, _, k, *_ in rows)
    assert [got[i].held_out for i in range(120)] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(120)]
    assert (got[900].lang_pred, got[900].score, got[901].lang_pred) == ("und", 0.0, "und") and got[902].lang_pred == "xx"
    assert got[None].lang_pred == "yy" and got[None].held_out is False
    assert {r.lang_pred for r in identify(df.withColumn("lang", F.lit(None).cast("string")), F.lit(False)).collect()} == {"und"}
    assert identify(df.where("false"), F.lit(False)).count() == 0


def test_languages_do_not_depend_on_other_columns(spark):
    rows = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate([("aeiou lemon", "xx"), ("schtzk wrk", "yy")] * 20)]
    df = spark.createDataFrame(rows, DOCS)
    held = F.col("doc_id") >= 30
    a = identify(df, held).orderBy("doc_id").collect()
    b = identify(df.withColumn("lang", F.when(~held, F.col("lang")).otherwise("yy")).withColumn("source", F.lit("t")), held).orderBy("doc_id").collect()
    assert a == b
