"""Personal data, and the terms around it that give it away.

Patterns find the protected entities: e-mail addresses, IP addresses, card and phone
numbers. Then the corpus tells which words disclose an entity that they stand beside. An
entity is looked at as a value, as the domain of an e-mail address, and as a kind, so
that values of one or two texts have evidence too. Of N documents n hold the entity, k
the term and m both; x different texts hold the term within ``window`` words of the
entity. The chance of the entity where the term stands is smoothed towards n / N,

    q = (x m / k + prior n / N) / (x + prior),

and the pointwise mutual information log(q N / n) is held against the entity's information
content log(N / n). A term is disclosive if that ratio reaches ``disclosure``. With
``deviations`` above 0, q is taken at the lower end of its score interval over x + prior
texts, so that a word of one text tells nothing about a value of one text, which any rare
word stands beside; and that end has to reach ``least``, as the ratio alone asks less of q
the larger the corpus is. Values of one text have their domains and kinds as evidence. All its
occurrences in the documents that hold the entity become spans of kind ``term``;
``sanitise`` replaces them by a general word, and entities by their kind.

Windows keep the pairs proportional to the mentions. Documents that hold no entity get
no span. Counting the terms' documents reads all texts once more. Terms that could not
reach ``disclosure`` even if all their documents held the entity leave then, and the
others are looked up in the documents with entities; Bloom filters of bounded size pick
the terms that matter, and exact joins follow.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm import _text
from veilframe.llm._bloom import Bloom
from veilframe.llm._store import keep

#: The kinds in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")
#: Distinct words that are counted before they are passed on.
_WORDS = 1 << 17
#: Pairs of entities and words of a text that are looked up at once.
_PAIRS = 1 << 18
_MET = "doc_id long, h long, entity long, term long, starts array<long>, ends array<long>"
_FOUND = "doc_id long, h long, base array<struct<kind:int,start:long,end:long>>, pairs array<struct<entity:long,term:long>>"

Span = tuple[int, int, int]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of addresses; each @ is read once, so runs without one cost nothing."""
    done, at = 0, text.find("@")
    edge = 0  # of what may belong to the local part
    while at >= 0:
        start = edge + len(text[edge:at].rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        edge = max(done, at + 1)
        at = text.find("@", edge)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def entities(text: str) -> list[Span]:
    """(kind, start, end) of the base kinds, each leftmost and non-overlapping."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], s[0]))


def _hash(texts: list[str]) -> np.ndarray:
    """A signed 64-bit hash of each string."""
    data, offsets = _text.buffers(pa.array(texts, pa.string()))
    return _text.span_hash(_text.prefix_hashes(data, np.arange(256, dtype=np.uint8)), offsets[:-1], offsets[1:]).view(np.int64)


def _around(text: str, base: list[Span], window: int) -> list[tuple[int, int, int]]:
    """(number of the span, start, end) of the words that stand beside a span."""
    found = []
    for k, (_, start, end) in enumerate(base):
        # Words are looked for in a stretch that widens until it holds enough of them.
        for side in (-1, 1):
            reach, words = window * 16, []
            while True:
                lo, hi = (max(0, start - reach), start) if side < 0 else (end, min(len(text), end + reach))
                words = [m.span() for m in _WORD.finditer(text, lo, hi)]
                whole = lo == 0 if side < 0 else hi == len(text)
                if whole or len(words) > window:
                    break
                reach *= 4
            if not whole:  # the outermost may be cut
                words = words[1:] if side < 0 else words[:-1]
            found += [(k, a, b) for a, b in (words[-window:] if side < 0 else words[:window])]
    return found


def _levels(kind: int, value: str) -> list[str]:
    """The entity as a value, as a domain and as a kind."""
    domain = [f"{kind}@{value.rpartition('@')[2]}"] if kind == 0 else []
    return [f"{kind}:{value}", *domain, f"{kind}"]


def _find(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base, flat, owners = [], [], []
            for k, t in enumerate(texts):
                spans = entities(t)
                base.append([{"kind": a, "start": b, "end": c} for a, b, c in spans])
                covered = _covered(t, spans) if spans else None
                for n, a, b in _around(t, spans, window):
                    if covered[a] == covered[b]:
                        kind, x, y = spans[n]
                        for e in _levels(kind, t[x:y].lower()):
                            flat.append((e, t[a:b].lower()))
                            owners.append(k)
            entity, term = _hash([f[0] for f in flat]), _hash([f[1] for f in flat])
            pairs: list[list[dict]] = [[] for _ in texts]
            for k, e, w in zip(owners, entity.tolist(), term.tolist(), strict=True):
                pairs[k].append({"entity": e, "term": w})
            kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
            pair = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64())]))
            yield pa.RecordBatch.from_arrays([ids, batch.column(2), pa.array(base, kind), pa.array(pairs, pair)], ["doc_id", "h", "base", "pairs"])

    return run


def _covered(text: str, spans: list[Span]) -> np.ndarray:
    """How many characters before each place are part of a span."""
    edge = np.zeros(len(text) + 1, np.int32)
    for _, a, b in spans:
        edge[a] += 1
        edge[b] -= 1
    return np.concatenate([[0], np.cumsum(np.cumsum(edge) > 0)])


def _count_terms(wanted: Bloom):
    """(term, n): in how many of some texts each wanted term stands."""

    def counts(seen: Counter[str]) -> pa.RecordBatch:
        h, n = _hash(list(seen)), np.fromiter(seen.values(), np.int64, len(seen))
        some = wanted.has(h)
        return pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(n[some])], ["term", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0):  # a text at a time
                if t.is_valid:
                    seen.update({w.lower() for w in set(_WORD.findall(t.as_py()))})
                if len(seen) > _WORDS:  # words are hashed once, in how many texts they may stand
                    yield counts(seen)
                    seen.clear()
        if seen:
            yield counts(seen)

    return run


def _met(wanted: Bloom, possible: Bloom, holders: Bloom):
    """(doc_id, h, entity, term, starts, ends): the possible pairs of the entities and the words of a text, and where these stand.

    holders: the texts with entities; of the others nothing is read.
    """
    names = ["doc_id", "h", "entity", "term", "starts", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n_found = [], 0
            known = batch.column(2).fill_null(0).to_numpy()
            for k in np.flatnonzero(holders.has(known)).tolist():
                t = batch.column(1)[k].as_py()
                taken = entities(t) if t else []
                if not taken:
                    continue
                covered = _covered(t, taken)
                words = [(m[0].lower(), *m.span()) for m in _WORD.finditer(t) if covered[m.start()] == covered[m.end()]]
                h = _hash([w[0] for w in words])
                some = np.flatnonzero(wanted.has(h))
                if not len(some):
                    continue
                some = some[np.argsort(h[some], kind="stable")]
                term, first = np.unique(h[some], return_index=True)
                edge = np.append(first, len(some))
                start, end = (np.array([words[i][c] for i in some.tolist()], np.int64) for c in (1, 2))
                entity = np.unique(_hash([e for kind, a, b in taken for e in _levels(kind, t[a:b].lower())]))
                step = max(1, _PAIRS // len(term))
                for lo in range(0, len(entity), step):
                    each = entity[lo : lo + step]
                    e, w = np.nonzero(possible.has(_pair(each[:, None], term[None, :]).reshape(-1)).reshape(len(each), len(term)))
                    if not len(e):
                        continue
                    n = edge[w + 1] - edge[w]
                    ends = np.concatenate([[0], np.cumsum(n)])
                    at = np.repeat(edge[w] - ends[:-1], n) + np.arange(ends[-1])
                    places = [pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(x[at])) for x in (start, end)]
                    own = [batch.column(c).take(pa.array(np.full(len(e), k))) for c in (0, 2)]
                    found.append([*own, pa.array(each[e]), pa.array(term[w]), *places])
                    n_found += len(e)
                    if n_found > _PAIRS:
                        yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*found, strict=True)], names)
                        found, n_found = [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*found, strict=True)], names)

    return run


def _pair(entity: np.ndarray, term: np.ndarray) -> np.ndarray:
    """The hash of a pair of hashes; ``_PAIR`` is the same in Spark."""
    term = term.view(np.uint64)
    return entity ^ ((term << np.uint64(1)) | (term >> np.uint64(63))).view(np.int64)


_PAIR = "entity ^ (shiftleft(term, 1) | shiftrightunsigned(term, 63))"


def _filter(pairs: DataFrame) -> Bloom:
    """The filter of a table's terms."""
    return Bloom(keep(pairs.select("term").distinct(), "pii-terms"), F.col("term"))


def _held(both: DataFrame, each: DataFrame) -> DataFrame:
    """both with n of its entity. Entities of a thousandth of all (text, entity) are sent to all tasks: a thousand at most."""
    line = (each.agg(F.sum("n")).first()[0] or 0) / 1000
    hot, rest = F.broadcast(each.where(F.col("n") >= line)), each.where(F.col("n") < line)
    return both.join(hot, "entity").union(both.join(hot.select("entity"), "entity", "left_anti").join(rest, "entity"))


def find(docs: DataFrame, window: int = 10, disclosure: float = 0.9, prior: float = 0.5, deviations: float = 0.0, least: float = 0.0) -> DataFrame:
    """(doc_id, h, base, terms) of every row: spans of entities and of disclosive terms.

    deviations: how many standard deviations below its estimate the chance of an entity
    beside a term is taken; 0 is the estimate itself. least: what that chance has to reach.

    base: (kind number, start, end) in order of start and kind; terms: (start, end) in
    order; code points, end exclusive. h is a hash of the text. docs: doc_id long, text
    string; other columns are ignored. Null, empty and blank texts have no spans, but count as
    documents, and so do repeated rows. Rows without a doc_id are read like any other. An empty
    table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    found = keep(rows.mapInArrow(_find(window), _FOUND), "pii-found")
    some = found.where(F.size("pairs") > 0)
    total = found.count()
    pairs = some.select("h", F.explode(F.array_distinct("pairs")).alias("p")).select("h", "p.*").distinct()
    both = keep(pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("x")), "pii-pairs")
    none = F.array().cast("array<struct<start:long,end:long>>")
    if both.isEmpty():
        return found.select("doc_id", "h", "base", none.alias("terms"))
    holders = some.select("doc_id", "h", F.explode(F.array_distinct(F.transform("pairs", lambda p: p["entity"]))).alias("entity"))
    each = keep(holders.groupBy("entity").agg(F.count(F.lit(1)).alias("n")), "pii-entities")
    known = rows.select("text").mapInArrow(_count_terms(_filter(both)), "term long, n long").groupBy("term").agg(F.sum("n").alias("k"))

    def tells(m: Column) -> Column:
        """Grows with m, so that the most it could be says which terms are possible."""
        n, texts, z2 = F.col("n"), F.col("x") + F.lit(prior), F.lit(deviations**2)
        q = (F.col("x") * m / F.col("k") + F.lit(prior) * n / total) / texts
        if deviations:
            q = (q + z2 / (2 * texts) - deviations * F.sqrt(q * (1 - q) / texts + z2 / (4 * texts * texts))) / (1 + z2 / texts)
        return (F.log(q * total / n) / F.log(total / n) >= disclosure) & (q >= least)

    both = _held(both, each).join(known, "term").where(F.col("n") < total)
    both = keep(both.where(tells(F.least("n", "k"))), "pii-possible")
    if both.isEmpty():
        return found.select("doc_id", "h", "base", none.alias("terms"))
    # Where a text's entities and words meet, a filter of the possible pairs is asked before anything is shuffled.
    read = _met(_filter(both), Bloom(both, F.expr(_PAIR)), Bloom(some, F.col("h")))
    met = rows.select("doc_id", "text", "h").mapInArrow(read, _MET).join(both, ["entity", "term"])
    met = keep(met.dropDuplicates(["doc_id", "h", "entity", "term"]), "pii-places")
    # A row's doc_id and text, however often they are repeated.
    alike = holders.groupBy("doc_id", "h", "entity").agg(F.count(F.lit(1)).alias("rows"))
    same = F.col("a.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("a.h") == F.col("p.h")) & (F.col("a.entity") == F.col("p.entity"))
    met = alike.alias("a").join(met.alias("p"), same).select("p.*", "rows")
    met = keep(met.withColumn("spans", F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"))).drop("starts", "ends"), "pii-met")
    tell = met.groupBy("entity", "term").agg(F.sum("rows").alias("m"), *[F.first(c).alias(c) for c in ("x", "n", "k")])
    tell = tell.where(tells(F.least("m", "k"))).select("entity", "term")
    spans = met.join(tell, ["entity", "term"]).select("doc_id", "h", F.explode("spans").alias("s"))
    spans = spans.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("s")).alias("terms"))
    same = F.col("f.doc_id").eqNullSafe(F.col("s.doc_id")) & F.col("f.h").eqNullSafe(F.col("s.h"))
    out = found.alias("f").join(spans.alias("s"), same, "left")
    return out.select("f.doc_id", "f.h", "f.base", F.coalesce("s.terms", none).alias("terms"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_<kind>, base_sha256 and spans of every row of ``find``.

    spans joins kind:start:end by commas, in order of start, then of kind, then of end;
    base_sha256 is the lower-case hexadecimal SHA-256 of that string of entities alone.
    Null or empty text has none. Rows without a doc_id and repeated rows are read like
    any other, each on its own text. An empty table gives an empty result.
    """
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])

    def joined(spans: Column) -> Column:
        each = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(each, ",")

    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    term = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), s["end"].alias("end")))
    counts = [_count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(F.array_sort(base)), 256).alias("base_sha256"), joined(F.array_sort(F.concat(base, term))).alias("spans"))


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def _replace(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, word in sorted(spans):
        if start >= at:
            out += [text[at:start], word]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text) of every row: the texts with entities and disclosive terms replaced.

    docs: doc_id long, text string; other columns are ignored. Where spans overlap the first
    one is replaced. Null, empty and blank texts, and texts without spans, stay as they are.
    Rows without a doc_id and repeated rows are read like any other, each by its own text. An
    empty table gives an empty result.
    """
    found = find(docs, **options)
    h = F.xxhash64(F.col("text").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h"))
    found = found.where((F.size("base") > 0) | (F.size("terms") > 0)).dropDuplicates(["doc_id", "h"])
    same = F.col("f.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("f.h") == F.col("r.h"))
    both = rows.alias("r").join(found.alias("f"), same, "left").select("r.doc_id", "r.text", "f.base", "f.terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, base, terms in zip(*[batch.column(k).to_pylist() for k in (1, 2, 3)], strict=True):
                spans = [(s["start"], s["end"], f"<{KINDS[s['kind']].upper()}>") for s in base or []]
                spans += [(s["start"], s["end"], f"<{TERM.upper()}>") for s in terms or []]
                out.append(_replace(text, spans) if spans else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return both.mapInArrow(run, "doc_id long, text string")
