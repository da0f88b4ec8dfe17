"""Secret scans with a trigram inverted index.

Each rule's regex is read on the driver into alternatives, each with the trigrams that
any match of it must hold; together they are a Boolean query, an OR of ANDs. The index
lists (trigram, document) for the trigrams that some rule asks for, over lower-cased
text. Intersecting postings gives each document the rules that may match there, and only
those are verified with their regex. A rule of which an alternative has no trigram that
it must hold scans every text.

Everything here is DataFrame operations; no Python runs on the executors.
"""

from __future__ import annotations

import re._parser as sre
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm._store import keep

_GAP = "\0"
_MOST = 256


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules. A run of 16 hexadecimal digits or more is a maximal run of at least 16.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Well-known formats of credentials.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)


def _strings(items) -> list[str]:
    """The strings that match a parsed regex, with a gap for whatever is not fixed."""
    out = [""]
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "IN" and arg[0][0] is not sre.NEGATE and all(str(o) == "LITERAL" for o, _ in arg):
            more = [chr(c) for _, c in arg]
        elif name == "SUBPATTERN":
            more = _strings(arg[-1])
        elif name == "BRANCH":
            more = [s for branch in arg[1] for s in _strings(branch)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = arg
            one = _strings(inner)
            if most == 1:
                more = [""] * (least == 0) + one
            elif least == 0 or len(one) > 4:
                more = [_GAP]
            else:
                more = [s * min(least, 3) + (_GAP if most != least or least > 3 else "") for s in one] if len(one) == 1 else [_GAP]
        elif name == "AT":
            more = [""]
        else:
            more = [_GAP]
        out = [a + b for a in out for b in (more if len(out) * len(more) <= _MOST else [_GAP])]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The alternatives' trigrams, lower-cased; empty if a match need not hold any.

    Of an alternative's trigrams the first and the last are asked for: those between tell
    little more, and each is a pass over all texts.
    """
    found: dict[frozenset[str], tuple[str, ...]] = {}
    for s in dict.fromkeys(_strings(sre.parse(pattern))):
        s = s.lower()
        grams = tuple(s[k : k + 3] for k in range(len(s) - 2) if _GAP not in s[k : k + 3])
        found.setdefault(frozenset(grams), grams)
    if not all(found):
        return []
    least = [g for a, g in found.items() if not any(b < a for b in found)]
    return list(dict.fromkeys(frozenset((g[0], g[-1])) for g in least))


def _running(n: Column) -> Column:
    """Running sums of an array of whole numbers, by doubling: log2(n) passes over it."""

    def add(sums: Column, k: Column) -> Column:
        before = F.concat(F.array_repeat(F.lit(0).cast("long"), k), F.slice(sums, 1, F.size(sums) - k))
        return F.zip_with(sums, before, lambda a, b: a + b)

    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(n), F.lit(1)))).cast("int")), lambda k: F.call_function("shiftleft", F.lit(1), k))
    return F.aggregate(steps, n, lambda sums, k: F.when(k < F.size(sums), add(sums, k)).otherwise(sums))


def match_spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) in code points, of the matches that are long enough."""
    pattern = F.lit(rule.pattern)
    between, hits = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    held = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    sizes = F.zip_with(F.slice(between, 1, F.size(hits)), F.arrays_zip(hits.alias("hit"), held.alias("held")), lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m["hit"]).alias("n"), F.length(m["held"]).alias("held")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    # Within transform() the text is matched once, however often its matches are read.
    found = F.transform(F.array(sizes), lambda x: F.zip_with(x, _running(F.transform(x, lambda m: (m["gap"] + m["n"]).cast("long"))), lambda m, end: F.struct((end - m["n"]).cast("int").alias("start"), end.cast("int").alias("end"), m["held"].alias("held"))))[0]
    found = F.transform(F.filter(found, lambda m: m["held"] >= rule.least), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
    return F.when(text.rlike(rule.pattern), found).otherwise(none)


def _of_rule(spans: Column, k: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("rule"), s["end"].alias("end")))


def _mask(names: list[int], where: list[Column]) -> Column:
    total = F.lit(0).cast("long")
    for k, cond in zip(names, where, strict=True):
        total = total + F.when(cond, F.lit(1 << k)).otherwise(F.lit(0))
    return total


def index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, doc_id): the postings of these trigrams, over lower-cased text."""
    # Within transform() the text is lower-cased once and not once a trigram.
    held = F.transform(F.array(F.lower("text")), lambda t: F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(t, g)))[0]
    return docs.where(F.col("text").isNotNull()).select(F.explode(held).alias("gram"), "doc_id")


def find_secrets(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """doc_id, n_<kind> of each base rule, base_sha256 and spans of every row of documents.

    docs: doc_id long, text string; other columns are ignored. spans joins all matches
    by commas as kind:start:end, in order of start, then of rules, then of end; start
    and end are code points, end exclusive. base_sha256 is the lower-case hexadecimal
    SHA-256 of the same string of the base rules' matches alone. Null or empty text has
    no matches. Rows without a doc_id and repeated rows are scanned like any other, each
    on its own text. An empty table gives an empty result.
    """
    rules = base + more
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = {k: trigram_query(r.pattern) for k, r in enumerate(rules)}
    grams = sorted({g for q in asked.values() for a in q for g in a})
    sought = [k for k, q in asked.items() if q]
    held = index(docs, grams).groupBy("doc_id").agg(F.collect_set("gram").alias("held"))
    meets = [F.exists(F.array(*[F.array(*map(F.lit, sorted(a))) for a in asked[k]]), lambda a: F.size(F.array_except(a, "held")) == 0) for k in sought]
    maybe = held.select(F.col("doc_id").alias("id"), _mask(sought, meets).alias("rules")).where("rules <> 0")
    maybe = keep(maybe, "secret-candidates")
    rows = docs.join(maybe, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    all_, mine = [], []
    for k, r in enumerate(rules):
        text = F.col("text")
        if asked[k]:
            text = F.when((F.coalesce("rules", F.lit(0)).bitwiseAND(1 << k)) != 0, text)
        all_.append(_of_rule(match_spans(text, r), k).alias(r.kind))
    rows = rows.select("doc_id", *all_)
    names = F.array(*[F.lit(r.kind) for r in rules])

    def joined(kinds: tuple[Rule, ...]) -> Column:
        spans = F.array_sort(F.concat(*[F.col(r.kind) for r in kinds]))
        text = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rule"] + 1), s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(text, ",")

    return rows.select("doc_id", *[F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in base], F.sha2(joined(base), 256).alias("base_sha256"), joined(rules).alias("spans"))
