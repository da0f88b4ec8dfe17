"""How filters of documents interact, for every order in which they could run.

A document fails some of the filters. For each set of filters one sum counts the documents
that fail all of them: the sum of the products of their flags. These joint failures say
all there is to say, by inclusion and exclusion, and no order is run:

- survivors of a set P: the sum of (-1)^|T| * joint(T) over the subsets T of P;
- documents that fail one filter only: the same over all supersets of it (Moebius);
- what a filter removes and what was already gone, as differences of survivors;
- its Shapley value: filters removing documents are a game, whose Harsanyi dividends are
  (-1)^(|T|+1) * joint(T), each shared equally by the members of T.

Texts are read once; then rows hold a name of the text, flags and ids. Everything here is
DataFrame operations.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm._store import keep

_SPACE = r"[\x20\x09-\x0D]+"

#: What fails a filter, from the text and its words; the last filter is that of repeated texts.
Condition = Callable[[Column, Column], Column]
CONDITIONS: dict[str, Condition] = {
    "A": lambda text, words: F.size(words) < 50,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)).cast("long") < 65 * F.size(words).cast("long"),
    "C": lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.length(text).cast("long"),
    "D": lambda text, words: text.rlike(r"[#$%&*|]"),
}
REPEATED = "E"
_WEIGHTS = ("n", "good", "toxic")


def failures(docs: DataFrame, labels: DataFrame, conditions: dict[str, Condition] = CONDITIONS, repeated: str = REPEATED) -> DataFrame:
    """(part, a flag of 0 or 1 for each filter, n, good, toxic): documents that are alike, with their counts.

    A document fails ``repeated`` if a smaller doc_id has the same text, in whatever part.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", _SPACE), ""))
    flags = [f(F.col("text"), F.col("words")).cast("long").alias(name) for name, f in conditions.items()]
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("name"), *flags)
    # Equal rows become one before any join, so that no repeated id or text is a hot key.
    rows = keep(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("rows")), "audited")
    known = labels.select(F.col("doc_id").cast("long").alias("at"), (F.col("quality") == 1).cast("long").alias("good"), (F.col("toxic") == 1).cast("long").alias("toxic"))
    known = known.where("at is not null and (good = 1 or toxic = 1)").groupBy("at").agg(F.max(F.coalesce("good", F.lit(0))).alias("good"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")).withColumn("none", F.lit(False))
    # Rows without a doc_id have no labels; their names spread them over the join.
    at = F.coalesce("doc_id", F.xxhash64("name"))
    out = rows.withColumns({"at": at, "none": F.col("doc_id").isNull()}).join(known, ["at", "none"], "left").drop("at", "none")
    least = rows.where("doc_id is not null").groupBy("name").agg(F.min("doc_id").alias("doc_id")).withColumn("least", F.lit(True))
    out = out.join(least, ["name", "doc_id"], "left").withColumn(repeated, (F.col("doc_id").isNotNull() & F.col("least").isNull()).cast("long"))
    n = F.col("rows")
    return out.select("part", *conditions, repeated, n.alias("n"), (n * F.coalesce("good", F.lit(0))).alias("good"), (n * F.coalesce("toxic", F.lit(0))).alias("toxic"))


def joint_failures(flags: DataFrame, names: list[str]) -> DataFrame:
    """(part, n, good, toxic): for each set of filters, as a bit mask, how many fail all of it."""
    sets = [[name for k, name in enumerate(names) if mask >> k & 1] for mask in range(1 << len(names))]

    sums = [F.expr(f"sum({' * '.join([w, *(f'`{x}`' for x in of)])})").alias(f"{w}{mask}") for w in _WEIGHTS for mask, of in enumerate(sets)]
    each = flags.groupBy("part").agg(*sums)
    return each.select("part", *[F.array(*[F.col(f"{w}{mask}") for mask in range(len(sets))]).alias(w) for w in _WEIGHTS])


def _signed(joint: str, terms: list[tuple[int, int]]) -> Column:
    """The sum of whole multiples of joint failures, as one SQL expression."""
    return F.expr(" ".join(f"{times:+} * {joint}[{mask}]" for times, mask in terms))


def _subsets(mask: int) -> list[int]:
    bits = [1 << k for k in range(mask.bit_length()) if mask >> k & 1]
    return [sum(c) for n in range(len(bits) + 1) for c in combinations(bits, n)]


def survivors(joint: str, size: int) -> Column:
    """For each set of filters, how many documents pass all of it."""
    return F.array(*[_signed(joint, [((-1) ** t.bit_count(), t) for t in _subsets(mask)]) for mask in range(1 << size)])


def only(joint: str, size: int) -> Column:
    """For each filter, how many documents fail it and no other."""
    return F.array(*[_signed(joint, [((-1) ** (t.bit_count() - 1), t) for t in range(1 << size) if t >> k & 1]) for k in range(size)])


def shapley(joint: str, size: int) -> Column:
    """For each filter, what it removes, summed over all orders."""
    orders = factorial(size)  # divisible by every |T|
    return F.array(*[_signed(joint, [((-1) ** (t.bit_count() + 1) * orders // t.bit_count(), t) for t in range(1 << size) if t >> k & 1]) for k in range(size)])


def interactions(docs: DataFrame, labels: DataFrame, conditions: dict[str, Condition] = CONDITIONS, repeated: str = REPEATED) -> DataFrame:
    """A row for each part, order of filters and step, with what its filter does there.

    docs: doc_id, text, source; labels: doc_id, quality, toxic; other columns are ignored.
    part is the source, an empty string where it is null. Of the documents of a part: kept
    after this step; removed by it; redundant, failing its filter but gone before;
    unique_fails, failing its filter only; good_lost and toxic_lost, removed here with a
    label quality or toxic of 1; shapley, what its filter removes over all orders together.

    Null text is empty, and fails and passes filters as such; texts are whole, however long.
    Rows that repeat a doc_id and text count each, and neither repeats the other; a row without
    a doc_id repeats nothing and is repeated by nothing. Of several labels of a doc_id one of 1
    is enough. An empty table gives an empty result.
    """
    names = [*conditions, repeated]
    size = len(names)
    joint = joint_failures(failures(docs, labels, conditions, repeated), names)
    each = joint.select("part", F.col("n").alias("joint"), *[survivors(w, size).alias(w) for w in _WEIGHTS], only("n", size).alias("only"), shapley("n", size).alias("shapley"))
    steps = [{"filter_order": "".join(names[k] for k in order), "step": at + 1, "filter": k, "before": sum(1 << j for j in order[:at])} for order in permutations(range(size)) for at, k in enumerate(order)]
    steps_of = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,filter:int,before:int>>")
    rows = each.select("*", F.inline(steps_of))
    bit = F.call_function("shiftleft", F.lit(1), F.col("filter"))
    rows = rows.withColumns({"bit": bit, "after": F.col("before") + bit})
    lost = lambda w: F.get(w, F.col("before")) - F.get(w, F.col("after"))
    return rows.select(
        "part",
        "filter_order",
        "step",
        F.get("n", F.col("after")).alias("kept"),
        lost("n").alias("removed"),
        (F.get("joint", F.col("bit")) - lost("n")).alias("redundant"),
        F.get("only", F.col("filter")).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("shapley", F.col("filter")).alias("shapley"),
    )
