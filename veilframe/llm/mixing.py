"""Mixing sources to target weights by entropy balancing.

A document's rate r in [0, most] says how often the mix takes it. Of all rates that give
each source its target number of words, the ones wanted are nearest to equal rates in
entropy (with the bound: the sum of r log r + (most - r) log(most - r)). The convex dual
has one multiplier a source, and the rates are its exponential tilt by size,

    r / (most - r) = exp(multiplier * size / mean size).

The sum over documents of size * rate is all the dual needs, so Newton runs on the
histogram (source, size, number) and never on the documents: each iteration is one
aggregation by source, kept inside a bracket that halves if Newton leaves it.

Rates become copies by systematic rounding: along a source's documents from the longest
down, the number of extra copies follows the running sum of the rates' fractions. It is
never off by a whole copy, so a source's words are off by less than its longest document
that has a fraction; one document of the source then makes good the rest by a part copy.

Everything here is DataFrame operations; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.columns import unused
from veilframe.llm._store import drop, keep, ranked, scratch, sized

#: Documents that are ranked together, about.
_GROUP = 1_000
#: Turns after which the dual is given up with an error. A bracket grows by 4 at least or
#: halves each turn, so that far fewer are needed.
_TURNS = 1_000


def word_count(text: Column) -> Column:
    """Number of maximal runs of anything but ASCII white space; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) of each source of (source, source_size).

    Sources in code point order, null last, take the weights in turn and divide
    ``share`` of all sizes by them; a source gets ``most`` times its size at most and
    what is over goes to the others by weight, again and again.
    """
    order = [F.col("source").isNull(), F.col("source").asc()]
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = ranked(sizes, order, "place", "mix-sources").select("source", "source_size", weight.alias("weight"))
    s = keep(s.withColumn("cap", F.col("source_size") * F.lit(float(most))), "mix-weights")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0  # words for each unit of weight; it only rises
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        got = s.agg(F.sum(F.when(full, F.col("cap"))).alias("cap"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        new = max(level, (total * share - (got.cap or 0.0)) / got.weight) if got.weight else level
        if not new > level:
            break
        level = new
    return s.select("source", "source_size", F.when(full, F.col("cap")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def _exact_sum(words: Column, each: Column) -> Column:
    """Sum of words * each in whole units of 1e-12: it does not depend on the rows' order."""
    units = F.round(each * 1e12).cast("decimal(20,0)") * words.cast("decimal(18,0)")
    return F.sum(units).cast("double") / 1e12


def rates(cells: DataFrame, target: DataFrame, most: float) -> DataFrame:
    """(source, size, n, target, rate) of each cell of (source, size, n) of one source and size."""
    same = F.col("c.source").eqNullSafe(F.col("t.source"))
    mean = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    t = target.alias("c").join(mean.alias("t"), same).select("c.source", "target", "mean", F.col("source_size").alias("whole"))
    t = t.withColumns({"x": F.lit(0.0), "lo": F.lit(float("-inf")), "hi": F.lit(float("inf")), "done": (F.col("whole") == 0) | (F.col("target") >= F.col("whole") * F.lit(most))})
    rate = F.lit(most) / (1 + F.exp(-F.col("x") * F.col("size") / F.col("mean")))
    t = t_kept = keep(t, "mix-dual")
    turns = 0
    while not t.where("not done").isEmpty():
        turns += 1
        if turns > _TURNS:
            raise ArithmeticError("the dual of the mix does not converge")
        todo = t.where("not done").alias("t")
        words = F.col("size") * F.col("n")
        at = cells.alias("c").join(todo, same).select("t.source", "size", "n", "x", "mean")
        sums = at.groupBy("source").agg(_exact_sum(words, rate).alias("got"), _exact_sum(words, F.col("size") / F.col("mean") * rate * (1 - rate / most)).alias("slope"))
        t = t.alias("c").join(sums.alias("t"), same, "left").select("c.*", "got", "slope")
        over = F.col("got") > F.col("target")
        lo = F.when(over, F.col("lo")).otherwise(F.greatest("lo", "x"))
        hi = F.when(over, F.least("hi", "x")).otherwise(F.col("hi"))
        t = t.withColumns({"lo": F.when(F.col("got").isNull(), F.col("lo")).otherwise(lo), "hi": F.when(F.col("got").isNull(), F.col("hi")).otherwise(hi)})
        step = F.col("x") + F.greatest(F.lit(-8.0), F.least(F.lit(8.0), F.try_divide(F.col("target") - F.col("got"), F.col("slope"))))
        inside = (step > F.col("lo")) & (step < F.col("hi"))
        middle = F.when(F.col("lo") == float("-inf"), F.col("hi") - 4).when(F.col("hi") == float("inf"), F.col("lo") + 4).otherwise((F.col("lo") + F.col("hi")) / 2)
        near = F.abs(F.col("got") - F.col("target")) <= F.greatest(F.lit(0.5), F.col("target") * 1e-9)
        done = F.col("done") | near | (F.col("hi") - F.col("lo") < 1e-12)
        moved = F.when(done, F.col("x")).when(inside, step).otherwise(middle)
        old, t = t_kept, keep(t.withColumns({"done": done, "x": moved}).drop("got", "slope"), "mix-dual")
        drop(old)
        t_kept = t
    full = F.col("target") >= F.col("whole") * F.lit(most)
    out = cells.alias("c").join(t.alias("t"), same).select("c.source", "size", "n", "target", F.when(full, F.lit(float(most))).otherwise(rate).alias("rate"))
    return out


def _taken(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: int = 2) -> DataFrame:
    """``mix`` with source, the hash that tells rows of one doc_id apart, and dealt: the words of whole copies."""
    with scratch(docs.sparkSession) as stay:
        out, tables = _deal(docs, weights, share, most)
        stay += tables
    return out


def _deal(docs: DataFrame, weights: tuple[float, ...], share: float, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """The result, and the kept tables that it reads."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_count(F.col("text").cast("string")).alias("size"), F.col("source").cast("string").alias("source"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("tie"))
    rows = keep(rows, "mix-rows")
    cells = keep(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    sizes = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    target = keep(targets(sizes, weights, share, most), "mix-targets")
    cell = keep(rates(cells, target, float(most)), "mix-rates")

    # A full cell is dealt by hash into groups of about _GROUP documents.
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / _GROUP))
    cell = sized(cell).select("source", "size", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("part"), parts.alias("parts"))
    same = F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.size") == F.col("c.size"))
    dealt = rows.alias("r").join(cell.alias("c"), same).select("r.*", "whole", "part", F.pmod("tie", "parts").alias("group"))
    groups = dealt.groupBy("source", "size", "group").agg(F.count(F.lit(1)).alias("n"), F.first("part").alias("part"))
    before = Window.partitionBy("source").orderBy(F.desc("size"), "group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("start", F.coalesce(F.sum(F.col("n") * F.col("part")).over(before), F.lit(0.0)) + 0.5).select("source", "size", "group", "start")
    place = F.row_number().over(Window.partitionBy("source", "size", "group").orderBy("tie", "doc_id"))
    dealt = dealt.withColumn("place", place)
    same = F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.size") == F.col("c.size")) & (F.col("r.group") == F.col("c.group"))
    dealt = dealt.alias("r").join(groups.alias("c"), same).select("r.*", "start")
    extra = F.floor(F.col("start") + F.col("place") * F.col("part")) - F.floor(F.col("start") + (F.col("place") - 1) * F.col("part"))
    copies = F.least(F.lit(most), F.col("whole") + extra).cast("long")
    dealt = given = keep(dealt.select("doc_id", "source", "size", "tie", "place", (copies * F.col("size")).alias("words")), "mix-copies")

    # What rounding left over goes to the smallest document that can give or take it all.
    got = dealt.groupBy("source").agg(F.sum("words").alias("got"))
    same = F.col("r.source").eqNullSafe(F.col("c.source"))
    left = target.alias("r").join(got.alias("c"), same).select("r.source", "source_size", "target", (F.round("target") - F.col("got")).cast("long").alias("left"))
    dealt = dealt.alias("r").join(left.alias("c"), same).select("r.*", "source_size", "target", "left")
    fits = ((F.col("left") > 0) & (F.col("size") * most - F.col("words") >= F.col("left"))) | ((F.col("left") < 0) & (F.col("words") >= -F.col("left")))
    key = F.struct("size", "tie", "doc_id", "place")
    chosen = dealt.where(fits).groupBy("source").agg(F.min(key).alias("chosen"))
    out = dealt.alias("r").join(chosen.alias("c"), same, "left")
    mine = F.coalesce(F.col("chosen") == F.struct(F.col("size"), F.col("tie"), F.col("doc_id"), F.col("place")), F.lit(False))
    out = out.select(F.col("doc_id"), F.col("tie"), F.col("r.source").alias("source"), F.col("words").alias("dealt"), F.col("size"), F.col("source_size"), F.col("target"), (F.col("words") + F.when(mine, F.col("left")).otherwise(0)).alias("taken"))
    return out, [given, target]


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: int = 2) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of documents.

    docs: doc_id long, text string, source string; other columns are ignored. size is
    the number of words of the text (null, empty or blank: 0, and nothing is taken),
    source_size its source's, target the words that the mix wants from its source (see
    ``targets``), and taken the words that the mix takes from the document, repeats
    counted: whole copies, and a part copy of one document a source at most; never more
    than ``most`` times its size. A null source is a source of its own. Of repeated rows
    each counts as a document. Equal input gives equal output; an empty table gives none.
    """
    return _taken(docs, weights, share, most).drop("tie", "source", "dealt")


def mixed(docs: DataFrame, parts: bool = True, **options) -> DataFrame:
    """The mix itself: each row of docs as often as the mix takes it.

    A part copy holds the first words of its text; n_chars, if there is one, counts it.
    Without ``parts`` all copies are whole, and a source's words are off its target by
    less than its longest document. Rows that repeat doc_id, text and source deal their
    copies out, one row's number at most one above another's.
    """
    tie, source, size, words, n, copies, place = (unused(docs, f"mix_{c}") for c in ("tie", "source", "size", "words", "n", "copies", "place"))
    each = _taken(docs, **options).withColumn("taken", F.col("taken" if parts else "dealt")).where("taken > 0 or size > 0")
    each = each.groupBy(F.col("tie").alias(tie), F.col("source").alias(source)).agg(F.max("size").alias(size), F.count(F.lit(1)).alias(n), F.sum(F.floor(F.col("taken") / F.col("size"))).alias(copies), F.sum(F.col("taken") % F.col("size")).alias(words))
    each = each.where((F.col(copies) > 0) | (F.col(words) > 0))
    mine = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")) == F.col(tie)
    same = mine & F.col("source").cast("string").eqNullSafe(F.col(source))
    once = docs.join(each.where(F.col(n) == 1), same).withColumn(place, F.lit(1))
    often = docs.join(each.where(F.col(n) > 1), same).withColumn(place, F.row_number().over(Window.partitionBy(tie, source).orderBy(F.lit(1))))
    rows = once.unionByName(often)
    whole = F.floor(F.col(copies) / F.col(n)) + (F.col(place) <= F.col(copies) % F.col(n)).cast("long")
    part = F.when(F.col(place) == F.col(n), F.col(words)).otherwise(0)
    rows = rows.withColumn(words, F.explode(F.concat(F.array_repeat(F.lit(0).cast("long"), whole.cast("int")), F.when(part > 0, F.array(part.cast("long"))).otherwise(F.array().cast("array<long>")))))
    head = F.regexp_extract("text", r"^[\x20\x09-\x0D]*", 0)
    cut = F.concat(head, F.array_join(F.slice(F.split(F.substring("text", F.length(head) + 1, F.length("text")), r"[\x20\x09-\x0D]+"), 1, F.col(words).cast("int")), " "))
    full = F.col(words) == 0
    text = F.when(full, F.col("text")).otherwise(cut)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(full, F.col("n_chars")).otherwise(F.length(text).cast("long")))
    return rows.withColumn("text", text).select(*docs.columns)
