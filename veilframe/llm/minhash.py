"""MinHash near-duplicates: one-permutation hashing with optimal densification.

1. Every text becomes the set of its distinct word shingles (128-bit hashes). Equal sets
   collapse to one class by a count and a 128-bit sum, so exact copies, however many,
   are one row from here on.
2. One permutation, cut into ``bands * rows`` bins, gives a signature; an empty bin
   borrows from a filled one picked by a hash of bin and attempt (optimal densification).
3. Each band of ``rows`` bins is a bucket. In a bucket candidates form stars, not all
   pairs (see ``graph.star_closure``); what the stars leave open goes through an exact
   prefix filter (see ``rest_pairs``), or in one task where few members are left.
4. Every candidate edge is confirmed on the full shingle sets with integer arithmetic,
   once by each half of the shingles' hashes. A second pass over the texts makes those
   sets, only for texts that share a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.columns import qcol, unused
from veilframe.llm import _text
from veilframe.llm._bloom import Bloom
from veilframe.llm._store import bounded, drop, keep, scratch, sized
from veilframe.llm._vectors import arrow_rows
from veilframe.llm.graph import components, star_closure

_U = np.uint64
_ATTEMPTS = 4096
_SETS = "doc_id long, row long, n_shingles long, id binary, bands array<long>"
_FULL = "id binary, n_shingles long, shingles array<long>, high array<long>"
#: Members of a family that share an element are compared with each other up to so many;
#: more of them are a family of their own.
_FEW = 64
_PART = 1000
#: A family of so many members, with so many shingles (8 MB), at most is finished in one task.
_HELD, _HELD_SHINGLES = 8192, 1 << 20


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One-permutation signatures, densified; all 0 for an empty set."""
    n = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), bins), np.uint64)
    if not n.sum():
        return out
    flat = np.concatenate(sets)
    # The bin rises with the hash, and each set is sorted: a bin's first value is its least.
    where = np.repeat(np.arange(len(sets)), n) * bins + (((flat >> _U(32)) * _U(bins)) >> _U(32)).astype(np.int64)
    first = np.ones(len(where), bool)
    first[1:] = where[1:] != where[:-1]
    out.reshape(-1)[where[first]] = flat[first]
    filled = np.zeros(out.shape, bool)
    filled.reshape(-1)[where[first]] = True
    row, col = np.nonzero(~filled & (n > 0)[:, None])
    source = out.copy()
    for attempt in range(_ATTEMPTS):
        if not len(row):
            break
        pick = (_text.mix(col.astype(np.uint64) * _U(_ATTEMPTS) + _U(attempt + 1)) % _U(bins)).astype(np.int64)
        hit = filled[row, pick]
        out[row[hit], col[hit]] = source[row[hit], pick[hit]]
        row, col = row[~hit], col[~hit]
    for r, c in zip(row, col, strict=True):  # all attempts missed: the next filled bin
        out[r, c] = source[r, (c + np.flatnonzero(np.roll(filled[r], -c))[0]) % bins]
    return out


def _lists(flat: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(flat.view(np.int64)))


def _names(low: list[np.ndarray], high: list[np.ndarray], n: np.ndarray) -> pa.Array:
    """16 bytes that name each set: its size, and sums over both halves of its hashes."""
    ends, sums = np.concatenate([[0], np.cumsum(n)]), []
    for sets, salt in ((low, 0x9E3779B97F4A7C15), (high, 0xC2B2AE3D27D4EB4F)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_text.mix(np.concatenate(sets) ^ _U(salt)), dtype=np.uint64)])
        sums.append(_text.mix(total[ends[1:]] - total[ends[:-1]] + n.astype(np.uint64) * _U(salt)))
    raw = np.column_stack(sums).tobytes()
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(n), [None, pa.py_buffer(raw)]).cast(pa.binary())


def _sets(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in _text.text_chunks(batch.column(2)):
                low, high = _text.shingles(data, offsets, width)
                n = np.array([len(s) for s in low], np.int64)
                sig = signatures(low, bands * rows).reshape(len(low), bands, rows)
                keys = _text.combine([sig[:, :, k] for k in range(rows)] + [np.broadcast_to(np.arange(bands, dtype=np.uint64), sig.shape[:2])])
                keys = _lists(keys.reshape(-1), np.arange(0, (hi - lo + 1) * bands, bands))
                own = [batch.column(k).slice(lo, hi - lo) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n), _names(low, high, n), keys], ["doc_id", "row", "n_shingles", "id", "bands"])

    return run


def _full(width: int, wanted: Bloom):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = wanted.has(batch.column(0).to_numpy())
            rows = pa.Table.from_batches([batch]).filter(pa.array(hit)).combine_chunks()
            for _, _, data, offsets in _text.text_chunks(rows.column(1)):
                low, high = _text.shingles(data, offsets, width)
                n = np.array([len(s) for s in low], np.int64)
                ends = np.concatenate([[0], np.cumsum(n)])
                full = [_lists(np.concatenate(sets), ends) for sets in (low, high)]
                yield pa.RecordBatch.from_arrays([_names(low, high, n), pa.array(n), *full], ["id", "n_shingles", "shingles", "high"])

    return run


def rest_pairs(open_: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Candidates (id, other) among members of open blocks, without comparing them all.

    Members that share blocks form a family, and what most of a family has is its
    consensus R. Let D(x) be the symmetric difference of x and R. Linked x and y differ
    in at most k (|x| + |y|) shingles, k = (100 - percent) / (100 + percent), and so do
    D(x) and D(y). With the slack s(x) = k |x| - |D(x)|:

    - if s(x) + s(y) >= 0 the two are linked, and both are linked with the member of
      most slack: a star from it stands for all of these pairs;
    - otherwise D(x) and D(y) share an element, and so do their first elements in order
      of frequency: k (|x| + |y|) / 2 + 1 of the one with the smaller D, k (|x| + |y|)
      + 1 of the other (prefix filter). Near-copies with edits of their own share few.

    Few members with an element among their first are compared. Many of them are a family
    again, with a consensus of its own; it has half of the members at most, so this comes to
    an end. Elements of the same lead, the member of least hash among those that have them
    first, make one family, so that a member of many such elements is not in a family for
    each; if that is more than half of the members, each element makes its own.

    open_: (block, id, component), full: (id, n_shingles, shingles).
    """
    return _narrowed(_families(open_, full), percent)


def rest_links(open_: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """``rest_pairs``, but a family of a few thousand members at most is compared in one task.

    That goes by the same differences (see ``joins``), and returns fewer links than members.
    """
    rows = _families(open_, full)
    few = (F.count(F.lit(1)) <= _HELD) & (F.sum("n_shingles") <= _HELD_SHINGLES)
    size = keep(rows.groupBy("family").agg(few.alias("few")), "minhash-few")
    few = rows.join(sized(size).where("few"), "family").groupBy("family").agg(F.collect_list(F.struct("id", "component", "shingles")).alias("members"))
    with arrow_rows(open_.sparkSession, 2):
        found = keep(few.select("members").mapInArrow(_finish(percent), "id binary, other binary"), "minhash-finished")
    large = size.where("not few").select("family")
    return found if large.isEmpty() else found.union(_narrowed(keep(rows.join(large, "family"), "minhash-members"), percent))


def _families(open_: DataFrame, full: DataFrame) -> DataFrame:
    """(family, id, component, n_shingles, shingles) of members of open blocks; who shares a block has one family.

    Members of one component stay together, so that a family is few steps away from its largest one.
    """
    first = open_.groupBy("block").agg(F.min("component").alias("b"))
    family = components(open_.join(first, "block").select(F.col("component").alias("a"), "b"), "minhash-family")
    family = family.select(F.col("id").alias("component"), F.xxhash64("component").alias("family"))
    known = open_.select("id", "component").distinct().join(family, "component")
    return keep(full.select("id", "n_shingles", "shingles").join(known, "id"), "minhash-members")


def _narrowed(rows: DataFrame, percent: int) -> DataFrame:
    """Candidates (id, other) within families, family by family within them."""
    found = []
    while True:
        # One family's tables at a time: a plan of all of them would broadcast those of each at once.
        with scratch(rows.sparkSession) as stay:
            pairs, hot = _family_pairs(rows, percent)
            found.append(keep(pairs, "minhash-near"))
            stay.extend((found[-1], hot))
        if hot.isEmpty():
            break
        rows = keep(rows.drop("family").dropDuplicates(["id"]).join(hot, "id"), "minhash-members")
    return reduce(DataFrame.union, found)


def joins(sets: list[np.ndarray], part: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Linked pairs of sets that join what links join; part: numbers of the parts that are joined before.

    What two differences from the consensus share is counted along the lists of their
    elements, for one set and all others at once. An element that half of the sets differ in
    is the most, and sets of the largest part are looked at from the others only.
    """
    part, n = part.copy(), np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), n)
    values, code, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = seen * 2 > len(sets)
    has = np.zeros((len(sets), int(common.sum())), bool)
    on = common[code]
    has[row[on], (np.cumsum(common) - 1)[code[on]]] = True
    lacks, lacked = np.nonzero(~has)
    row, code = np.concatenate([row[~on], lacks]), np.concatenate([code[~on], lacked + len(values)])
    apart = np.bincount(row, minlength=len(sets))
    by_code, by_row = np.argsort(code, kind="stable"), np.argsort(row, kind="stable")
    holders, ends = row[by_code], np.searchsorted(code[by_code], np.arange(len(values) + has.shape[1] + 1)).tolist()
    mine, at = code[by_row].tolist(), np.searchsorted(row[by_row], np.arange(len(sets) + 1)).tolist()
    sizes = np.bincount(part)
    found = []
    for x in np.flatnonzero(part != sizes.argmax()).tolist():
        lists = [holders[ends[c] : ends[c + 1]] for c in mine[at[x] : at[x + 1]]]
        shared = np.bincount(np.concatenate(lists), minlength=len(sets)) if lists else 0
        both = n + n[x]
        same = (both - (apart + apart[x] - 2 * shared)) // 2
        for y in np.flatnonzero((same * 100 >= (both - same) * percent) & (part != part[x])).tolist():
            if part[x] != part[y]:
                found.append((x, y))
                part[part == part[y]] = part[x]
    return found


def _finish(percent: int):
    """(members) of families to links (id, other) that join what the family's links join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for family in batch.column(0):
                members = family.values
                ids, lists = members.field("id"), members.field("shingles")
                part = np.unique(np.array(members.field("component").to_pylist(), object), return_inverse=True)[1]
                flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
                links = np.array(joins(np.split(flat, ends[:-1]), part, percent), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)) for x in links.T], ["id", "other"])

    return run


def _family_pairs(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Candidates within families, and (id, family) of members that go on as families of their own.

    rows: (family, id, component, n_shingles, shingles).
    """
    k = (100 - percent) / (100 + percent)
    size = rows.groupBy("family").agg(F.count(F.lit(1)).alias("members"))
    size = sized(keep(size.withColumn("parts", F.ceil(F.col("members") / _PART)), "minhash-families"))
    often = rows.select("family", F.explode("shingles").alias("e")).groupBy("family", "e").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    often = often.join(size, "family").where(F.col("n") * 2 > F.col("members"))
    consensus = often.groupBy("family").agg(F.collect_list("e").alias("common"), F.first("parts").alias("parts"))
    # A large family is dealt into parts, and its consensus goes to each of them.
    consensus = consensus.select("family", "common", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    dealt = rows.join(size, "family").withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    rows = dealt.join(consensus, ["family", "part"], "left").withColumn("common", F.coalesce("common", F.array().cast("array<long>")))
    apart = F.concat(F.array_except("shingles", "common"), F.array_except("common", "shingles"))
    rows = rows.select("id", "family", "component", "n_shingles", apart.alias("d")).withColumn("nd", F.size("d"))
    rows = keep(rows.withColumn("slack", k * F.col("n_shingles") - F.col("nd")), "minhash-apart")
    mine = rows.select("id", "family", "component", "n_shingles", "nd")

    best = rows.groupBy("family").agg(F.max(F.struct("slack", "id", "component")).alias("m"))
    star = rows.join(sized(keep(best, "minhash-best")), "family").where((F.col("slack") + F.col("m.slack") >= -1e-6) & (F.col("component") != F.col("m.component")))
    star = star.select("id", F.col("m.id").alias("other"))

    # Elements of one component's members only join nothing: they come first in the order, and are not looked at.
    each = rows.select("id", "family", "component", "n_shingles", "nd", F.explode("d").alias("e"))
    ends = F.min("component").alias("lo"), F.max("component").alias("hi")
    seen = each.groupBy("family", "e").agg(F.count(F.lit(1)).alias("n"), *ends).where("lo < hi").select("family", "e", "n")
    mine_ = Window.partitionBy("id", "family")
    place = F.col("nd") - F.count(F.lit(1)).over(mine_) + F.row_number().over(mine_.orderBy("n", "e"))
    each = each.join(seen, ["family", "e"]).withColumn("place", place)
    reach = F.lit(k * (1 + 100 / percent)) * F.col("n_shingles") + 1e-6
    each = each.where(F.col("place") <= F.floor(reach) + 1).select("id", "family", "component", "e", (F.col("place") <= F.floor(reach / 2) + 1).alias("short"), "place")
    each = keep(each, "minhash-prefix")
    # Only those that have an element among their first meet by it, however many others have it.
    first = each.groupBy("family", "e").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("id").alias("h"), "id")).alias("lead"), *ends)
    first = keep(first.where("lo < hi").select("family", "e", "n", F.col("lead.id").alias("lead")), "minhash-first")
    hot = keep(_hot(each, first.where(F.col("n") > _FEW), size), "minhash-hot")

    each = each.drop("component").join(first.where(F.col("n") <= _FEW).select("family", "e"), ["family", "e"]).join(mine, ["id", "family"])
    x, y = each.where("short").alias("x"), each.alias("y")
    both = F.col("x.n_shingles") + F.col("y.n_shingles")
    fits = (F.col("x.component") != F.col("y.component")) & ((F.col("x.nd") < F.col("y.nd")) | ((F.col("x.nd") == F.col("y.nd")) & (F.col("x.id") != F.col("y.id"))))
    fits = fits & (F.col("y.nd") - F.col("x.nd") <= k * both + 1e-6)
    fits = fits & (F.least("x.n_shingles", "y.n_shingles") * 100 >= F.greatest("x.n_shingles", "y.n_shingles") * percent)
    # The first shared element leaves room for the overlap that a link needs.
    overlap = (F.col("x.nd") + F.col("y.nd") - k * both) / 2 - 1e-6
    fits = fits & (F.col("x.nd") - F.col("x.place") + 1 >= overlap) & (F.col("y.nd") - F.col("y.place") + 1 >= overlap)
    near = x.join(y, (F.col("x.family") == F.col("y.family")) & (F.col("x.e") == F.col("y.e")) & fits)
    return star.union(near.select("x.id", "y.id")), hot


def _hot(each: DataFrame, many: DataFrame, size: DataFrame) -> DataFrame:
    """(id, family) of the families that the members of elements in many make.

    each: (family, e, id), many: (family, e, lead), size: (family, members).
    """
    rows = keep(each.select("family", "e", "id").join(many.select("family", "e", "lead"), ["family", "e"]), "minhash-many")
    led = rows.select("family", "lead", "id").distinct()
    wide = led.groupBy("family", "lead").agg(F.count(F.lit(1)).alias("n")).join(size, "family")
    wide = keep(wide.select("family", "lead", (F.col("n") * 2 > F.col("members")).alias("wide")), "minhash-led")
    one = led.join(wide.where("not wide"), ["family", "lead"]).select("id", F.xxhash64("family", "lead").alias("family"))
    own = rows.join(wide.where("wide"), ["family", "lead"])
    return one.union(own.select("id", F.xxhash64("family", "e").alias("family")))


def _grouped(docs: DataFrame, width: int, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, n_shingles, id) of every row, and (id, part) of each class that is no longer alone.

    row is a hash of doc_id and text, id names the set of shingles, and part the least id
    that links reach.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text = text.select("doc_id", _row().alias("row"), "text")
    sets = keep(text.mapInArrow(_sets(width, bands, rows), _SETS), "minhash-sets")
    classes = sets.where("n_shingles > 0").groupBy("id").agg(F.min("row").alias("row"), F.first("bands").alias("bands"))
    classes = keep(classes, "minhash-classes")
    blocks = classes.select(F.explode("bands").alias("block"), "id").distinct()

    made: list[DataFrame] = []

    def prepare(ids: DataFrame):
        some = keep(classes.select("id", "row").join(ids, "id").select("row"), "minhash-wanted")
        wanted = Bloom(some, F.col("row"))
        drop(some)
        found = text.where("text is not null").select("row", "text").mapInArrow(_full(width, wanted), _FULL)
        found = found.join(ids, "id", "left_semi").groupBy("id").agg(*[F.first(c).alias(c) for c in ("n_shingles", "shingles", "high")])
        full = keep(found, "minhash-full")
        made.append(full)

        def verify(pairs: DataFrame) -> DataFrame:
            one, two = (full.select(*[F.col(c).alias(f"{c}_{x}") for c in full.columns]) for x in "ab")
            both = pairs.join(one, F.col("a") == F.col("id_a")).join(two, F.col("b") == F.col("id_b"))
            both = both.where(F.least("n_shingles_a", "n_shingles_b") * 100 >= F.greatest("n_shingles_a", "n_shingles_b") * percent)
            same = F.least(*[F.size(F.array_intersect(f"{c}_a", f"{c}_b")) for c in ("shingles", "high")])
            both = both.select("a", "b", (F.col("n_shingles_a") + F.col("n_shingles_b")).alias("n"), same.alias("same"))
            return both.where(F.col("same") * 100 >= (F.col("n") - F.col("same")) * percent).select("a", "b")

        return verify

    found = star_closure(blocks.withColumn("centre", F.lit(True)), prepare, "minhash", rest=lambda open_: rest_links(open_, made[0], percent))
    old, sets = sets, keep(sets.drop("bands"), "minhash-rows")
    drop(old, classes)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "id binary, component binary")
    return sets, found.select("id", F.col("component").alias("part"))


def _row() -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 32, rows: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of documents.

    docs: doc_id long, text string; other columns are ignored, whatever their names.
    Two texts are linked if 100 * |A and B| >= percent * |A or B|, with A and B their
    sets of distinct ``width``-word shingles of lower-cased (A-Z) text; words are runs
    of anything but ASCII white space. A text of fewer words has one shingle, all of
    it. component_id is the least doc_id reachable by links, kept says whether it is
    the row's own. Null, empty or blank text: n_shingles 0, linked with nothing. Rows
    without a doc_id are compared like any other, but name no component: component_id is
    null unless they are linked with a row that has one, kept if null. Repeated rows are
    copies, and rows that repeat a doc_id with another text are texts of their own: each
    row is returned with the component of its text. An empty table gives an empty result.

    A pair at the threshold s misses all buckets with probability (1 - s**rows)**bands:
    5e-8 at 0.80 and 6e-11 at 0.85 with the defaults.
    """
    with bounded(docs.sparkSession):
        sets, parts = _grouped(docs, width, percent, bands, rows)
    # All of these grow with the documents: the caller's plan sorts them, whatever it may broadcast.
    least = sets.where("n_shingles > 0").groupBy("id").agg(F.min("doc_id").alias("least")).join(parts.hint("merge"), "id", "left")
    least = least.withColumn("part", F.coalesce("part", "id"))
    names = least.groupBy("part").agg(F.min("least").alias("component_id"))
    named = least.join(names.hint("merge"), "part").select("id", "component_id")
    out = sets.join(named.hint("merge"), "id", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 32, rows: int = 4) -> DataFrame:
    """One row of each group of near-duplicates (see ``near_duplicates``).

    It is the one with the least doc_id, rows without one last; of rows that repeat
    doc_id and text one stays, any of them. Rows that repeat a doc_id with another text
    are judged by their own text. Rows with null, empty or blank text all stay. Columns
    stay as they are, and an empty table stays empty.
    """
    with bounded(docs.sparkSession):
        sets, parts = _grouped(docs, width, percent, bands, rows)
    each = sets.where("n_shingles > 0").groupBy("id", "doc_id", "row").agg(F.count(F.lit(1)).alias("n")).join(parts, "id", "left")
    each = keep(each.select(F.coalesce("part", "id").alias("part"), "doc_id", "row", "n"), "minhash-groups")
    first = each.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"), F.sum("n").alias("all"))
    is_first = (F.col("row") == F.col("first.row")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    judged = each.join(first.where(F.col("all") > 1), "part").select("doc_id", "row", "n", is_first.alias("stays"))
    judged = keep(judged.where("not stays or n > 1"), "minhash-judged")
    row, row_, id_, stays = (unused(docs, c) for c in ("near_row", "near_judged", "near_doc", "near_stays"))
    mine = judged.select(F.col("doc_id").alias(id_), F.col("row").alias(row_), F.col("stays").alias(stays))
    some = docs.withColumn(row, _row())
    same = (some[row] == mine[row_]) & some["doc_id"].cast("long").eqNullSafe(mine[id_])
    some = some.join(mine, same, "left").where(F.coalesce(stays, F.lit(True)))
    out = some.where(F.col(stays).isNull()).select(*docs.columns)
    if judged.where("stays").isEmpty():
        return out
    again = some.where(F.col(stays)).groupBy(row, id_).agg(*[F.first(qcol(c)).alias(c) for c in docs.columns])
    return out.union(again.select(*[qcol(c) for c in docs.columns]))
