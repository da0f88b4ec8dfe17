"""Connected components, and components of links that share blocks.

``components`` is the large-star / small-star scheme: each round points every node's
larger neighbours at its smallest one, then its smaller ones, until the edges form
stars. A chain of n nodes takes about log2(n) rounds, a star none.

``Stars`` finds the components of a similarity graph whose links all lie inside given
blocks (band buckets, shared segments). A block never emits all its pairs: each turn
compares its members with one centre, the member with most links so far, and leaves out
members that have already joined the centre's component. A centre is then done with and
leaves the block. What is still open are pairs of *different* components; the caller
splits the blocks further (``linededup``) or has a way of its own for them
(``star_closure``), so that no link between two components is lost. Blocks of few members
are compared pair by pair there, which leaves nothing open; the same pair is in many of
them, and is compared once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm._store import bounded, drop, keep, scratch

#: All pairs of a block of so many members at most are compared.
_PAIRS = 16


def _are_stars(e: DataFrame) -> bool:
    """Whether every edge (u, v) has its own u, and no v has an edge of its own."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(e.select(F.col("v").alias("x"), F.lit(0).alias("up")))
    seen = ends.groupBy("x").agg(F.sum("up").alias("n"), F.min("up").alias("least"))
    return seen.where("n > 1 or (n = 1 and least = 0)").isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of all nodes with an edge (a, b); component is the least id."""
    with bounded(edges.sparkSession):
        e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        e = keep(e.distinct(), name)
        while not _are_stars(e):
            # Large star: the neighbours above u go to the least of u and its neighbours.
            both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            # Small star: u and its neighbours below go to the least of those.
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            old, e = e, keep(small.union(least.select("u", "m")).where("u <> v").distinct(), name)
            drop(old)
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


class Stars:
    """Components of confirmed links, block by block, without all pairs of a block.

    verify: (a, b) to those that are linked. found is (id, component) of linked ids, None
    as long as there is none. ids may be of any kind that has an order.
    """

    def __init__(self, verify: Callable[[DataFrame], DataFrame], name: str) -> None:
        self.verify, self.name = verify, name
        self.links: DataFrame | None = None
        self.found: DataFrame | None = None

    def open(self, blocks: DataFrame) -> DataFrame:
        """blocks with component and degree, but for blocks that are one component."""
        if self.found is None:
            return blocks.withColumns({"component": F.col("id"), "degree": F.lit(0)})
        ends = self.links.select(F.col("a").alias("id")).union(self.links.select(F.col("b").alias("id")))
        known = self.found.join(ends.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("degree")), "id", "left")
        state = blocks.join(known, "id", "left").withColumns({"component": F.coalesce("component", "id"), "degree": F.coalesce("degree", F.lit(0))})
        alive = state.groupBy("block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("centre").alias("any"))
        return state.join(alive.where("lo < hi and any").select("block"), "block")

    def compare(self, pairs: DataFrame) -> None:
        """Takes in those of the pairs (id, other) that are linked."""
        pairs = keep(pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct(), f"{self.name}-pairs")
        new = keep(self.verify(pairs).select("a", "b"), f"{self.name}-links")
        drop(pairs)
        if new.isEmpty():
            return
        self.links = new if self.links is None else self.links.union(new)
        if self.found is None:
            self.found = keep(components(new, self.name), self.name)
            return
        # New links join components: only those that they touch are looked at again.
        known = self.found.withColumnRenamed("component", "root")
        roots = new.join(known.withColumnRenamed("id", "a").withColumnRenamed("root", "ra"), "a", "left").join(known.withColumnRenamed("id", "b").withColumnRenamed("root", "rb"), "b", "left")
        roots = keep(roots.select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb")), f"{self.name}-roots")
        joined = components(roots.select(F.col("ra").alias("a"), F.col("rb").alias("b")), self.name).withColumnRenamed("id", "root")
        fresh = roots.select(F.col("a").alias("id"), F.col("ra").alias("root")).union(roots.select("b", "rb")).where("id = root")
        old, rows = self.found, known.union(fresh).distinct().join(joined, "root", "left").select("id", F.coalesce("component", "root").alias("component"))
        self.found = keep(rows, self.name)
        drop(old)

    def turn(self, blocks: DataFrame, more: DataFrame | None = None) -> DataFrame:
        """Compares the members of each open block with one centre; the open blocks without it.

        blocks: (block long, id, centre boolean, ...); the centre is the member with most
        links so far, then most ``weight`` if there is one, and members of its component are
        not compared. It is then done with. more: pairs (id, other) to compare along with them.
        """
        state = self.open(blocks)
        first = [c for c in ("degree", "weight") if c in state.columns]
        best = F.when(F.col("centre"), F.struct(*first, F.xxhash64("id").alias("h"), "id", "component"))
        star = state.groupBy("block").agg(F.max(best).alias("c")).select("block", F.col("c.id").alias("other"), F.col("c.component").alias("c_component"))
        state = keep(state.join(star, "block").where("id <> other"), f"{self.name}-open")
        pairs = state.where("component <> c_component").select("id", "other")
        self.compare(pairs if more is None else pairs.union(more))
        return state.select(*blocks.columns)


def _few_pairs(rows: DataFrame) -> DataFrame:
    """(id, other) of all pairs of a block, one of the two its possible centre; rows: (block, id, centre)."""
    members = rows.groupBy("block").agg(F.collect_list(F.struct("id", "centre")).alias("m"))
    behind = F.transform("m", lambda x, k: F.transform(F.slice("m", k + 2, F.lit(_PAIRS)), lambda y: F.struct(x.alias("x"), y.alias("y"))))
    pairs = members.select(F.explode(F.flatten(behind)).alias("p")).where("p.x.centre or p.y.centre")
    return pairs.select(F.col("p.x.id").alias("id"), F.col("p.y.id").alias("other"))


def star_closure(blocks: DataFrame, prepare: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], name: str, rest: Callable[[DataFrame], DataFrame], stars: int = 1) -> DataFrame | None:
    """Components of the confirmed links among members of one block.

    blocks: distinct (block long, id, centre boolean); a pair is a candidate if it
    shares a block in which one of the two may be its centre. prepare: all ids that have
    a candidate to a function that takes (a, b) to those (a, b) that are linked. rest:
    (block, id, component) of the blocks still open after the stars to a superset of the
    linked (id, other) of different components that share one. Returns (id, component)
    of linked ids, None without links.
    """
    with scratch(blocks.sparkSession) as stay:
        many = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.max("centre").alias("any")).where("n > 1 and any")
        rows = keep(blocks.join(many.select("block", "n"), "block"), f"{name}-blocks")
        state = Stars(prepare(keep(rows.select("id").distinct(), f"{name}-ids")), name)
        few, rows = _few_pairs(rows.where(F.col("n") <= _PAIRS)), rows.where(F.col("n") > _PAIRS)
        # Who meets most others is alike to most: one centre for all blocks of a group, and few pairs.
        weight = rows.groupBy("id").agg(F.sum("n").alias("weight"))
        rows = keep(rows.join(weight, "id").select("block", "id", "centre", "weight"), f"{name}-large")
        if rows.isEmpty():
            state.compare(few)
        else:
            for k in range(stars):
                rows = state.turn(rows, few if k == 0 else None)
            rows = keep(state.open(rows).select("block", "id", "component"), f"{name}-open")
            if not rows.isEmpty():
                state.compare(rest(rows))
        if state.found is not None:
            stay.append(state.found)
    return state.found
