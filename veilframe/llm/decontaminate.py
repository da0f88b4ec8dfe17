"""Passages of a benchmark in documents, by a prefix-filtered set join.

An item's windows are its runs of ``width`` words. A window is held by a document if all of
its shingles are, so any one of them is a prefix that is enough to look it up by:

1. The shingles of all windows are counted in all documents. A window with a shingle that
   no document holds is given up.
2. Shingles are ordered by that count, and each window is looked up by its rarest.
3. Documents' shingles meet these prefixes. The place of the shingle in the window gives
   the place of the window in the document (positional bound), which must begin and end
   within the document (length bound).
4. The words that stand there are compared with the window's: an exact containment.

Documents are read a word a row within a task, and what does not match goes no further:
only matches are shuffled. Windows are distinct, and documents with the same windows share
their list of items, so copies of items or documents do not multiply. Everything here is
DataFrame operations; no Python runs on the executors.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm._store import BROADCAST_ROWS, keep, looked_up, sized

#: What stands between words, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a shingle; shorter windows are one shingle.
SHINGLE = 3
#: Counted shingles in one broadcast; they are whole numbers.
COUNTED_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # lower() changes A-Z only where all characters are ASCII.
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(low, BETWEEN), "")


def _shingle(words: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *[F.get(words, at + k) for k in range(n)])


def windows(items: DataFrame, width: int) -> DataFrame:
    """(item_id, window, words): each run of ``width`` words of each item, or all of a shorter one."""
    held = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("all"))
    n = F.least(F.size("all"), F.lit(width))
    each = held.select("item_id", "all", F.posexplode("all").alias("at", "_")).where(F.col("at") + n <= F.size("all"))
    each = each.select("item_id", F.slice("all", F.col("at") + 1, n).alias("words"))
    return each.select("item_id", F.left(F.sha2(F.array_join("words", " "), 256), F.lit(32)).alias("window"), "words")


def shingles(held: DataFrame) -> DataFrame:
    """(window, at, shingle): the shingles of distinct windows, with their places."""
    n, at = F.size("words"), F.col("at")
    each = held.select("window", "words", F.posexplode("words").alias("at", "_")).where(at + F.least(n, F.lit(SHINGLE)) <= n)
    hashed = F.lit(None).cast("long")
    for k in range(1, SHINGLE + 1):
        hashed = F.when(F.least(n, F.lit(SHINGLE)) == k, _shingle(F.col("words"), at, k)).otherwise(hashed)
    return each.select("window", "at", hashed.alias("shingle"))


def _read(docs: DataFrame) -> DataFrame:
    """doc_id, a name of the text, and the words of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.left(F.sha2(text, 256), F.lit(32)).alias("name"), words_of(F.col("text")).alias("all"))


def _shingled(read: DataFrame, sizes: list[int]) -> DataFrame:
    """A row for each place in each document, and for each size of shingle there."""
    each = read.select("*", F.posexplode("all").alias("place", "_")).drop("_")
    found = [_shingle(F.col("all"), F.col("place"), n) for n in sizes]
    return each.withColumn("shingle", found[0] if len(found) == 1 else F.explode(F.array(*found)))


def _blocks(table: DataFrame, rows: int) -> list[DataFrame]:
    """A kept table in parts of about ``rows`` rows."""
    n = math.ceil(table.count() / rows)
    return [table.where(F.pmod("shingle", F.lit(n)) == k) if n > 1 else table for k in range(n)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def matches(docs: DataFrame, held: DataFrame, rows: int = BROADCAST_ROWS, counted_rows: int = COUNTED_ROWS) -> DataFrame | None:
    """(doc_id, name, start, n, window): where distinct windows stand in documents; None if there is no window."""
    at = keep(shingles(held), "shingles")
    sizes = sorted(r[0] for r in held.select(F.least(F.size("words"), F.lit(SHINGLE))).distinct().collect())  # three at most
    if not sizes:
        return None
    read = _read(docs)
    asked = keep(at.select("shingle").distinct(), "asked")
    counts = [_shingled(read.select("all"), sizes).join(F.broadcast(b), "shingle", "left_semi").groupBy("shingle").agg(F.count(F.lit(1)).alias("count")) for b in _blocks(asked, counted_rows)]
    counts = keep(_union(counts), "rarity")
    least = at.join(counts, "shingle", "left").groupBy("window").agg(F.min(F.struct("count", "shingle", "at")).alias("least"), F.bool_and(F.col("count").isNotNull()).alias("all"))
    prefixes = least.where("all").select("window", "least.shingle", "least.at").join(held, "window")
    prefixes = keep(prefixes.select("shingle", "at", "window", F.size("words").alias("n"), "words"), "prefixes")
    start = F.col("place") - F.col("at")
    inside = (start >= 0) & (start + F.col("n") <= F.size("all"))
    same = F.slice("all", F.greatest(start, F.lit(0)) + 1, F.col("n")) == F.col("words")
    found = [_shingled(read, sizes).join(F.broadcast(b), "shingle").where(inside & same).select("doc_id", "name", start.alias("start"), "n", "window") for b in _blocks(prefixes, rows)]
    return _union(found) if found else None


def contaminated(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of documents.

    docs: doc_id, text; items: item_id, text; other columns are ignored. n_hit counts the
    words that lie in any occurrence of a window, n_items the items whose windows occur, and
    items_sha256 is the SHA-256 of their ids, sorted as strings and joined by commas.

    Null and empty texts have no words; an item without words has no window. Texts are whole,
    however long. Rows that repeat a doc_id are each judged by their own text, rows without a
    doc_id too. Of items that repeat an id, all windows belong to it; the windows of an item
    without an id hit words, but it is not counted. An empty table of documents gives an
    empty result, one of items no hits.
    """
    all_ = keep(windows(items, width), "item-windows")
    held = keep(all_.groupBy("window").agg(F.first("words").alias("words")), "windows")
    members = keep(all_.where("item_id is not null").select("window", "item_id").distinct(), "items")
    rows = _read(docs).select("doc_id", "name", F.size("all").cast("long").alias("n_words"))
    none = {"n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit(""), 256)}
    found = matches(docs, held)
    if found is None:
        return rows.drop("name").withColumns(none).withColumn("contaminated", F.lit(False))
    # Repeated rows of a doc_id and text say the same.
    found = found.distinct().withColumn("end", F.col("start") + F.col("n"))
    before = Window.partitionBy("doc_id", "name").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    hits = found.withColumn("new", new).groupBy("doc_id", "name").agg(F.sum("new").alias("n_hit"), F.array_sort(F.collect_set("window")).alias("held"))
    hits = keep(hits.withColumn("set", F.sha2(F.array_join("held", ""), 256)), "hits")
    sets = hits.groupBy("set").agg(F.first("held").alias("held"), F.count(F.lit(1)).alias("n"))
    each = sets.select("set", "n", F.explode("held").alias("window")).join(sized(members), "window", "left")
    ids = F.array_sort(F.collect_set("item_id"))
    sets = each.groupBy("set").agg(F.max("n").alias("n"), ids.alias("ids")).select("set", "n", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    hits = looked_up(hits.select("doc_id", "name", "n_hit", "set"), keep(sets, "item-sets"), "set", ["n_items", "items_sha256"])
    hits = hits.select(F.col("doc_id").alias("id"), F.col("name").alias("of"), "n_hit", "n_items", "items_sha256")
    out = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("name") == F.col("of")), "left")
    return out.select("doc_id", "n_words", *[F.coalesce(F.col(c), zero).alias(c) for c, zero in none.items()], F.col("n_hit").isNotNull().alias("contaminated"))
