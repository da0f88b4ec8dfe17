"""A Bloom filter of bounded size, to pick rows before an exact join.

It spares a shuffle of whole texts when a few of them are wanted. It never loses a row:
what it lets through by mistake falls to the join that follows. A filter has at most
``MOST_BITS`` bits (8 MB), whatever the number of keys; beyond some ten million keys it
lets everything through, and the join does all of the work.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BITS = 1 << 26


def _shifts(bits: int) -> tuple[int, int, int]:
    left = 64 - (bits.bit_length() - 1)
    return 0, left // 2, left


class Bloom:
    """Membership of the values of a column of 64-bit hashes, as a value that tasks can carry."""

    def __init__(self, keys: DataFrame, h: Column) -> None:
        n = keys.count()
        self.bits = min(MOST_BITS, max(1 << 10, 1 << (16 * n).bit_length()))
        places = F.array(*[F.shiftrightunsigned(h, k).bitwiseAND(self.bits - 1) for k in _shifts(self.bits)])
        at = keys.select(F.explode(places).alias("p"))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))
        words = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(one).alias("x")).toArrow()  # a row for 64 bits at most
        self.words = np.zeros(self.bits // 64, np.int64)
        self.words[words["w"].to_numpy()] = words["x"].to_numpy()

    def has(self, h: np.ndarray) -> np.ndarray:
        """Whether each hash may be there."""
        h, hit = h.view(np.uint64), np.ones(len(h), bool)
        for k in _shifts(self.bits):
            p = (h >> np.uint64(k)) & np.uint64(self.bits - 1)
            hit &= (self.words[(p >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (p & np.uint64(63))) & np.uint64(1) != 0
        return hit
