"""Bounded Laplace noise.

Noise is drawn from the operating system's generator, in Arrow batches, by a function
that Spark knows to be nondeterministic. A plan that holds it draws anew each time it
runs, which would let a reader average the noise away: ``release`` writes the noised
table once and everything after reads that.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.errors import PolicyError
from veilframe.functions.ledger import Ledger as Ledger


@dataclass(frozen=True)
class Noise:
    """epsilon and the bounds that a column's values are held to."""

    epsilon: float
    lower: float
    upper: float

    def __post_init__(self) -> None:
        if not all(map(math.isfinite, (self.epsilon, self.lower, self.upper))):
            raise PolicyError("epsilon and bounds must be finite")
        if self.epsilon <= 0 or self.upper <= self.lower:
            raise PolicyError("epsilon must be above 0 and the upper bound above the lower")

    @property
    def sensitivity(self) -> float:
        return self.upper - self.lower

    @property
    def scale(self) -> float:
        return self.sensitivity / self.epsilon


def inverse(p: Column, scale: float) -> Column:
    """The Laplace quantile of p in (0, 1)."""
    return F.when(p < 0.5, F.lit(scale) * F.log(2 * p)).otherwise(F.lit(-scale) * F.log(2 * (1 - p)))


def draw(n: int, scale: float) -> np.ndarray:
    """n Laplace values from 53 random bits each; a draw of 0 is drawn again."""
    bits = np.frombuffer(os.urandom(8 * n), np.uint64) >> np.uint64(11)
    while (zero := np.flatnonzero(bits == 0)).size:
        bits[zero] = np.frombuffer(os.urandom(8 * zero.size), np.uint64) >> np.uint64(11)
    p = bits.astype(np.float64) / 2.0**53
    return np.where(p < 0.5, scale * np.log(2 * p), -scale * np.log(2 * (1 - p)))


def bounded(v: Column, noise: Column, lower: float, upper: float) -> Column:
    """Held to the bounds, noised, held to the bounds again."""
    hold = lambda x: F.greatest(F.lit(float(lower)), F.least(F.lit(float(upper)), x))
    return F.when(v.isNotNull(), hold(hold(v.cast("double")) + noise))


def noised(v: Column, params: Noise) -> Column:
    """A column with noise of its own for each row; null stays null."""
    scale = params.scale

    @F.pandas_udf(T.DoubleType())
    def fresh(values: pd.Series) -> pd.Series:
        return pd.Series(draw(len(values), scale))

    return bounded(v, fresh.asNondeterministic()(v.cast("double")), params.lower, params.upper)
