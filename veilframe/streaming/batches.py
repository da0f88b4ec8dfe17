"""Releases of a stream, one micro-batch at a time.

Transforms are stateless and run on a stream as they are (``transformed``). Suppression
needs a closed set of rows: ``release_batches`` applies it to each micro-batch, which is
weaker than over all rows, for a person may be in several batches.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from veilframe.config import Settings, load
from veilframe.errors import PolicyError, RiskError
from veilframe.plans.engine import release
from veilframe.plans.policy import Request, fold

log = logging.getLogger(__name__)


def transformed(stream: DataFrame, request: Request, key: bytes, public: bool = False) -> DataFrame:
    """A stream with all transforms but noise."""
    if any(p.action == "dp_laplace" for p in request.policies):
        raise PolicyError("a stream is not noised: a restart would draw again")
    return fold(stream, request.policies, key, public)


def release_batches(stream: DataFrame, request: Request, path: str, key: bytes, settings: Settings | None = None) -> DataStreamWriter:
    """A writer that releases each micro-batch to a folder of its own, once.

    A batch that a guardrail refuses is not written: it is logged, and its number and the
    reason go to ``path``.refused. A batch that is run again replaces what it wrote.
    """
    settings = settings or load()
    if any(p.action == "dp_laplace" for p in request.policies):
        raise PolicyError("a stream is not noised: a restart would draw again")

    def each(df: DataFrame, number: int) -> None:
        if df.isEmpty():
            return
        try:
            found = release(df, request, settings, key=key, name=f"batch-{number}")
        except RiskError as e:
            log.warning("batch %d is not released: %s", number, e)
            spark = df.sparkSession
            refused = spark.createDataFrame([(number, df.count(), str(e))], "batch long, rows long, reason string")
            refused.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}.refused/batch={number}")
            return
        found.df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(each)
