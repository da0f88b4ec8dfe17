"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All
but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm._store import keep
from veilframe.llm.linededup import without_repeats
from veilframe.llm.minhash import without_near_duplicates
from veilframe.llm.mixing import mixed
from veilframe.llm.packing import pack
from veilframe.llm.queries import TOKENIZER
from veilframe.llm.toxicity import without_toxic
from veilframe.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject; null and empty texts stay."""
    return without_toxic(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one, exactly or, from 8 words on, but for one word.

    A document goes only if nothing but white space is left of it.
    """
    ship(spark)
    return without_repeats(docs, rest=True, short=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: five words, similarity 0.8; texts without words all stay."""
    ship(spark)
    return without_near_duplicates(docs, width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, whole; texts without words are not taken."""
    ship(spark)
    return mixed(docs, weights=(5.0, 2.0, 1.0), share=1.5, most=2, parts=False)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, and their places in sequences of 2048 tokens; every row is packed."""
    ship(spark)
    return pack(docs, TOKENIZER, size=2048, end=1)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Classifier, entropy balancing and tokenizer have no SQL. tests/llm hold the operators of the
#: stages against plain versions, and the stages to their columns, rows and odd tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over all documents."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = keep(docs, name.replace(" ", "-"))
    return docs
