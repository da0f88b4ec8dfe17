"""One query for each operator on training text, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import oracles
from veilframe.llm.audit import interactions
from veilframe.llm.codes import compress
from veilframe.llm.decontaminate import contaminated
from veilframe.llm.langid import identify
from veilframe.llm.linededup import line_classes
from veilframe.llm.minhash import near_duplicates
from veilframe.llm.mixing import mix
from veilframe.llm.packing import pack
from veilframe.llm.pii import digest, find
from veilframe.llm.secrets import find_secrets
from veilframe.llm.topk import top_k
from veilframe.llm.toxicity import score
from veilframe.llm.vecdedup import near_duplicate_vectors
from veilframe.session import ship


#: A public vocabulary that is installed beside Python on every machine.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack(_table(spark, sf_dir, "documents"), TOKENIZER, size=2048, end=1)


def op2_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels."""
    return score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents: 3-word shingles, 85 of 100 shared."""
    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op4_segment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate lines of all documents; short lines in classes of equal ones."""
    return line_classes(_table(spark, sf_dir, "documents"), short=True)


def op5_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all vectors of equal label: cosine 0.98."""
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op6_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best vectors of every 20th."""
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op7_information_theoretic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosive terms in all documents: better than even odds, at 90 % confidence."""
    return digest(find(_table(spark, sf_dir, "documents"), deviations=1.2816, least=0.5))


def op8_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words; sources weigh 5, 2, 1 in turn."""
    return mix(_table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), share=1.5, most=2)


def op9_trigram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return find_secrets(_table(spark, sf_dir, "documents"))


def op10_hyperdimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents; those whose crc32 leaves 2 are held out."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return identify(_table(spark, sf_dir, "documents"), held_out)


def op11_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as four codes each, from codebooks of 256 entries after four rounds."""
    return compress(_table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters do in each of their 120 orders, by source."""
    return interactions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_prefix_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of ten words of the benchmark in all documents."""
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_shortest_pack_first, op2_classifier_chain, op3_minhash, op4_segment_join, op5_pca_tiles, op6_maxscore, op7_information_theoretic, op8_entropy_balancing, op9_trigram_index, op10_hyperdimensional, op11_product_codes, op12_filter_interactions, op13_prefix_windows)}


def oracle_sql() -> dict[str, str]:
    """The other queries have no SQL: tests/llm hold them against brute force."""
    return {"op3_minhash": oracles.MINHASH, "op5_pca_tiles": oracles.VECTORS, "op6_maxscore": oracles.TOP_K, "op9_trigram_index": oracles.SECRETS, "op11_product_codes": oracles.CODES, "op12_filter_interactions": oracles.INTERACTIONS, "op13_prefix_windows": oracles.WINDOWS}
