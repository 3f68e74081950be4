"""The corpus pipeline: quality, exact copies, near copies, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. A stage writes tables of its own to the shared
folder, of row keys, digests, fingerprints and counts, never of texts: rows are kept or dropped
by lists of row keys, and texts move only from one stage's files to the next's. ``run``
deletes a stage's tables once its result is written; who chains stages by hand keeps them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from meridia.llm import quality
    from meridia.llm.common import table

    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from meridia.llm import exact_dedup

    return exact_dedup.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from meridia.llm import simhash

    return simhash.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from meridia.llm import mixture

    return mixture.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from meridia.llm import bpe

    # the executors still hold what earlier stages have used
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, room=0.7)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("simhash near-dedup", without_near_copies),
    ("mixture", mixed),
    ("byte-level bpe", tokens),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridia.llm.common import discard, materialise, table, tables_made

    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with tables_made() as made:
            docs = materialise(stage(spark, docs, sf_dir))
        *spent, result = made
        for path in [*spent, last] if last else spent:
            discard(spark, path)
        last = result
    return docs
