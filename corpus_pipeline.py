"""A training corpus from ``documents`` in five stages, each one operator of ``panelkit.llm``.

Each stage takes (spark, docs, sf_dir) and returns rows with the columns of ``documents``; the last one returns the
shards. A stage sees all rows that its predecessor kept, and no others.

Defined cases: an empty table goes through all stages as an empty one, and so does what a stage leaves empty; columns of
any other name ride along up to the last stage and are never read; texts count whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelkit.llm import decontaminate, language_id, minhash, mixing, sharding
from panelkit.llm._work import keep

#: Neither the language model nor the similarity of full sets can be said in SQL.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a clear language go.

    So do null and empty texts. Rows with a null ``lang`` are predicted but not learned from; without any known language
    all rows go. Repeated rows share one fate.
    """
    model = language_id.train(language_id.training_rows(docs))
    return language_id.keep_known(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id.

    Of repeated rows, and of rows that tie for the smallest id, all that the operator marks as kept stay, as each row
    follows its own decision; a null id gives way to any other.
    """
    return minhash.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a test phrase occurs go; a null or empty text, or item, matches nothing."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: documents without words not at all, a null source as one of its own.

    Repeated rows take copies each for itself.
    """
    return mixing.mix_rows(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row goes; repeated rows, null ids and null texts get slots as any others."""
    return sharding.shard(docs)


STAGES = [
    ("language ID", known_language),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = keep(docs, f"stage-{k}")
    return docs
