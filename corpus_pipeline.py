"""From raw documents to packed training sequences, in five stages.

Each stage takes all that the one before it kept, as a table that was written and read again, and all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import hyperminhash, packing, source_mix, suffix_dedup, toxicity
from lodestrata.llm.common import drop_stored, free_name, scratch, stored, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, learned from the labelled ones, takes as toxic go."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at similarity 0.8 or more, the smallest doc_id stays. Rows
    that repeat a doc_id and its text stay once; different texts of a doc_id, or without one, are documents of their own."""
    return hyperminhash.deduplicated(docs, width=5, percent=80)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that occur earlier are cut out, to whole characters; documents of which nothing is
    left go."""
    had = free_name(docs.columns, "_had")
    cut = suffix_dedup.without_repeats(docs.withColumn(had, F.coalesce(F.length("text"), F.lit(0))))
    cut = cut.where((F.col(had) == 0) | (F.length("text") > 0))
    return cut.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat as often as the Poisson draw of their source's rate says; sources weigh by size to the 0.7."""
    return source_mix.replicated(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 4096."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("repeated_passages", without_repeated_passages),
    ("source_mix", mixed),
    ("packing", packed),
]

#: A factorization machine and a similarity join with components are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before = docs
        with scratch(spark) as keep:  # what a stage wrote on its way goes with it
            docs = keep(stored(stage(spark, before, sf_dir), name))
        if k:
            drop_stored(before)
    return STAGES[-1][1](spark, docs, sf_dir)
