"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing to target weights, packing.

Each stage works on all that the one before kept. Its rows are written to the shared folder and read again, so a lost
executor repeats at most one stage.

Defined results, for every stage: a null text counts as empty; columns of any name are carried along by all but the last stage; repeated rows and null ids are rows like
any other (of equal texts one id stays, with all rows that share it); an empty table gives no rows. An empty text goes at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from watchloom.llm import exact_dedup, language_id, mixing, near_dedup, packing
from watchloom.llm._shared import save, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learnt; those without letters, or that no language has half of, go."""
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.keep_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are linked the one with the smallest id stays."""
    return near_dedup.keep_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh as the square root of their size; a document comes as often as its Poisson count says."""
    return mixing.mix(docs, numbered=False)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document: sequences of power-of-two lengths that cross no document."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("exact", drop_exact_copies),
    ("near", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: SQL can't express the learnt language model, the shingle hashes or the tokenizer; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
