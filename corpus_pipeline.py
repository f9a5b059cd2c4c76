"""The corpus pipeline: language, repeated lines, near-duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; what it returns is written as
Parquet and read again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, decontaminate, language_id, line_dedup, simhash_dedup
from skein.llm.common import shared_dir, stored, table


#: The share of a document's letters that one language must have. Foreign spans, rough and bilingual text stay, mixtures go.
SHARE = 0.4


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language: null text, text without a letter, or no language for SHARE of the letters."""
    return language_id.identified(docs, language_id.train(docs), SHARE)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that three or more documents share out of all but the last of them; no document goes."""
    made, changed = line_dedup.dedup(docs), F.col("n_dropped") > 0
    own = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return made.select(*[(F.when(changed, own[c]).otherwise(F.col("doc")[c]) if c in own else F.col("doc")[c]).alias(c) for c in docs.columns])


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates stays."""
    return simhash_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes what is left; one row a document."""
    return bpe.digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_identified),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", keep_one_of_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("bpe", tokenize),
]

#: SQL can express neither the learned language model nor the merges; the tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"{folder}/{k}-{name}")
    return docs
