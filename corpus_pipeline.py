"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``. All but the last return the columns of
``documents`` (others are dropped); the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenequality.llm.common import table
from scenequality.llm.language import UNDETERMINED, identify, learnable
from scenequality.llm.near_dup import first_of_classes
from scenequality.llm.packing import pack_documents
from scenequality.llm.pii import find_personal_data, masked
from scenequality.llm.queries import WORD_BPE_END, vocabulary
from scenequality.session import cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Name every document's language from its text, learned from the labelled ones, and write it into ``lang``.

    Documents without a letter (null and empty texts too) go; of several languages the one of most letters counts. If
    no document with a label may be learned from, every document stays as it is.
    """
    docs = docs.select(*COLUMNS)
    if learnable(docs).isEmpty():
        return docs
    found = identify(docs, docs)
    kept = found.where(F.col("lang_pred") != UNDETERMINED)
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate class: that of smallest doc_id.

    A row without a doc_id stays only where its class has no numbered document.
    """
    return first_of_classes(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every span of personal data by its kind in brackets and bring n_chars up to date; none goes."""
    found = find_personal_data(docs.select(*COLUMNS))
    hit = F.size("spans") > 0
    text = F.when(hit, masked(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return found.select(
        "doc_id", text.alias("text"), "lang", "source",
        F.when(hit, F.char_length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of every document left into sequences: one row per piece."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"), WORD_BPE_END)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", packing),
]

#: SQL expresses neither the learned language model, nor the shingle classes, nor the vocabulary; tests hold run()
#: against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for position, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if position + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
