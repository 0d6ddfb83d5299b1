"""The corpus pipeline: language, quality, near copies, secrets, packing. Each stage reads what the one before wrote.

All stages take whole texts and any further columns, which they hand on; names of their own columns cannot clash with
those of the table. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import jaccard, language, packing, quality, secrets
from ledgerloom.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network recognises; it is trained on the stage's own labelled rows.

    A null or empty text, or one without letters, has no language and goes. Repeated rows are judged alike.
    """
    return language.keep_known(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and resemble the trusted ones.

    A null or empty text fails the base rules and goes. Repeated rows are judged alike; a null id is not trusted.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id.

    Texts without words are copies of nothing and stay. Of rows that repeat an id one stays; rows without id all stay.
    """
    return jaccard.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark. A null text stays null; repeated rows change alike."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids and their places in sequences. A null or empty text is its end id alone; repeated rows are packed each."""
    return packing.digests(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_encoder=False))


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language), ("quality", good_quality), ("jaccard", one_of_each), ("secrets", without_secrets), ("packing", packed),
]

#: No SQL: language and packing have no SQL form. tests/llm/test_pipeline.py holds every stage against its operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
