"""A corpus pipeline of five stages over documents, each written as Parquet and read again as the next one's input.

Each stage works on all rows that the stage before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from windrow.llm.common import materialise, ship, table, temporary
from windrow.llm.exact_dedup import keep_first_copies
from windrow.llm.language_id import keep_identified
from windrow.llm.mixing import mix_rows
from windrow.llm.near_dedup import keep_one_of_near_copies
from windrow.llm.queries import MODEL
from windrow.llm.sentencepiece_bpe import tokenised


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language the trained machines can tell: a score of LEAST_SCORE or more.

    Texts in languages or scripts that weren't learned, null and letterless texts go. Repeated rows are treated
    alike; without labelled rows nothing can be told; no documents, no rows; columns stay, whatever their names.
    """
    ship(spark)
    return keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of equal texts.

    Null texts are empty ones; ids come before null ones; rows that repeat the kept id stay; no documents, no rows.
    """
    return keep_first_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies, the one with the smallest doc_id.

    Documents without words and components without any id stay; rows that repeat a kept id stay; no documents, no rows.
    """
    ship(spark)
    return keep_one_of_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents to meet the sources' targets: a row for each time that the mix takes a document.

    Documents without words are not taken; a null source is one like any other; of rows equal in all columns one
    stands for all; very long documents are taken whole or not; no documents, no rows.
    """
    return mix_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of the mix; null and empty texts have no ids; no documents, no rows."""
    ship(spark)
    return tokenised(docs, public_tokenizers.path(MODEL))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixture", mixture), ("tokens", tokens)]

#: No SQL: language identification, sketches and the tokenizer can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with temporary() as made:  # what a stage writes on its way goes when its result is written
            made.keep(docs := materialise(stage(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)
