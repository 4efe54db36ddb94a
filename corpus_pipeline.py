"""The corpus pipeline: each stage takes what the stage before it kept.

Every stage takes (spark, docs, sf_dir).  All but the last return the columns of documents, whatever these are; the last returns a
digest of each document that is left.  Equal rows share their fate but where a stage says otherwise, and an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from folioscope.deploy import ship
from folioscope.llm import decontamination, jaccard, language, lines, pieces
from folioscope.llm.common import drop, shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, that some learned language claims.

    Null and empty texts go.  The model is fitted on the labelled rows of ``docs``; without any, no language is known and all go.
    """
    ship(spark)
    return language.keep_identified(docs, language.fit(docs.where(~language.held_out())))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand before them, or before in them, in about the same words; those left without a line go.

    Null texts and texts without a line of words stay as they are.  Equal rows keep the same lines; documents are ordered by doc_id,
    nulls first, then by a hash of the text.
    """
    ship(spark)
    return lines.stage(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of five words, similarity 0.8) the least doc_id.

    Texts without words, and rows without a doc_id, stay; all rows of the doc_id that stays, stay.
    """
    ship(spark)
    return jaccard.one_of_each(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (0.8 of its shingles of five words); all rows of a doc_id share its fate.

    Null texts and rows without a doc_id stay.
    """
    ship(spark)
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and hash of the ids, and whether decoding them gives the text back, of every row; null texts have no ids."""
    ship(spark)
    return pieces.digest(docs, pieces.Vocabulary.load(pieces.MODEL))


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("n-gram Jaccard join", jaccard_join), ("benchmark decontamination", decontaminate), ("SentencePiece encoding", sentencepiece)]

#: SQL can express neither the language model nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each one's rows are written to the shared folder and read again, and then the rows before go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                drop(spark, f"{folder}/{k - 1}")
    return docs
