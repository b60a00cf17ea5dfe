"""From raw documents to packed training sequences: five stages, each written and read again.

Every stage works on all rows that the one before it kept.  Stages 1-4 return the columns of
``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import exact_dedup, jaccard, language, packing, secrets
from quire.llm.tables import keep, kept, release

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are no written language (see ``language.readable``) go; a document without a language gets the predicted one."""
    return language.readable(docs, language.train(docs), label="lang" if "lang" in docs.columns else None)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of texts that are equal but for white space stays."""
    return exact_dedup.unique(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the Jaccard join the document with the smallest id stays."""
    return jaccard.representatives(docs)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the secrets found in its text are masked."""
    hidden = secrets.redact(docs)
    return hidden.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else hidden


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return packing.report(docs, TOKENIZER)


STAGES = [
    ("language id", language_id),
    ("exact dedup", exact_copies),
    ("jaccard join", near_copies),
    ("secret scans", secret_spans),
    ("packing", packed),
]

#: Language prediction and packing have no SQL form; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


#: Rows that go to a Python worker at once: the stages hold a whole batch.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 4000


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table.  What a stage has kept, and its input, is deleted when its result is written;
    the last result stays in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, first = spark.conf.get(BATCH[0]), kept()
    spark.conf.set(*BATCH)
    try:
        for name, stage in STAGES:
            docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            release(spark, first, last=1)
    finally:
        spark.conf.set(BATCH[0], before)
    return docs
