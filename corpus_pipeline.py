"""The corpus pipeline: documents in, training sequences out.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and is written as Parquet
and read again before the next one starts. All but the last return the columns of documents.

Defined results: a null or empty text has no language, so the first stage drops it; texts equal in bytes become one
in the second, of near copies the smallest doc_id (nulls last) stays in the third, and repeated rows are copies like any
other; the fourth leaves every row, though perhaps with an empty text; the last has a row for each piece, one without a
bin where a text is empty, and very long texts make several. Null ids, languages and sources are carried along, as is any
further column, whatever its name, up to the last stage; empty tables give empty ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import exact_dedup, langid, near_dedup, packing, suffix_dedup
from pagemill.llm.common import shared_dir
from pagemill.sources.tables import delete, mark, release


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language, which becomes their lang; null, empty and unidentified texts go."""
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each distinct text, that with the smallest doc_id; of several rows with that doc_id one."""
    return exact_dedup.drop_exact_repeats(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id."""
    return near_dedup.drop_near_repeats(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the passages that stand in an earlier one; n_chars follows. No row goes."""
    return suffix_dedup.drop_repeated_spans(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequence (bin) of each piece of every document: (doc_id, piece, start, length, bin)."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("suffix_dedup", passages),
    ("best_fit_packing", sequences),
]

#: Code lengths, near groups and packing can't be put in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents. What a stage stored for itself, and its input, are deleted when its output is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        since, path = mark(), f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark, since)
        if before:
            delete(spark, before)
        before = path
    return docs
