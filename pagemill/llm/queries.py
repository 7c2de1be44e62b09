"""The queries of this subpackage, with production parameters, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exact_dedup, langid, license_scan, near_dedup, packing, sp_codec, suffix_dedup, toxicity, warc_zip
from .common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents")).drop("uid")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, looked up in the index of the earlier half: members and, grouped among themselves, nonmembers."""
    docs = table(spark, sf_dir, "documents")
    return exact_dedup.exact_repeats(docs, exact_dedup.earlier_half(docs), inside=True)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_repeats(table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours, among all rows, of those whose id is divisible by 100."""
    return ann.neighbours(table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 100 == 0)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.notices(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_codec.encode_docs(table(spark, sf_dir, "documents"), decoded=True)


def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
