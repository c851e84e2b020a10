"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, dedup, langid, lmscore, media, packing, quality, sharding, urlfilter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages alike: pages have the markup and address that documents lack."""
    documents = langid.records_of_documents(_table(spark, sf_dir, "documents"))
    return langid.identify(documents.unionByName(langid.records_of_pages(_table(spark, sf_dir, "pages"))), ["doc_id", "page_id"])


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = urlfilter.captures_of(_table(spark, sf_dir, "pages"))
    return urlfilter.judged(captures, urlfilter.entries_of(captures))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_media_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.tiled(media.pictures_of(_table(spark, sf_dir, "pages")), "page_id", "media")


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (op1_near_duplicates, op2_quality, op3_language, op4_url_filter, op5_sharding, op6_packing, op7_media_tiles, op8_benchmark_leaks, op9_warc_salvage, op10_lm_score)
}
#: The others can't be expressed in SQL (banding, fits, sequential placement, codecs); tests/llm holds them against brute force.
ORACLE_SQL = {"op3_language": langid.SQL, "op4_url_filter": urlfilter.SQL, "op8_benchmark_leaks": decontam.SQL}
