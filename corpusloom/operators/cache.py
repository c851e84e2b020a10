"""A table of answers by question: (query_hash, query, response, checksum_hash, created_at, expires_at).

Every operation is a new table of rows; ``write`` replaces the stored one.  Times are columns, so a run can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["query_hash", "query", "response", "checksum_hash", "created_at", "expires_at"]


def query_hash(query: Column) -> Column:
    return F.sha2(query, 256)


def entries(answers: DataFrame, now: Column, hours: dict[str, int] | int = 24) -> DataFrame:
    """Entries of answers (query, response, checksum_hash) that end after ``hours``; a dict gives them by the column ``type``, with a default under ""."""
    if isinstance(hours, dict):
        known = F
        for kind, n in hours.items():
            known = known.when(F.col("type") == kind, n) if kind else known
        last = known.otherwise(hours.get("", 24)) if known is not F else F.lit(hours.get("", 24))
    else:
        last = F.lit(hours)
    return answers.select(query_hash(F.col("query")).alias("query_hash"), "query", "response", "checksum_hash", now.alias("created_at"), F.timestamp_add("HOUR", last, now).alias("expires_at"))


def upserted(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The latest entry of each question; of equal times the one with the greatest response."""
    both = cache.select(*COLUMNS).unionByName(new.select(*COLUMNS))
    latest = both.groupBy("query_hash").agg(F.max(F.struct("created_at", "response", "query", "checksum_hash", "expires_at")).alias("e"))
    return latest.select("query_hash", *(F.col(f"e.{c}").alias(c) for c in COLUMNS[1:]))


def hits(questions: DataFrame, cache: DataFrame, checksum: Column, now: Column) -> DataFrame:
    """questions (query) with the response that is still valid, null where there is none."""
    valid = cache.where((F.col("checksum_hash") == checksum) & (F.col("expires_at") > now)).select("query_hash", "response")
    return questions.withColumn("query_hash", query_hash(F.col("query"))).join(valid, "query_hash", "left")


def without(cache: DataFrame, prefix: str) -> DataFrame:
    """Without the entries whose hash begins so."""
    return cache.where(~F.startswith("query_hash", F.lit(prefix)))


def invalidated(cache: DataFrame, checksum: Column) -> DataFrame:
    """Only the entries of the current state of the sources."""
    return cache.where(F.col("checksum_hash") == checksum)


def unexpired(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(F.col("expires_at") >= now)


def stats(cache: DataFrame, now: Column) -> DataFrame:
    return cache.agg(F.count("*").alias("total"), F.count_if(F.col("expires_at") > now).alias("valid"))


def listed(cache: DataFrame) -> DataFrame:
    return cache.orderBy(F.desc("created_at"), "query_hash")


def matching(cache: DataFrame, part: str) -> DataFrame:
    """Entries whose question holds ``part``, whatever the case."""
    return cache.where(F.contains(F.lower("query"), F.lower(F.lit(part))))


def write(cache: DataFrame, path: str) -> None:
    cache.write.mode("overwrite").parquet(path)
