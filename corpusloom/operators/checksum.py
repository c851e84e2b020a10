"""What has changed between two states of a source tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_hashes(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, hash, lines): SHA-256 of the bytes, and the number of newlines."""
    text = F.col(content)
    return files.select(F.col(path).alias("path"), F.sha2(text.cast("binary"), 256).alias("hash"), (F.octet_length(text) - F.octet_length(F.replace(text.cast("string"), F.lit("\n"), F.lit("")))).cast("long").alias("lines"))


def project_hash(hashes: DataFrame) -> DataFrame:
    """One row: the SHA-256 of all file hashes in the order of their paths, the number of files and of lines.

    The digests are first combined by the first four characters of the path's hash, so a list holds a 65,536th of the
    files, then those parts are.
    """
    part = hashes.groupBy(F.substring(F.sha2("path", 256), 1, 4).alias("part")).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "hash"))), lambda x: x["hash"]), ""), 256).alias("h"), F.count("*").alias("files"), F.sum("lines").alias("lines")
    )
    return part.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), ""), 256).alias("hash"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))


def compared(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change): added, deleted, modified or same of two states (path, hash)."""
    a, b = stored.select("path", F.col("hash").alias("_a")), current.select("path", F.col("hash").alias("_b"))
    return a.join(b, "path", "full").select("path", F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(F.col("_a") != F.col("_b"), "modified").otherwise("same").alias("change"))


def change_share(changes: DataFrame) -> DataFrame:
    """One row: changed files to stored files; 1.0 where nothing is stored."""
    changed, stored = F.count_if(F.col("change") != "same"), F.count_if(F.col("change") != "added")
    return changes.agg(F.when(stored == 0, 1.0).otherwise(F.try_divide(changed, stored)).alias("share"))


def staleness(share: Column, warn: float = 0.10, refuse: float = 0.30) -> Column:
    return F.when(share > refuse, "refuse").when(share > warn, "warn").otherwise("fresh")


def missing(required: DataFrame, present: DataFrame) -> DataFrame:
    """Required paths that aren't there."""
    return required.join(present, "path", "left_anti")


def save(hashes: DataFrame, path: str) -> None:
    """A state of the sources, to be compared with later ones."""
    hashes.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, hash string, lines long").parquet(path)
