"""Inverted indices: group to list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inverted(table: DataFrame, key: Column, value: Column) -> DataFrame:
    """(key, values): each key's distinct values, sorted.  A key that millions of rows share is for ``postings``."""
    return table.select(key.alias("key"), value.alias("v")).where("key IS NOT NULL").groupBy("key").agg(F.array_sort(F.collect_set("v")).alias("values"))


def postings(table: DataFrame, key: Column, value: Column, blocks: int = 1024) -> DataFrame:
    """(key, block, values): an inverted index whose lists are cut into ``blocks`` by a hash of the value.

    For keys that a great part of the table has: no list, and no task, holds more than a key's share of a block.  A
    look-up filters by key, a membership test by key and block.
    """
    block = F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int")
    return table.select(key.alias("key"), value.alias("v")).where("key IS NOT NULL").groupBy("key", block.alias("block")).agg(F.array_sort(F.collect_set("v")).alias("values"))


def inverted_tags(table: DataFrame, tags: Column, value: Column) -> DataFrame:
    return inverted(table.select(F.explode(tags).alias("_t"), value.alias("_v")), F.col("_t"), F.col("_v"))


def location(path: Column, line: Column) -> Column:
    return F.concat(path, F.lit(":"), line.cast("string"))


def lookup(index: DataFrame, key: str) -> DataFrame:
    return index.where(F.col("key") == key)


def external_dependencies(imports: DataFrame) -> DataFrame:
    """(name, used_by, import_count) of imports (module, path) that are external: the distinct files of each module."""
    files = imports.where("type = 'external'").groupBy(F.col("module").alias("name")).agg(F.array_sort(F.collect_set("path")).alias("used_by"))
    return files.withColumn("import_count", F.size("used_by").cast("long"))
