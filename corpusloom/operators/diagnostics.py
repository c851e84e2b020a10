"""Reports on the health of chunks and vectors: rows of (check, status, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _rows(one: DataFrame, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    row = lambda name, bad, value: F.struct(F.lit(name).alias("check"), F.when(bad, "fail").otherwise("ok").alias("status"), value.cast("double").alias("value"))
    return one.select(F.explode(F.array(*(row(*c) for c in checks))).alias("r")).select("r.*")


def text_report(chunks: DataFrame, content: str = "content", short: int = 50) -> DataFrame:
    """Counts of all, empty and short texts; any empty one fails."""
    text = F.col(content)
    one = chunks.agg(F.count("*").alias("n"), F.count_if(text.isNull() | (F.trim(text) == "")).alias("empty"), F.count_if(F.length(text) < short).alias("short"))
    return _rows(one, [("chunks", F.col("n") == 0, F.col("n")), ("empty", F.col("empty") > 0, F.col("empty")), ("short", F.lit(False), F.col("short"))])


def embedding_report(vectors: DataFrame, expected: int, size: int) -> DataFrame:
    """Whether there are as many vectors as expected, all of one plausible size and none empty."""
    n = F.size("embedding")
    one = vectors.agg(F.count("*").alias("n"), F.count_if(F.col("embedding").isNull() | (n == 0)).alias("empty"), F.count_if(n != size).alias("wrong"))
    return _rows(one, [("dimension", F.lit(size <= 0), F.lit(size)), ("small dimension", F.lit(size < 100), F.lit(size)), ("total", F.col("n") != expected, F.col("n")), ("empty vectors", F.col("empty") > 0, F.col("empty")), ("other dimension", F.col("wrong") > 0, F.col("wrong"))])


def with_symbol(chunks: DataFrame, symbol: str, columns: tuple[str, ...] = ("name", "id", "content")) -> DataFrame:
    """Chunks with the symbol in their name, id or content, whatever the case."""
    some = F.lit(False)
    for c in columns:
        some |= F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(symbol.lower())), F.lit(False))
    return chunks.where(some)


def run_report(files: DataFrame) -> DataFrame:
    """Parsed and failed files by language."""
    return files.groupBy("lang").agg(F.count_if(F.col("error").isNull()).alias("parsed"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.sum("loc").alias("loc"))


def kinds(chunks: DataFrame, by: str = "chunk_type") -> DataFrame:
    """(kind, n, share in percent) of each kind of chunk."""
    counts = chunks.groupBy(F.col(by).alias("kind")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).select("kind", "n", F.round(100.0 * F.col("n") / F.col("_all"), 1).alias("share"))


def stored(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(path, bytes, files) of stored tables and indices; a folder that isn't there has null bytes and no files."""
    rows = []
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = fs.getContentSummary(path) if fs.exists(path) else None
        rows.append((folder, found.getLength() if found else None, found.getFileCount() if found else 0))
    return spark.createDataFrame(rows, "path string, bytes long, files long")
