"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a join's side that are broadcast at most.
BROADCAST_ROWS = 1_000_000

_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, on one machine, a temporary one, and on a cluster an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def fresh(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses; it is removed when the driver ends."""
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Cuts the lineage: a lost executor costs the rewriting of nothing, and what follows reads a plain table.
    """
    path = fresh(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def document_id() -> Column:
    """doc_id as a number.  A row without one (null, or no number) gets an id of its text, under -2**62: equal texts are one document."""
    own = F.xxhash64(F.col("text").cast("string")).bitwiseAND(F.lit((1 << 62) - 1)) - F.lit((1 << 63) - 1)
    return F.coalesce(F.col("doc_id").try_cast("long"), own)


def with_ids(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_id", document_id())


def minus(docs: DataFrame, ids: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` whose ``document_id`` isn't in ``ids`` (doc_id).

    The ids are written first; with at most ``most`` of them they are broadcast, and the texts aren't shuffled; more are
    joined by a shuffle.
    """
    gone = written(ids.select(F.col("doc_id").alias("_gone")), "ids")
    gone = F.broadcast(gone) if gone.count() <= most else gone
    return docs.join(gone, document_id() == gone["_gone"], "left_anti")


@atexit.register
def _remove() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended before
            return
