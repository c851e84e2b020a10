"""Changed files as a stream: new versions arrive as rows, and only what changed is parsed again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..schema import PARSED
from ..sources.files import parsed

VERSIONS = "path string, content string, lang string, loc long, at timestamp"


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of file versions (VERSIONS) from Parquet files that are put in a folder."""
    return spark.readStream.schema(VERSIONS).parquet(folder)


def changes(versions: DataFrame, known: DataFrame) -> DataFrame:
    """Of versions (VERSIONS) the latest of each path, where it is newer than the one in ``known`` (path, hash, at) and differs from it.

    Each is compared with the version before it and with no earlier one, so a file that is changed back is a change.  Equal
    times go by content.
    """
    latest = versions.groupBy("path").agg(F.max_by(F.struct("content", "lang", "loc"), F.struct("at", "content")).alias("v"), F.max("at").alias("at")).select("path", "v.*", "at", F.sha2("v.content", 256).alias("hash"))
    old = known.select("path", F.col("hash").alias("_hash"), F.col("at").alias("_at"))
    return latest.join(old, "path", "left").where("_at IS NULL OR (at >= _at AND hash IS DISTINCT FROM _hash)").drop("_hash", "_at")


def keep_parsed(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Parses the changed files of each batch to ``out``, one folder a batch, so a batch that is run again replaces itself."""

    def write(batch: DataFrame, n: int) -> None:
        known = current(batch.sparkSession, out, before=n)
        changed = changes(batch, known)
        parsed(changed).join(changed.select("path", "hash", "at"), "path").write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """The latest record of each path; with ``before`` of the batches before that one."""
    schema = f"{PARSED}, hash string, at timestamp, batch int"
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    there = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
    rows = spark.read.schema(schema).option("basePath", out).parquet(out) if there else spark.createDataFrame([], schema)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    return rows.groupBy("path").agg(F.max_by(F.struct("lang", "loc", "error", "functions", "classes", "imports", "hash", "at"), "batch").alias("r")).select("path", "r.*")


def events_by_window(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of versions by language in windows of time, once a window can't change any more."""
    return stream.withWatermark("at", late).groupBy(F.window("at", width), "lang").agg(F.count("*").alias("versions"))
