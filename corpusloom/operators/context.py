"""The index that an assistant reads: chunks, how they hang together, their tags, entry points and totals, as stored tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph
from .indices import inverted_tags


@dataclass
class ContextIndex:
    """Tables: chunks (with ``is_entry_point``), relations (src, dst, relation), tags (key, values), entry_points, info (one row)."""

    chunks: DataFrame
    relations: DataFrame
    tags: DataFrame
    entry_points: DataFrame
    info: DataFrame

    def save(self, root: str, mode: str = "overwrite") -> None:
        """Writes the tables; the chunks once, and their tags from what was written."""
        self.chunks.write.mode(mode).parquet(f"{root}/chunks")
        chunks = self.chunks.sparkSession.read.parquet(f"{root}/chunks")
        for name, df in (("relations", self.relations), ("tags", inverted_tags(chunks, F.col("tags"), F.col("id"))), ("entry_points", self.entry_points), ("info", self.info)):
            df.write.mode(mode).parquet(f"{root}/{name}")

    def by_tag(self, tag: str) -> DataFrame:
        """The chunks that have a tag."""
        return self.chunks.where(F.array_contains("tags", tag))

    def related(self, ids: DataFrame, direction: str = "out") -> DataFrame:
        """(of, chunk columns): the chunks that those of ``ids`` (id) refer to, or with ``in`` that refer to them."""
        near = graph.neighbours(self.relations, ids, direction)
        return near.select(F.col("id").alias("of"), F.col("neighbour").alias("id")).join(self.chunks, "id")

    def stats(self) -> DataFrame:
        """One row: chunks, chunks by type, relations, entry points, tags, mean importance."""
        kinds = self.chunks.groupBy("chunk_type").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chunk_type", "n")))).alias("chunk_types"))
        one = self.chunks.agg(F.count("*").alias("chunks"), F.count_if("is_entry_point").alias("entry_chunks"), F.avg("importance_score").alias("importance"))
        return one.crossJoin(kinds).crossJoin(self.relations.agg(F.count("*").alias("relations"))).crossJoin(self.entry_points.agg(F.count("*").alias("entry_points"))).crossJoin(self.tags.agg(F.count("*").alias("tags")))


def built(chunks: DataFrame, edges: DataFrame, entry_points: DataFrame, metadata: DataFrame | None = None, dimension: int = 384) -> ContextIndex:
    """The index of chunk rows, call-graph edges and entry points; ``metadata`` (languages) and the vectors' size go into ``info``."""
    starts = entry_points.select(F.col("path").alias("file_path"), F.col("function").alias("id"), F.lit(True).alias("_entry")).distinct()
    known = chunks.join(starts, ["file_path", "id"], "left").withColumn("is_entry_point", F.coalesce("_entry", F.lit(False))).drop("_entry")
    relations = edges.where("dst IS NOT NULL").select("src", "dst", graph.relation_type(F.col("edge_type")).alias("relation")).distinct()
    info = known.agg(F.count("*").alias("total_chunks")).withColumn("embedding_dimension", F.lit(dimension))
    if metadata is not None:
        info = info.crossJoin(metadata.select("languages"))
    return ContextIndex(known, relations, inverted_tags(known, F.col("tags"), F.col("id")), entry_points, info)


def load(spark: SparkSession, root: str) -> ContextIndex:
    return ContextIndex(**{f.name: spark.read.parquet(f"{root}/{f.name}") for f in fields(ContextIndex)})


def formatted() -> Column:
    """The text of a chunk row for a prompt: file, type, name, a mark for entry points, and the content."""
    mark = F.when(F.col("is_entry_point"), "// [ENTRY POINT]").otherwise("")
    return F.concat(F.lit("// File: "), F.coalesce("file_path", F.lit("unknown")), F.lit("\n// Type: "), F.initcap("chunk_type"), F.lit("\n// Name: "), "name", F.lit("\n"), mark, F.lit("\n\n"), "content")
