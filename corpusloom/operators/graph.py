"""Graphs as two tables, nodes (id, ...) and edges (src, dst, ...)."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_nodes(*parts: DataFrame, key: str = "id") -> DataFrame:
    """The union of node tables; of nodes with one id the row of the least node_type stays."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    others = [c for c in out.columns if c != key]
    return out.groupBy(key).agg(F.min(F.struct(*others)).alias("n")).select(key, *(F.col(f"n.{c}").alias(c) for c in others))


def in_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with ``call_count_estimate``, the number of edges that end in them."""
    counts = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("call_count_estimate"))
    return nodes.join(counts, "id", "left").withColumn("call_count_estimate", F.coalesce("call_count_estimate", F.lit(0)))


def neighbours(edges: DataFrame, of: DataFrame, direction: str = "out") -> DataFrame:
    """(id, neighbour), each once, of the ids in ``of`` (id): along the edges, or against them."""
    here, there = ("src", "dst") if direction == "out" else ("dst", "src")
    return edges.select(F.col(here).alias("id"), F.col(there).alias("neighbour")).join(of.select("id").distinct(), "id", "left_semi").distinct()


def reachable(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, id, depth): what each root reaches in at most ``depth`` steps, by the shortest way, without itself.

    A frontier join for each step against what was seen, so cycles end and a node is expanded once; the steps' plans are
    a chain of ``depth`` joins, for small fixed depths.  ``shortest_depths`` is for any depth.
    """
    seen = roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")).distinct()
    frontier = seen
    step = edges.select(F.col("src").alias("id"), F.col("dst").alias("to")).distinct()
    for d in range(1, depth + 1):
        frontier = frontier.join(step, "id").select("root", F.col("to").alias("id"), F.lit(d).alias("depth")).distinct().join(seen.select("root", "id"), ["root", "id"], "left_anti")
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def transitive_dependencies(edges: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """What a root depends on through at most depth + 1 edges."""
    return reachable(edges, roots, depth + 1)


def shortest_depths(edges: DataFrame, roots: DataFrame, most: int | None = None, checkpoint_every: int = 5) -> DataFrame:
    """(id, depth): the least number of edges from any root to each node that one reaches.

    Breadth first over the whole graph with a table of seen nodes that is checkpointed as it grows, so neither the plan
    nor the lineage does; for deep graphs.  It goes on until nothing new is reached; a graph deeper than ``most``, if that is
    given, is an error.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    step = edges.select(F.col("src").alias("id"), F.col("dst").alias("to")).distinct()
    seen = frontier = roots.select("id", F.lit(0).alias("depth")).distinct()
    for d in itertools.count(1):
        frontier = frontier.join(step, "id").select(F.col("to").alias("id"), F.lit(d).alias("depth")).distinct().join(seen, "id", "left_anti").checkpoint()
        if frontier.isEmpty():
            return seen
        if most is not None and d > most:
            raise ValueError(f"the graph is deeper than {most}")
        seen = seen.unionByName(frontier)
        if d % checkpoint_every == 0:
            seen = seen.checkpoint()


def ensure_checkpoint_dir(spark) -> None:
    """Checkpoints go to the shared folder that the cluster names; a temporary one only on one machine."""
    from ..shipping import shared_folder

    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def resolved(calls: DataFrame, definitions: DataFrame, name: str = "callee") -> DataFrame:
    """calls with ``defined_in``: the file itself if it defines the name, else the first file that does, else null.

    The definitions are grouped to one row a name before the join, so homonyms don't multiply calls.
    """
    files = definitions.groupBy(F.col("name").alias(name)).agg(F.min("file").alias("_first"))
    own = definitions.select(F.col("name").alias(name), "file").distinct().withColumn("_own", F.lit(True))
    return calls.join(files, name, "left").join(own, [name, "file"], "left").withColumn("defined_in", F.when(F.col("_own"), F.col("file")).otherwise(F.col("_first"))).drop("_first", "_own")


def callers(calls: DataFrame) -> DataFrame:
    """(callee, called_by): the sorted callers of each name."""
    return calls.groupBy("callee").agg(F.array_sort(F.collect_set(F.struct(F.col("caller").alias("function"), "file", "line"))).alias("called_by"))


def first_callers(calls: DataFrame, most: int, parts: int = 64) -> DataFrame:
    """(callee, callers, first_callers): how many distinct callers each name has, and the first of them as ``callers`` sorts them.

    They are counted in parts by a hash, so a name that most of the calls have is no task's alone and no list holds them all.
    """
    first = lambda lists: F.slice(F.array_sort(lists), 1, most).alias("first_callers")
    each = calls.select("callee", F.struct(F.col("caller").alias("function"), "file", "line").alias("c")).distinct().groupBy("callee", F.pmod(F.xxhash64("c"), F.lit(parts)).alias("part"))
    return each.agg(F.count("*").alias("n"), first(F.collect_list("c"))).groupBy("callee").agg(F.sum("n").alias("callers"), first(F.flatten(F.collect_list("first_callers"))))


def paired(left: DataFrame, right: DataFrame, parts: int = 64) -> DataFrame:
    """(src, dst): the rows of left (name, src) and of right (name, dst) that share a name, each pair as often as in a join.

    Both are packed by name and a hash, and pairs of packs are dealt out before they are unfolded, so what two sides of one
    name make is the work of all tasks; no pack holds more than its part of a name.  Rows with a null in either column are left out.
    """
    packed = lambda df, c, part, out: df.where(F.col("name").isNotNull()).groupBy("name", F.pmod(F.xxhash64(c), F.lit(parts)).alias(part)).agg(F.collect_list(c).alias(out))
    tasks = parts * max(1, left.sparkSession.sparkContext.defaultParallelism // 16)
    packs = packed(left, "src", "_l", "_srcs").join(packed(right, "dst", "_r", "_dsts"), "name").repartition(tasks, "name", "_l", "_r")
    return packs.select(F.explode("_srcs").alias("src"), "_dsts").select("src", F.explode("_dsts").alias("dst"))


def dependency_graph(functions: DataFrame, classes: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of functions, methods and classes; ``calls`` edges to each definition of the name, ``contains`` edges from class to method."""
    nodes = distinct_nodes(functions.select("id", F.col("kind").alias("node_type"), F.col("path").alias("file"), "name"), classes.select("id", F.lit("class").alias("node_type"), F.col("path").alias("file"), "name"))
    called = paired(calls.select(F.col("callee").alias("name"), F.col("caller_id").alias("src")), functions.select("name", F.col("id").alias("dst")).distinct()).select("src", "dst", F.lit("calls").alias("edge_type"))
    contains = functions.where("class_name IS NOT NULL").select(F.concat(F.lit("class_"), "class_name").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("edge_type"))
    return nodes, called.unionByName(contains)


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("is_entry_point")).alias("entry_points")).crossJoin(edges.agg(F.count("*").alias("edges")))


def relation_type(edge_type: Column) -> Column:
    known = ("calls", "inherits", "imports", "contains", "uses")
    return F.when(F.lower(edge_type).isin(*known), F.lower(edge_type)).otherwise("uses")
