"""From a source tree to all tables: parsed files, facts, graph, indices, summary and chunks."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks, facts, graph, indices, patterns
from ..sources import files as source_files


@dataclass
class Knowledge:
    """The tables of a project.  All are lazy but ``parsed``, which is read from where it was written if a path was given.

    ``functions`` is ``located`` with ``called_by`` from ``callers``, which has each name's list once; as functions of one name
    share a list, the two are stored and the join isn't.
    """

    files: DataFrame
    parsed: DataFrame
    functions: DataFrame
    located: DataFrame
    callers: DataFrame
    classes: DataFrame
    imports: DataFrame
    global_vars: DataFrame
    todos: DataFrame
    security_notes: DataFrame
    calls: DataFrame
    nodes: DataFrame
    edges: DataFrame
    entry_points: DataFrame
    external_dependencies: DataFrame
    functions_by_name: DataFrame
    functions_by_tag: DataFrame
    functions_calling: DataFrame
    types_by_name: DataFrame
    files_by_category: DataFrame
    chunks: DataFrame
    metadata: DataFrame

    def write(self, root: str, mode: str = "errorifexists") -> None:
        for f in fields(self):
            if f.name not in ("files", "functions"):
                getattr(self, f.name).write.mode(mode).parquet(f"{root}/{f.name}")

    def write_json(self, root: str, names: tuple[str, ...] = ("functions", "classes", "metadata", "nodes", "edges", "chunks")) -> None:
        for name in names:
            getattr(self, name).write.json(f"{root}/{name}")


def load(spark: SparkSession, root: str) -> Knowledge:
    """The tables that ``Knowledge.write`` wrote; ``files`` are the parsed ones."""
    tables = {f.name: spark.read.parquet(f"{root}/{f.name}") for f in fields(Knowledge) if f.name not in ("files", "functions")}
    return Knowledge(files=tables["parsed"].select("path", "lang", "loc"), functions=facts.with_callers(tables["located"], tables["callers"]), **tables)


def edges_of(functions: DataFrame, classes: DataFrame, calls: DataFrame) -> DataFrame:
    """(src, dst, dst_name, edge_type, conditional, line): calls to each definition of the name in the file that the call resolves to, and bases.

    An edge to a name that is defined nowhere keeps a null dst.
    """
    where = graph.resolved(calls, functions.select("name", F.col("path").alias("file")))
    ids = functions.groupBy(F.col("name").alias("callee"), F.col("path").alias("defined_in")).agg(F.min("id").alias("dst"))
    called = where.join(ids, ["callee", "defined_in"], "left").select(F.col("caller_id").alias("src"), "dst", F.col("callee").alias("dst_name"), F.lit("calls").alias("edge_type"), F.col("is_conditional").alias("conditional"), "line")
    known = classes.groupBy(F.col("name").alias("dst_name")).agg(F.min("id").alias("dst"))
    bases = classes.select(F.col("id").alias("src"), F.explode("bases").alias("dst_name"), "line_start").join(known, "dst_name", "left").select("src", "dst", "dst_name", F.lit("inherits").alias("edge_type"), F.lit(False).alias("conditional"), F.col("line_start").alias("line"))
    return called.unionByName(bases)


def analyze(spark: SparkSession, root: str, out: str | None = None, **options) -> Knowledge:
    """All tables of the sources under ``root``; with ``out`` parsing and the resolving of calls are done once, to that folder."""
    files = source_files.read_tree(spark, root, **options)
    parsed = source_files.parsed(files)
    if out:
        parsed.write.mode("overwrite").parquet(f"{out}/parsed")
        parsed = spark.read.parquet(f"{out}/parsed")
    functions = facts.located(parsed)
    if out:
        functions.write.mode("overwrite").parquet(f"{out}/functions")
        functions = spark.read.parquet(f"{out}/functions")
    return tables(files, parsed, functions)


def tables(files: DataFrame, parsed: DataFrame, functions: DataFrame) -> Knowledge:
    """All tables from parsed files and their functions (``facts.located``; their callers are found here)."""
    functions = functions.drop("called_by")
    callers = facts.called(functions)
    classes = facts.exploded(parsed, "classes")
    imports, global_vars = facts.exploded(parsed, "imports"), facts.exploded(parsed, "global_vars")
    calls = facts.calls(functions)
    entry_points = patterns.entry_points(functions)
    edges = edges_of(functions, classes, calls)
    starts = entry_points.select(F.col("function").alias("id"), F.lit(True).alias("is_entry_point")).distinct()
    node = lambda df, kind: df.select("id", kind.alias("node_type"), F.col("path").alias("file"), "name")
    nodes = graph.distinct_nodes(node(functions, F.col("kind")), node(classes, F.lit("class"))).join(starts, "id", "left").withColumn("is_entry_point", F.coalesce("is_entry_point", F.lit(False)))
    nodes = graph.in_degrees(nodes, edges.where("dst IS NOT NULL"))
    secure = F.exists("functions", lambda f: F.lower(f["name"]).rlike("auth|security|encrypt|decrypt"))
    return Knowledge(
        files=files,
        parsed=parsed,
        functions=facts.with_callers(functions, callers),
        located=functions,
        callers=callers,
        classes=classes,
        imports=imports,
        global_vars=global_vars,
        todos=facts.exploded(parsed, "todos"),
        security_notes=facts.exploded(parsed, "security_notes"),
        calls=calls,
        nodes=nodes,
        edges=edges,
        entry_points=entry_points,
        external_dependencies=indices.external_dependencies(imports),
        functions_by_name=indices.inverted(functions, F.col("name"), indices.location(F.col("path"), F.col("line_start"))),
        functions_by_tag=indices.inverted_tags(functions, F.col("tags"), F.col("id")),
        functions_calling=indices.inverted(calls, F.col("callee"), F.col("caller_id")),
        types_by_name=indices.inverted(classes, F.col("name"), indices.location(F.col("path"), F.col("line_start"))),
        files_by_category=indices.inverted(parsed.withColumn("_c", patterns.category(F.col("path"), secure)), F.col("_c"), F.col("path")),
        chunks=chunks.chunk_table(parsed.select("path", "lang", "loc"), functions, classes, imports, entry_points),
        metadata=facts.metadata(parsed),
    )


def summary(k: Knowledge) -> DataFrame:
    """One row: totals, naming, structure, features, standard and third-party modules, categories."""
    modules = k.imports.agg(F.array_sort(F.collect_set(F.when(F.col("type") == "stdlib", F.col("module")))).alias("stdlib"), F.array_sort(F.collect_set(F.when(F.col("type") == "external", F.col("module")))).alias("third_party"))
    features = patterns.key_features(k.located.select("docstring")).agg(F.array_sort(F.collect_list("feature")).alias("key_features"))
    categories = k.files_by_category.agg(F.map_from_entries(F.collect_list(F.struct("key", "values"))).alias("categories"))
    out = k.metadata
    for part in (patterns.naming(k.located.select("name")), patterns.structure(k.parsed.select("path")), modules, features, categories):
        out = out.crossJoin(part)
    return out
