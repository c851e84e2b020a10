"""Flat tables of the parsed files, and look-ups in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import callers, first_callers, resolved


def exploded(parsed: DataFrame, column: str) -> DataFrame:
    """One row an element of an array of structs, with its path."""
    return parsed.select("path", F.explode(column).alias("_e")).select("path", "_e.*")


def calls(functions: DataFrame) -> DataFrame:
    """(file, caller, caller_id, callee, line, is_conditional, context, args)."""
    return functions.select(F.col("path").alias("file"), F.col("name").alias("caller"), F.col("id").alias("caller_id"), F.explode("calls").alias("c")).select("file", "caller", "caller_id", "c.callee", "c.line", "c.is_conditional", "c.context", "c.args")


def located(parsed: DataFrame) -> DataFrame:
    """Functions and methods, each call with the file that defines what it calls."""
    return with_places(exploded(parsed, "functions"))


def with_places(found: DataFrame) -> DataFrame:
    """Functions, each call with the file that defines what it calls; they are read three times, and no other column is read than those asked for."""
    where = resolved(calls(found).select("file", "callee").distinct(), found.select("name", F.col("path").alias("file"))).where("defined_in IS NOT NULL")
    places = where.groupBy(F.col("file").alias("path")).agg(F.map_from_entries(F.collect_list(F.struct("callee", "defined_in"))).alias("_where"))
    at = F.transform("calls", lambda c: c.withField("defined_in", F.try_element_at(F.col("_where"), c["callee"])))
    return found.join(places, "path", "left").withColumn("calls", at).drop("_where")


def _sites(functions: DataFrame) -> DataFrame:
    """The calls of names that are defined here."""
    return calls(functions).select("callee", "caller", "file", "line").join(functions.select(F.col("name").alias("callee")).distinct(), "callee", "left_semi")


def called(functions: DataFrame) -> DataFrame:
    """(name, called_by): all callers of each name that is defined, once a name and not once a function of that name."""
    return callers(_sites(functions)).withColumnRenamed("callee", "name")


def call_counts(functions: DataFrame, most: int = 5) -> DataFrame:
    """(name, callers, first_callers): how many call each name that is defined, and the first ``most`` of them."""
    return first_callers(_sites(functions), most).withColumnRenamed("callee", "name")


def with_callers(functions: DataFrame, by_name: DataFrame) -> DataFrame:
    """functions with ``called_by``, the list of their name.  Homonyms share a list, so a table of them is written without it."""
    return functions.join(by_name, "name", "left").withColumn("called_by", F.coalesce("called_by", F.array().cast("array<struct<function:string,file:string,line:int>>")))


def functions(parsed: DataFrame) -> DataFrame:
    """Functions and methods with their callers, and each call with the file that defines what it calls."""
    found = located(parsed)
    return with_callers(found, called(found))


def metadata(parsed: DataFrame) -> DataFrame:
    """One row of totals."""
    kind = lambda k: F.sum(F.size(F.filter("functions", lambda f: f["kind"] == k)))
    return parsed.agg(
        F.count("*").alias("total_files"), F.coalesce(F.sum("loc"), F.lit(0)).alias("total_loc"), F.coalesce(kind("function"), F.lit(0)).alias("total_functions"), F.coalesce(F.sum(F.size("classes")), F.lit(0)).alias("total_classes"),
        F.coalesce(kind("method"), F.lit(0)).alias("total_methods"), F.array_sort(F.collect_set("lang")).alias("languages"), F.count_if(F.col("error").isNotNull()).alias("failed"),
    )


def propagated(functions: DataFrame) -> DataFrame:
    """(path, id, propagates): what called functions raise and this one doesn't handle."""
    called = functions.select("path", "id", F.col("exceptions.handles").alias("h"), F.explode("calls").alias("c")).select("path", "id", "h", F.col("c.callee").alias("name"))
    raised = functions.select("name", F.explode("exceptions.raises").alias("e")).distinct()
    return called.join(raised, "name").where(~F.array_contains("h", F.col("e"))).groupBy("path", "id").agg(F.array_sort(F.collect_set("e")).alias("propagates"))


def by_id(table: DataFrame, key: str) -> DataFrame:
    return table.where(F.col("id") == key).limit(1)


def by_name(functions: DataFrame, name: str) -> DataFrame:
    return functions.where(F.col("name") == name)


def entry_points_by_type(entry_points: DataFrame, kind: str) -> DataFrame:
    return entry_points.where(F.col("entry_type") == kind)


def dependencies_of_file(external: DataFrame, path: str) -> DataFrame:
    return external.where(F.array_contains("used_by", path))


def calls_from(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("src") == node)


def calls_to(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("dst") == node)


def entry_point_functions(functions: DataFrame, entry_points: DataFrame) -> DataFrame:
    return functions.join(entry_points.select("path", F.col("function").alias("id")), ["path", "id"], "left_semi")
