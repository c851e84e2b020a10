"""Scans of lines against tables of patterns, and what paths and names tell of a project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def lines(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, line, text): the lines of each file, from 1; only the two columns are read."""
    body = F.regexp_replace(F.col(content), r"\n\z", "")
    return files.where(F.col(content) != "").select(key, F.posexplode(F.split(body, "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def todos(files: DataFrame, key: str = "path", content: str = "content", pattern: str = T.TODO) -> DataFrame:
    """(key, line, text, priority) of lines with a mark of work left."""
    found = lines(files, key, content).where(F.col("text").rlike(pattern))
    return found.select(key, "line", F.trim(F.regexp_extract("text", pattern, 2)).alias("text"), T.todo_priority(F.col("text")).alias("priority"))


def pattern_notes(files: DataFrame, patterns: list[tuple[str, str]], key: str = "path", content: str = "content", ignore_case: bool = True) -> DataFrame:
    """(key, line, note_type, description): one row for each line and pattern that it matches.

    The few patterns become an array of expressions on the line, so no join of lines with patterns is made.
    """
    hits = F.array_compact(F.array(*(F.when(F.col("text").rlike(("(?i)" if ignore_case else "") + p), F.lit(t)) for t, p in patterns)))
    return lines(files, key, content).select(key, "line", F.explode(hits).alias("note_type"), F.trim("text").alias("description"))


def note_table(files: DataFrame, patterns: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """As ``pattern_notes`` for a table of patterns (note_type, pattern) of any size."""
    return lines(files, key, content).join(patterns, F.expr("text rlike pattern")).select(key, "line", "note_type", F.trim("text").alias("description"))


def category(path: Column, has_security: Column | None = None) -> Column:
    """What a file is for, by its path."""
    p = F.lower(path)
    chain = (
        F.when(p.rlike("test|spec"), "Tests").when(p.rlike("auth|login"), "Authentication").when(p.rlike("api|route|endpoint"), "API")
        .when(p.rlike("util|helper"), "Utilities").when(p.rlike("model|schema"), "Data Models").when(p.rlike("view|component|ui/"), "User Interface")
    )
    return (chain if has_security is None else chain.when(has_security, "Security")).otherwise("Other")


def naming(names: DataFrame) -> DataFrame:
    """One row: how many names are in snake_case and in camelCase, and the more frequent (a tie is camelCase)."""
    snake, camel = F.count_if(F.contains("name", F.lit("_"))), F.count_if(F.col("name").rlike("[a-z][A-Z]"))
    return names.agg(snake.alias("snake"), camel.alias("camel")).withColumn("convention", F.when(F.col("snake") > F.col("camel"), "snake_case").otherwise("camelCase"))


def structure(paths: DataFrame) -> DataFrame:
    """One row: the structure and architecture that the paths show, null where they show none."""
    has = lambda p: F.bool_or(F.lower("path").rlike(p))
    seen = paths.agg(has("/src/").alias("src"), has("/tests?/").alias("tests"), has("controller").alias("c"), has("service").alias("s"), has("repositor|/dal/|/data/").alias("r"), has("model").alias("m"), has("view").alias("v"), F.count_if(F.lower("path").rlike("service")).alias("services"))
    kind = F.when(F.col("c") & F.col("s") & F.col("r"), "layered").when(F.col("m") & F.col("v") & F.col("c"), "mvc").when(F.col("services") > 3, "microservices")
    return seen.select(F.when(F.col("src") & F.col("tests"), "standard").when(F.col("src"), "src-based").otherwise("flat").alias("structure"), kind.alias("architecture"))


def key_features(docstrings: DataFrame, most: int = 10) -> DataFrame:
    """The first sentences of docstrings (docstring) longer than 20 bytes, distinct, the first ``most`` in order."""
    return docstrings.where(F.octet_length("docstring") > 20).select(F.trim(F.split_part("docstring", F.lit("."), F.lit(1))).alias("feature")).where("feature <> ''").distinct().orderBy("feature").limit(most)


def route_path(decorator: Column) -> Column:
    return F.nullif(F.regexp_extract(decorator, r"""['"]([/\w-]+)['"]""", 1), F.lit(""))


def http_methods(decorator: Column) -> Column:
    lower = F.lower(decorator)
    found = F.array_compact(F.array(*(F.when(F.contains(lower, F.lit(m.lower())), F.lit(m)) for m in ("GET", "POST", "PUT", "DELETE"))))
    return F.when(F.size(found) == 0, F.array(F.lit("GET"))).otherwise(found)


def entry_points(functions: DataFrame) -> DataFrame:
    """(entry_type, path, function, handler, line, methods) of functions (path, id, name, line_start, decorators).

    One row for a main, run or start, one for each route decorator, one for a command.
    """
    main = functions.where(F.col("name").isin("main", "run", "start")).select(F.lit("main").alias("entry_type"), F.col("path"), F.col("id").alias("function"), F.lit(None).cast("string").alias("handler"), F.col("line_start").alias("line"), F.array().cast("array<string>").alias("methods"))
    each = functions.select("path", "id", "line_start", "decorators", F.explode("decorators").alias("d")).where(F.lower("d").rlike("route|get|post|api"))
    routes = each.select(F.lit("api_endpoint").alias("entry_type"), "path", F.col("id").alias("function"), route_path(F.col("d")).alias("handler"), F.col("line_start").alias("line"), http_methods(F.col("d")).alias("methods"))
    cli = functions.where(F.exists("decorators", lambda d: F.lower(d).rlike("command|click"))).select(F.lit("cli").alias("entry_type"), "path", F.col("id").alias("function"), F.lit(None).cast("string").alias("handler"), F.col("line_start").alias("line"), F.array().cast("array<string>").alias("methods"))
    return main.unionByName(routes).unionByName(cli)


def web_entry_points(global_vars: DataFrame) -> DataFrame:
    """Globals whose value makes a web application."""
    return global_vars.where(F.lower("value").rlike(r"(flask|fastapi|express)\(")).select(F.lit("web").alias("entry_type"), "path", F.col("name").alias("function"), "line")
