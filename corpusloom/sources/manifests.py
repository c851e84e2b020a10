"""External dependencies that a project declares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def declared(files: DataFrame) -> DataFrame:
    """(name, version, source) of manifests (path, content), one row a name: requirements before pyproject."""
    name = F.element_at(F.split("path", "/"), -1)
    line = files.select("path", name.alias("source"), F.explode(F.split("content", "\n")).alias("line")).withColumn("line", F.trim(F.regexp_replace("line", r"#.*$", "")))
    need = r"^([A-Za-z0-9_.\-]+)(?:\[[^\]]*\])?\s*(?:(?:==|>=|~=)\s*([^\s,;]+))?"
    plain = line.where(F.col("source").rlike(r"^requirements.*\.txt$") & F.col("line").rlike(r"^[A-Za-z0-9]")).select(F.regexp_extract("line", need, 1).alias("name"), F.coalesce(F.nullif(F.regexp_extract("line", need, 2), F.lit("")), F.lit("*")).alias("version"), "source", F.lit(0).alias("_o"))
    section = files.where(name == "pyproject.toml").select(F.regexp_extract("content", r"(?s)\[tool\.poetry\.dependencies\]\s*\n(.*?)(?:\n\[|\z)", 1).alias("body"), F.regexp_extract("content", r"(?s)\ndependencies\s*=\s*\[(.*?)\]", 1).alias("listed"))
    pair = r"^\s*([A-Za-z0-9_.\-]+)\s*=\s*[\"']?\^?~?([^\"'\s]*)"
    poetry = section.select(F.explode(F.split("body", "\n")).alias("line")).where(F.col("line").rlike(pair)).select(F.regexp_extract("line", pair, 1).alias("name"), F.regexp_extract("line", pair, 2).alias("version")).where("name <> 'python'")
    listed = section.select(F.explode(F.expr(r"regexp_extract_all(listed, '[\"\']([^\"\']+)[\"\']', 1)")).alias("line")).select(F.regexp_extract("line", need, 1).alias("name"), F.coalesce(F.nullif(F.regexp_extract("line", need, 2), F.lit("")), F.lit("*")).alias("version"))
    toml = poetry.unionByName(listed).select("name", "version", F.lit("pyproject.toml").alias("source"), F.lit(1).alias("_o"))
    return plain.unionByName(toml).where("name <> ''").groupBy("name").agg(F.min(F.struct("_o", "version", "source")).alias("m")).select("name", "m.version", "m.source")
