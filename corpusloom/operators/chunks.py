"""Texts for retrieval, one a function, method, class, file or entry point, made by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import estimated_tokens, truncated
from . import facts

IMPORTANCE = {"entrypoint": 1.0, "class": 0.7, "file": 0.5}


def _block(title: Column, items: Column, most: int | None = None, every: Column | None = None) -> Column:
    """A titled list, at most so many items and how many more there are of ``every`` (all items); '' without items."""
    shown = items if most is None else F.slice(items, 1, most)
    every = F.size(items) if every is None else every
    body = F.concat(title, F.lit("\n"), F.array_join(shown, "\n"), F.lit("\n"))
    if most is not None:
        body = F.concat(body, F.when(every > most, F.concat(F.lit("  ... and "), (every - most).cast("string"), F.lit(" more\n"))).otherwise(""))
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.concat(body, F.lit("\n"))).otherwise("")


def _item(*parts: Column | str) -> Column:
    return F.concat(F.lit("  - "), *(F.lit(p) if isinstance(p, str) else p for p in parts))


def _line(label: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value, F.lit("\n"))).otherwise("")


def function_text(class_bases: Column | None = None) -> Column:
    """The text of a function row with ``callers`` and ``first_callers``; with ``class_bases`` that of a method, after a head on its class."""
    head = F.concat(_line("// File: ", F.col("path")), _line("// Function: ", F.col("name")), _line("// Description: ", F.col("docstring")), F.lit("// Lines: "), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"), F.lit("\n// Complexity: "), F.col("complexity").cast("string"), F.lit("\n\n"), F.col("signature"), F.lit("\n\n"))
    params = _block(F.lit("Parameters:"), F.transform("params", lambda p: _item(p["name"], ": ", F.coalesce(p["type_annotation"], F.lit("")), " ", F.when(p["default_value"].isNotNull(), F.concat(F.lit("= "), p["default_value"])).otherwise(""))))
    returns = F.when(F.coalesce("return_type", F.lit("")) != "", F.concat(F.lit("Returns: "), "return_type", F.lit("\n\n"))).otherwise("")
    calls = _block(F.lit("Calls:"), F.transform("calls", lambda c: _item(c["callee"], " (line ", c["line"].cast("string"), ")")), 10)
    called = _block(F.lit("Called by:"), F.transform("first_callers", lambda c: _item(c["function"], " in ", c["file"])), 5, F.col("callers"))
    flow = F.when(F.col("control_flow.complexity") > 0, F.concat(F.lit("Control flow: "), F.size("control_flow.branches").cast("string"), F.lit(" branches, "), F.size("control_flow.loops").cast("string"), F.lit(" loops\n"))).otherwise("")
    raised = F.concat(_line("  Raises: ", F.array_join("exceptions.raises", ", ")), _line("  Handles: ", F.array_join("exceptions.handles", ", ")))
    errors = F.when(raised != "", F.concat(F.lit("Exceptions:\n"), raised, F.lit("\n"))).otherwise("")
    text = F.concat(head, params, returns, calls, called, flow, errors)
    if class_bases is None:
        return text
    return F.concat(_line("// File: ", F.col("path")), _line("// Class: ", F.col("class_name")), _line("// Method: ", F.col("name")), _line("// Description: ", F.col("docstring")), F.lit("\n"), _line("// Inherits from: ", F.array_join(class_bases, ", ")), F.lit("\n"), text)


def class_text() -> Column:
    """The text of a class row with ``methods`` (name, is_async)."""
    bases = F.when(F.size("bases") > 0, F.concat(F.lit("Inherits from: "), F.array_join("bases", ", "), F.lit("\n\n"))).otherwise("")
    attributes = _block(F.lit("Attributes:"), F.transform("attributes", lambda a: _item(a["name"], ": ", F.coalesce(a["type_annotation"], F.lit("")))))
    methods = _block(F.concat(F.lit("Methods ("), F.size("methods").cast("string"), F.lit("):")), F.transform("methods", lambda m: _item(m["name"], F.when(m["is_async"], " (async)").otherwise(""))))
    return F.concat(_line("// File: ", F.col("path")), _line("// Class: ", F.col("name")), _line("// Description: ", F.col("docstring")), F.lit("// Lines: "), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"), F.lit("\n\n"), bases, attributes, methods)


def file_text() -> Column:
    """The text of a file row with its imports, and names of functions and classes."""
    imports = _block(F.lit("Imports:"), F.transform("imports", lambda i: _item(i["module"], " (", i["type"], ")")))
    functions = _block(F.concat(F.lit("Functions: "), F.size("functions").cast("string")), F.transform("functions", lambda n: _item(n)), 10)
    classes = _block(F.concat(F.lit("Classes: "), F.size("classes").cast("string")), F.transform("classes", lambda n: _item(n)))
    return F.concat(_line("File: ", F.col("path")), _line("Language: ", F.col("lang")), F.lit("Lines of code: "), F.col("loc").cast("string"), F.lit("\n\n"), imports, functions, classes)


def tags(base: str) -> Column:
    deco = lambda words, tag: F.when(F.exists("decorators", lambda d: d.rlike(words)), F.lit(tag))
    extra = F.array_compact(F.array(F.lit(base), F.when(F.col("is_async"), F.lit("async")), F.when(F.col("complexity") > 10, F.lit("complex")), deco("api|route", "api"), deco("test", "test")))
    return F.array_sort(F.array_distinct(F.concat(extra, F.coalesce("tags", F.array().cast("array<string>")))))


def chunk_table(files: DataFrame, functions: DataFrame, classes: DataFrame, imports: DataFrame, entry_points: DataFrame, most: int = 2000) -> DataFrame:
    """(id, chunk_type, content, file_path, language, line_start, line_end, name, complexity, tags, importance_score, tokens).

    A function that is an entry point has a chunk of that type and no other; ids of several files are kept apart by their file.
    """
    lang = files.select("path", "lang")
    functions = functions.drop("called_by").join(facts.call_counts(functions), "name", "left")
    fn = functions.join(entry_points.select("path", F.col("function").alias("id"), F.lit(True).alias("_entry")).distinct(), ["path", "id"], "left").join(lang, "path", "left")
    common = lambda kind, text, importance, complexity, tag: ["path", "id", F.when(F.col("_entry"), "entrypoint").otherwise(kind).alias("chunk_type") if kind in ("function", "method") else F.lit(kind).alias("chunk_type"), truncated(text, most).alias("content"), F.col("lang").alias("language"), F.col("line_start").cast("int"), F.col("line_end").cast("int"), "name", complexity.cast("int").alias("complexity"), tag.alias("tags"), importance.cast("float").alias("importance_score")]
    score = F.when(F.col("_entry"), 1.0).otherwise(F.col("importance_score"))
    plain = fn.where("kind = 'function'").select(*common("function", function_text(), score, F.col("complexity"), tags("function")))
    bases = classes.groupBy("path", F.col("name").alias("class_name")).agg(F.min_by("bases", F.struct("line_start", "id")).alias("bases"))
    methods = fn.where("kind = 'method'").join(bases, ["path", "class_name"], "left").select(*common("method", function_text(F.coalesce("bases", F.array().cast("array<string>"))), score, F.col("complexity"), tags("method")))
    members = functions.where("kind = 'method'").groupBy("path", F.col("class_name").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_start", "name", "is_async"))), lambda m: F.struct(m["name"].alias("name"), m["is_async"].alias("is_async"))).alias("methods"))
    none = F.array().cast("array<struct<name:string,is_async:boolean>>")
    cls = classes.join(members, ["path", "name"], "left").join(lang, "path", "left").withColumn("methods", F.coalesce("methods", none))
    classes_ = cls.select(*common("class", class_text(), F.lit(IMPORTANCE["class"]), F.lit(0), F.array(F.lit("class"))))
    sorted_names = lambda df, out: df.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_start", "name"))), lambda x: x["name"]).alias(out))
    imported = imports.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("module", "type"))).alias("imports"))
    file_rows = files.join(imported, "path", "left").join(sorted_names(functions.where("kind = 'function'"), "functions"), "path", "left").join(sorted_names(classes, "classes"), "path", "left")
    names = F.array().cast("array<string>")
    file_rows = file_rows.withColumn("imports", F.coalesce("imports", F.array().cast("array<struct<module:string,type:string>>"))).withColumn("functions", F.coalesce("functions", names)).withColumn("classes", F.coalesce("classes", names))
    file_rows = file_rows.withColumn("id", F.concat(F.lit("file:"), "path")).withColumn("name", F.col("path")).withColumn("line_start", F.lit(1)).withColumn("line_end", F.col("loc"))
    whole = file_rows.select(*common("file", file_text(), F.lit(IMPORTANCE["file"]), F.lit(0), F.array(F.lit("file"))))
    return plain.unionByName(methods).unionByName(classes_).unionByName(whole).withColumnRenamed("path", "file_path").withColumn("tokens", estimated_tokens(F.col("content")))


def importance(chunk_type: Column, complexity: Column) -> Column:
    """Importance of a chunk at query time: by its type, a tenth more over complexity 5 and over 10, at most 1."""
    base = F.when(chunk_type == "class", 0.8).when(chunk_type == "function", 0.7).when(chunk_type == "method", 0.6).when(chunk_type == "file", 0.4).otherwise(0.5)
    return F.least(F.lit(1.0), base + F.when(complexity > 5, 0.1).otherwise(0.0) + F.when(complexity > 10, 0.1).otherwise(0.0))


def content_symbols(name: Column, content: Column) -> Column:
    """The name, and the names before ( of the content's list lines."""
    lines = F.filter(F.transform(F.split(content, "\n"), lambda x: F.trim(x)), lambda x: F.startswith(x, F.lit("- ")) & F.contains(x, F.lit("(")))
    found = F.transform(lines, lambda x: F.trim(F.regexp_extract(x, r"^- ([^(]*)\(", 1)))
    return F.array_distinct(F.filter(F.concat(F.array(name), found), lambda x: x != ""))


def tag_index(chunks: DataFrame) -> DataFrame:
    """(tag, ids)."""
    return chunks.select(F.explode("tags").alias("tag"), "id").groupBy("tag").agg(F.array_sort(F.collect_set("id")).alias("ids"))
