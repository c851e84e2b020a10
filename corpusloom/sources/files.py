"""Source trees as tables: which files, in what language, and what the parsers find in them."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import count_lines
from ..schema import PARSED, parsed_schema

LANGUAGES = {
    "Python": "py pyw pyi", "JavaScript": "js jsx mjs cjs", "TypeScript": "ts tsx", "Go": "go", "Rust": "rs", "C": "c h", "C++": "cpp cc cxx hpp hxx", "Java": "java",
}
FILENAMES = {"makefile": "C", "go.mod": "Go", "go.sum": "Go", "cargo.toml": "Rust", "cargo.lock": "Rust"}
#: Folders that are never read.
IGNORED = sorted(set("node_modules __pycache__ .git .svn .hg .venv venv env .env target build dist .idea .vscode .pytest_cache .mypy_cache vendor .tox".split()))
#: Ordered signs of a language in the first 50 lines: a text that the line holds, and a pattern at its start.  Repeats give nothing
#: back (``++``), and one that may run over a long line is tried only where the text is.
CONTENT = [
    ("Python", "", r"^\s*+(def \w++\(|from [\w.]++ import |import \w++$)"), ("TypeScript", "", r"^\s*+(interface \w++ \{|export type )"), ("TypeScript", ": ", r"^\s*+\w++: (string|number)\b"), ("JavaScript", "", r"^\s*+(const |let |var |function\b)"), ("JavaScript", "=>", ""),
    ("Go", "", r"^(package \w|func )"), ("Rust", "", r"^\s*+(fn |impl |use std::|pub fn )"), ("C", "", r"^\s*+(#include|int main\()"),
]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language(path: Column, content: Column) -> Column:
    """By extension, then file name, then the first line, then signs in the first 50 lines; null if none tells."""
    known = lambda names, key: F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), key)
    by_extension = known({end: lang for lang, ends in LANGUAGES.items() for end in ends.split()}, extension(path))
    by_name = known(FILENAMES, F.lower(F.element_at(F.split(path, "/"), -1)))
    first = F.lower(F.substring_index(content, "\n", 1))
    by_first = F.when(F.startswith(content, F.lit("#!")), F.when(F.contains(first, F.lit("python")), "Python").when(first.rlike("node|js"), "JavaScript"))
    # One walk over the lines: each gives the place of the first sign that it has, the least place of all lines tells.
    head = F.slice(F.split(content, "\n", 51), 1, 50)

    def place(line: Column) -> Column:
        out = F
        for i, (_, held, start) in enumerate(CONTENT):
            signs = [F.contains(line, F.lit(held))] * bool(held) + [line.rlike(start)] * bool(start)
            out = out.when(functools.reduce(Column.__and__, signs), i)
        return out

    by_content = F.get(F.array(*(F.lit(lang) for lang, *_ in CONTENT)), F.array_min(F.transform(head, place)))
    return F.coalesce(by_extension, by_name, by_first, by_content)


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last pattern that matches a path ignores it: ``!`` takes back, ``/`` first ties it to the root, ``/`` last means a folder.

    A pattern that isn't tied matches any component, or the path's end; ``*`` and ``?`` in it stand for any characters and for
    one, but no ``/``.
    """
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    verdict = F.lit(False)
    for pattern in patterns:
        p = pattern.strip()
        if not p or p.startswith("#"):
            continue
        take_back, p = p.startswith("!"), p.lstrip("!")
        tied, folder, p = p.startswith("/"), p.endswith("/"), p.strip("/")
        if "*" in p or "?" in p:
            body = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in p)
            hit = path.rlike(("^" if tied else "(^|/)") + body + ("/" if folder else "(/|$)"))
        elif tied:
            hit = F.startswith(path, F.lit(p + "/")) if folder else (path == p) | F.startswith(path, F.lit(p + "/"))
        elif "/" in p:
            hit = F.contains(F.concat(F.lit("/"), path), F.lit(f"/{p}/")) if folder else F.endswith(F.concat(F.lit("/"), path), F.lit("/" + p)) | F.contains(F.concat(F.lit("/"), path), F.lit(f"/{p}/"))
        else:
            hit = F.array_contains(folders if folder else parts, p)
        verdict = F.when(hit, not take_back).otherwise(verdict)
    return verdict


def read_tree(spark: SparkSession, root: str, languages: list[str] | None = None, ignore: list[str] | None = None, ignore_file: str | None = None) -> DataFrame:
    """(path, content, lang, loc, error) of the sources under ``root``, by path from there.

    Empty files (Spark's file source gives no rows for them), hidden files and the folders of IGNORED are left out, and what
    ``ignore`` and the tree's ignore file say.  A file with a known name or extension that isn't UTF-8 is a row with an
    ``error`` and null content.  The file source prunes nothing but names, so the conditions on the path come before the
    content is looked at.
    """
    root = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    bare = root.split("://")[-1].removeprefix("file:")
    path = F.regexp_replace(F.col("path"), "^.*?" + "\\Q" + bare + "\\E/", "")
    known = files.select(path.alias("path"), F.col("content"))
    rules = list(ignore or [])
    if ignore_file:
        rules += [r["value"] for r in spark.read.text(ignore_file).collect()]
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda x: F.startswith(x, F.lit(".")) | x.isin(IGNORED) | F.endswith(x, F.lit(".egg-info")))
    ends = [e for lang, e in LANGUAGES.items() if languages is None or lang in languages]
    kept = known.where(~hidden & ~ignored(F.col("path"), rules))
    text = kept.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("content"))
    found = text.withColumn("lang", language(F.col("path"), F.coalesce("content", F.lit("")))).where("lang IS NOT NULL").withColumn("error", F.when(F.col("content").isNull(), "not UTF-8"))
    if languages is not None and ends:
        found = found.where(F.col("lang").isin(languages))
    return found.select("path", "content", "lang", F.coalesce(count_lines(F.col("content")).cast("long"), F.lit(0)).alias("loc"), "error")


def parse_text(lang: str, content: str) -> dict:
    """The record of one file; a language without a parser has only marks and an error that says so, and null content (no UTF-8) an error alone."""
    from . import parse_braces, parse_common, parse_python

    none = {"imports": [], "functions": [], "classes": [], "global_vars": []}
    if content is None:
        return none | {"error": "not UTF-8", "todos": [], "security_notes": []}
    parser = {"Python": parse_python.parse, "Go": parse_braces.parse_go, "C": parse_braces.parse_c}.get(lang)
    try:
        out = parser(content) if parser else {"error": f"no parser for {lang}"}
    except Exception as e:  # a file must not end the run; the error is in its row
        out = {"error": f"{type(e).__name__}: {e}"}
    return none | out | {"todos": parse_common.todos(content), "security_notes": parse_common.security_notes(content, lang)}


def parsed(files: DataFrame) -> DataFrame:
    """PARSED rows of files (path, content, lang, loc): the one step in Python, a file at a time within Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(parsed_schema())

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                rows = batch.slice(start, 64).to_pylist()
                yield pa.RecordBatch.from_pylist([{"path": r["path"], "lang": r["lang"], "loc": r["loc"]} | parse_text(r["lang"], r["content"]) for r in rows], schema)

    return files.select("path", "content", "lang", "loc").mapInArrow(parse, PARSED)


def write_tree(files: DataFrame, root: str) -> None:
    """Writes files (path, content) under ``root``, each task its own; a task that is run again writes the same files."""
    import pyarrow.fs

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = pyarrow.fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                fs.create_dir(f"{inner}/{path}".rpartition("/")[0], recursive=True)
                with fs.open_output_stream(f"{inner}/{path}", compression=None) as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(write, "n long").agg(F.sum("n")).collect()
