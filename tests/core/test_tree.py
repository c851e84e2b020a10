"""A small tree in three languages, from files to answers."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import checksum, diagnostics, facts, graph, patterns
from corpusloom.plans import analyze as A
from corpusloom.plans import router
from corpusloom.sources import codec, config, manifests
from corpusloom.sources import files as S
from corpusloom.streaming import incremental

APP = '''"""Application."""
import os
import requests
from flask import Flask

app = Flask(__name__)


@app.route("/api/users", methods=["POST"])
async def create_user(name: str, size: int = 3) -> dict:
    """Creates a user and stores it. Nothing else happens."""
    if name:
        data = clean(name)
        saved = store(data)
    elif size > 3 and check(size):
        raise ValueError("size")
    else:
        saved = None
    for i in range(size):
        try:
            notify(i)
        except KeyError:
            log_error(i)
    return saved


class Store(Base):
    """Keeps users."""

    path: str = "x"

    def save(self, user):
        # TODO: urgent, write atomically
        return store(user)


def main():
    create_user("a")
'''
UTIL = '''def clean(text):
    return strip(text)


def strip(text):
    return store(text)


def store(x):
    password = x
    return clean(x)
'''
TREE = {
    "src/app.py": APP, "src/util.py": UTIL, "src/broken.py": "def f(x):\n    return g(x\n", "src/empty.py": "", "other/util.py": "def clean(text):\n    return text",
    "main.go": 'package main\n\nimport "fmt"\n\n// main starts.\nfunc main() {\n\tif ready() {\n\t\tfmt.Println("x(")\n\t}\n}\n', "lib/a.c": '#include <stdio.h>\nint add(int a, int b) { return a + b; }\n',
    "web/x.js": "const x = () => 1\n", "node_modules/y.js": "const y = 1\n", "docs/guide.py": "def hidden():\n    pass\n", ".git/config.py": "a = 1\n", "requirements.txt": "flask==2.0\nrequests[socks] >= 1.5 # note\nplain\n", "pyproject.toml": '[project]\ndependencies = ["numpy>=1.2", "flask==3"]\n\n[tool.poetry.dependencies]\npython = "^3"\nrich = "^13.0"\n',
    "LICENSE": "free\n", "run": "#!/usr/bin/env python3\nprint(1)\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    out = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        (out / name).parent.mkdir(parents=True, exist_ok=True)
        (out / name).write_text(text)
    (out / "rules.txt").write_text("# rules\ndocs/\n")
    return out


@pytest.fixture(scope="module")
def known(spark, root, tmp_path_factory):
    out = tmp_path_factory.mktemp("kb")
    A.analyze(spark, str(root), out=str(out / "work"), ignore_file=str(root / "rules.txt")).write(str(out / "tables"))
    return A.load(spark, str(out / "tables"))


def test_files(spark, root):
    got = {r["path"]: (r["lang"], r["loc"]) for r in S.read_tree(spark, str(root), ignore=["docs/"]).collect()}
    assert got["src/app.py"] == ("Python", APP.count("\n")) and "src/empty.py" not in got and got["other/util.py"] == ("Python", 2)
    assert got["run"][0] == "Python" and got["lib/a.c"][0] == "C" and got["web/x.js"][0] == "JavaScript"
    assert not {"node_modules/y.js", "docs/guide.py", ".git/config.py", "LICENSE"} & set(got)
    assert {r["lang"] for r in S.read_tree(spark, str(root), ["Go"]).collect()} == {"Go"}


def test_language(spark):
    rows = [("a.PY", ""), ("b.ts", ""), ("c.rs", ""), ("Makefile", ""), ("x/go.mod", ""), ("s", "#!/usr/bin/env node\n"), ("t", "def hello():\n    print('world')"), ("u", "const hello = () => {}"), ("v", "package main\nfunc main() {}"), ("w", "just words")]
    df = spark.createDataFrame(rows, "path string, content string")
    got = [r[0] for r in df.select(S.language(F.col("path"), F.col("content"))).collect()]
    assert got == ["Python", "TypeScript", "Rust", "C", "Go", "JavaScript", "Python", "JavaScript", "Go", None]


def test_language_by_lines(spark):
    """The first sign in the order of languages counts, not of lines; signs are tied to a line's start, CR and 50 lines included."""
    long = "x" * 4000
    cases = [
        ("a => b\nimport os\r\n", "Python"), ("func f\n  let x", "JavaScript"), ("  key: string", "TypeScript"), ("a b: string", None), (f"{long}: number", "TypeScript"), (f"{long}: numbers", None), ("import os x", None), ("\t\tdef f(", "Python"),
        ("x\n" * 49 + "fn x", "Rust"), ("x\n" * 50 + "fn x", None), (" package a", None), ("package ", None), ("#!/bin/sh\nint main(", "C"), ("#!/usr/bin/Python", "Python"), ("\n#!python", None), ("", None), (None, None),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c string")
    assert [r["l"] for r in df.select("i", S.language(F.lit("u"), F.col("c")).alias("l")).orderBy("i").collect()] == [want for _, want in cases]


def test_language_of_long_lines_is_bounded():
    """No sign runs over a line that lacks its text: each pattern without one begins with fixed words, none gives anything back."""
    for _, held, start in S.CONTENT:
        assert not re.search(r"\\w[+*](?!\+)", start) and (held or not start.startswith(r"^\s*+\w"))


def test_callers_are_stored_once_a_name(spark):
    """Forty files define and call one name: 40 callers in one row, not in each of 40; the first five and their number are as in the whole list."""
    files = spark.createDataFrame([(f"f{i:02}.py", f"def save():\n    pass\n\n\ndef main():\n    save()\n    only_{i % 3}()\n", "Python", 7) for i in range(40)], "path string, content string, lang string, loc long")
    parsed = S.parsed(files).localCheckpoint()
    k = A.tables(files.select("path", "lang", "loc"), parsed, facts.located(parsed))
    assert "called_by" not in k.located.columns
    assert [(r["name"], len(r["called_by"])) for r in k.callers.collect()] == [("save", 40)]
    assert {(r["name"], len(r["called_by"])) for r in k.functions.collect()} == {("save", 40), ("main", 0)} and k.functions.count() == 80
    counts = facts.call_counts(k.located).collect()
    assert [(r["name"], r["callers"], r["first_callers"]) for r in counts] == [("save", 40, k.callers.first()["called_by"][:5])]
    text = k.chunks.where("name = 'save'").first()["content"]
    assert "Called by:\n  - main in f00.py\n  - main in f01.py\n" in text and "  ... and 35 more\n" in text


def test_pairs_of_a_hot_name_are_dealt_out(spark):
    """Two hundred calls, one of them twice, of a name with 200 definitions: all pairs, on many tasks; null names and other names make none."""
    left = spark.createDataFrame([("save", f"a{i}") for i in range(200)] + [("save", "a0"), (None, "x"), ("other", "y")], "name string, src string")
    right = spark.createDataFrame([("save", f"b{i}") for i in range(200)] + [(None, "z")], "name string, dst string")
    found = graph.paired(left, right)
    assert found.count() == 201 * 200 and found.distinct().count() == 200 * 200
    assert found.select(F.spark_partition_id()).distinct().count() > 16


def test_ignore_rules(spark):
    cases = [("docs/a.py", ["docs/"], True), ("x/docs/a.py", ["docs/"], True), ("x/docs/a.py", ["/docs/"], False), ("a/b.py", ["b.py"], True), ("a/b.py", ["b.py", "!b.py"], False), ("a/b.py", ["!b.py", "b.py"], True), ("docs", ["docs/"], False), ("a/x/y.py", ["x/y.py"], True), ("a.py", ["", "# a.py"], False)]
    for path, rules, want in cases:
        assert spark.range(1).select(S.ignored(F.lit(path), rules)).first()[0] is want, (path, rules)


def test_functions(known):
    fn = {(r["path"], r["id"]): r for r in known.functions.collect()}
    f = fn["src/app.py", "func_create_user"]
    assert f["is_async"] and f["signature"] == "async def create_user(name: str, size: int = 3) -> dict" and f["complexity"] == 6
    assert [(c["callee"], c["context"], c["defined_in"]) for c in f["calls"]] == [("clean", "if", "other/util.py"), ("store", "if", "src/util.py"), ("check", "elif", None), ("ValueError", "elif", None), ("range", "loop", None), ("notify", "try", None), ("log_error", "except", None)]
    assert f["exceptions"]["raises"] == ["ValueError"] and f["exceptions"]["handles"] == ["KeyError"]
    assert [v["name"] for v in f["variables"]] == ["name", "size", "data", "saved"] and f["variables"][3]["returned"]
    assert [(t["via"], t["becomes"]) for t in f["variables"][0]["transformations"]] == [("clean", "data")]
    assert [(c["function"], c["file"]) for c in f["called_by"]] == [("main", "src/app.py")]
    assert [c["function"] for c in fn["src/util.py", "func_store"]["called_by"]] == ["create_user", "save", "strip"]
    assert fn["src/broken.py", "func_f"]["calls"][0]["callee"] == "g" and ("main.go", "func_main") in fn and ("lib/a.c", "func_add") in fn
    assert fn["src/app.py", "method_Store_save"]["class_name"] == "Store"


def test_facts(known):
    assert {(r["path"], r["priority"]) for r in known.todos.collect()} == {("src/app.py", "high")}
    assert ("src/util.py", "password_handling") in {(r["path"], r["note_type"]) for r in known.security_notes.collect()}
    points = {(r["entry_type"], r["function"], r["handler"]) for r in known.entry_points.collect()}
    assert {("main", "func_main", None), ("api_endpoint", "func_create_user", "/api/users")} <= points
    assert [r["methods"] for r in known.entry_points.where("entry_type = 'api_endpoint'").collect()] == [["POST"]]
    assert {r["name"]: r["used_by"] for r in known.external_dependencies.collect()} == {"requests": ["src/app.py"], "flask": ["src/app.py"]}
    meta = known.metadata.first()
    assert meta["total_methods"] == 1 and meta["total_classes"] == 1 and meta["languages"] == ["C", "Go", "JavaScript", "Python"]
    assert {r["path"] for r in known.parsed.where("error IS NOT NULL").collect()} == {"src/broken.py", "web/x.js"}
    assert {r["function"] for r in patterns.web_entry_points(known.global_vars).collect()} == {"app"}
    assert {(r["id"], tuple(r["propagates"])) for r in facts.propagated(known.functions).collect()} == {("func_main", ("ValueError",))}
    assert diagnostics.run_report(known.parsed).where("lang = 'Python'").first()["failed"] == 1


def test_indices_and_graph(known):
    names = {r["key"]: r["values"] for r in known.functions_by_name.collect()}
    assert names["clean"] == ["other/util.py:1", "src/util.py:1"]
    assert {r["key"]: r["values"] for r in known.functions_calling.collect()}["store"] == ["func_create_user", "func_strip", "method_Store_save"]
    assert known.types_by_name.first()["values"] == ["src/app.py:27"]
    nodes = {r["id"]: r for r in known.nodes.collect()}
    assert nodes["func_main"]["is_entry_point"] and nodes["func_store"]["call_count_estimate"] == 3
    edges = known.edges.where("dst IS NOT NULL")
    roots = known.nodes.where("is_entry_point")
    deep = {r["id"]: r["depth"] for r in graph.shortest_depths(edges, roots).collect()}
    assert deep["func_create_user"] == 0 and deep["func_store"] == 1 and "method_Store_save" not in deep
    assert known.edges.where("edge_type = 'inherits'").first()["dst_name"] == "Base"
    assert graph.summary(known.nodes, known.edges).first()["entry_points"] == 2
    nodes, edges = graph.dependency_graph(known.functions, known.classes, known.calls)
    assert {("class_Store", "method_Store_save")} == {(r["src"], r["dst"]) for r in edges.where("edge_type = 'contains'").collect()}


def test_chunks(known):
    chunks = {(r["file_path"], r["id"]): r for r in known.chunks.collect()}
    c = chunks["src/app.py", "func_create_user"]
    assert c["chunk_type"] == "entrypoint" and c["importance_score"] == 1.0 and "async" in c["tags"] and "api" in c["tags"]
    assert "  - clean (line 13)\n" in c["content"] and "Control flow: 2 branches, 1 loops" in c["content"] and "  Raises: ValueError\n" in c["content"] and "  - size: int = 3\n" in c["content"]
    assert "Called by:\n  - main in src/app.py\n" in c["content"]
    m = chunks["src/app.py", "method_Store_save"]
    assert m["content"].startswith("// File: src/app.py\n// Class: Store\n// Method: save\n") and "// Inherits from: Base\n" in m["content"]
    assert "Methods (1):\n  - save\n" in chunks["src/app.py", "class_Store"]["content"]
    f = chunks["src/app.py", "file:src/app.py"]
    assert "  - flask (external)\n" in f["content"] and "Functions: 2\n  - create_user\n  - main\n" in f["content"]
    assert len(chunks) == known.chunks.count()


def test_written(spark, root, known, tmp_path):
    lazy = A.analyze(spark, str(root), ignore_file=str(root / "rules.txt"))
    assert {r["id"] for r in lazy.functions.collect()} == {r["id"] for r in known.functions.collect()}
    known.write_json(str(tmp_path / "json"), ("metadata",))
    assert spark.read.json(str(tmp_path / "json/metadata")).first()["total_files"] == known.metadata.first()["total_files"]


def test_summary(known):
    s = A.summary(known).first()
    assert s["convention"] == "snake_case" and s["stdlib"] == ["fmt", "os", "stdio.h"] and s["third_party"] == ["flask", "requests"]
    assert "Creates a user and stores it" in s["key_features"] and "src/util.py" in s["categories"]["Utilities"]


def test_answers(spark, known):
    asked = [(1, "where is create_user ?"), (2, "Who calls store?"), (3, "What does main depends on"), (4, "Explain how create_user stores data"), (5, "where is the function creat_usr"), (6, "compare x"), (7, "where is Store ")]
    got = {r["query_id"]: r for r in router.route(spark.createDataFrame(asked, "query_id long, question string"), known).collect()}
    assert got[1]["answer"] == "Function create_user is at src/app.py:10"
    assert got[7]["answer"] == "Type Store is at src/app.py:27"
    assert "called by func_create_user, func_strip, method_Store_save" in got[2]["answer"]
    assert got[4]["type"] == "documentation" and "func" not in got[4]["type"] and "async def create_user" in got[4]["answer"] and got[4]["answer"].endswith("stores data")
    assert "similar: create_user (function)" in got[5]["answer"]
    assert got[6]["answer"] == "A comparison needs at least two names."
    assert set(got) == {1, 2, 3, 4, 5, 6, 7}


def test_dependencies(spark, known):
    asked = spark.createDataFrame([(1, "main")], "query_id long, entity string")
    answer = router.dependencies(asked, known.edges, known.functions).first()["answer"]
    assert answer.startswith("main depends on func_create_user; through them on func_clean, func_store")


def test_manifests(spark, root):
    files = spark.createDataFrame([(n, t) for n, t in TREE.items() if n.endswith((".txt", ".toml"))], "path string, content string")
    assert {tuple(r) for r in manifests.declared(files).collect()} == {("flask", "2.0", "requirements.txt"), ("requests", "1.5", "requirements.txt"), ("plain", "*", "requirements.txt"), ("numpy", "1.2", "pyproject.toml"), ("rich", "13.0", "pyproject.toml")}


def test_changes(spark):
    state = lambda rows: spark.createDataFrame(rows, "path string, hash string")
    a, b = state([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")]), state([("a", "1"), ("b", "2"), ("e", "1"), ("d", "1")])
    diff = checksum.compared(a, b)
    assert {tuple(r) for r in diff.collect()} == {("a", "same"), ("b", "modified"), ("c", "deleted"), ("d", "same"), ("e", "added")}
    assert checksum.change_share(diff).first()[0] == 0.75
    assert checksum.change_share(checksum.compared(a, a)).first()[0] == 0.0
    assert checksum.change_share(checksum.compared(a.limit(0), b)).first()[0] == 1.0


def test_codec(spark, tmp_path):
    import numpy as np

    v, M = np.arange(6, dtype=np.float32).reshape(2, 3), b"VECS"
    model, again = codec.read_index(codec.index_bytes(v, "módel", M), M)
    assert model == "módel" and (again == v).all()
    old = M + bytes([1, 0, 0, 0, 2, 0, 0, 0, 3, 0, 0, 0]) + v.tobytes()
    assert codec.read_index(old, M)[0] == "" and (codec.read_index(old, M)[1] == v).all()
    for bad in (b"", b"XXXXYYYYZZZZ", codec.index_bytes(v, "m", M)[:-1], codec.index_bytes(v, "m", b"OTHR")):
        with pytest.raises(ValueError):
            codec.read_index(bad, M)
    store = {"a": v[0], "é": v[1]}
    assert {k: x.tolist() for k, x in codec.read_store(codec.store_bytes(store)).items()} == {k: x.tolist() for k, x in store.items()}
    assert codec.read_store(codec.store_bytes({})) == {}
    (tmp_path / "v.bin").write_bytes(codec.index_bytes(v, "m", M))
    assert [tuple(r)[1:] for r in codec.read_indices(spark, str(tmp_path), M).collect()] == [("embedding_0", [0.0, 1.0, 2.0], "m"), ("embedding_1", [3.0, 4.0, 5.0], "m")]


def test_config(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text("[embeddings]\ndimension = 64\n[cache]\ncache_hours = 2\n")
    assert (config.load(str(path)).dimension, config.load(str(path)).cache_hours, config.load().max_tokens) == (64, 2, 8192)
    path.write_text("[x]\nunknown = 1\n")
    with pytest.raises(ValueError):
        config.load(str(path))


def test_stream(spark, tmp_path):
    now = datetime.datetime(2024, 1, 1)
    put = lambda n, rows: spark.createDataFrame(rows, incremental.VERSIONS).coalesce(1).write.parquet(str(tmp_path / "in" / f"v{n}"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    run = lambda: incremental.keep_parsed(spark.readStream.schema(incremental.VERSIONS).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), out, state).awaitTermination(120)
    put(1, [("a.py", "def f():\n    g()\n", "Python", 2, now), ("b.py", "x = 1\n", "Python", 1, now)])
    run()
    put(2, [("a.py", "def f2():\n    g()\n", "Python", 2, now + datetime.timedelta(minutes=1)), ("b.py", "x = 1\n", "Python", 1, now + datetime.timedelta(minutes=1))])
    run()
    got = lambda: {r["path"]: [f["name"] for f in r["functions"]] for r in incremental.current(spark, out).collect()}
    assert got() == {"a.py": ["f2"], "b.py": []}
    assert spark.read.parquet(out).count() == 3
    # Changed back to what it was: a change too; and a late version from before the last one is none.
    put(3, [("a.py", "def f():\n    g()\n", "Python", 2, now + datetime.timedelta(minutes=2))])
    run()
    put(4, [("a.py", "def f9():\n    g()\n", "Python", 2, now + datetime.timedelta(seconds=30))])
    run()
    assert got() == {"a.py": ["f"], "b.py": []} and spark.read.parquet(out).count() == 4


def test_children_of_a_node_are_found_once(monkeypatch):
    import ast

    from corpusloom.sources import parse_python

    seen, source = [], "def f(a):\n    if a or g(a):\n        for i in h(a):\n            k(i)\n    return a\n"
    each = parse_python._children
    monkeypatch.setattr(parse_python, "_children", lambda node: seen.append(id(node)) or each(node))
    found = parse_python.parse(source)["functions"][0]
    assert [c["callee"] for c in found["calls"]] == ["g", "h", "k"] and found["complexity"] == 4
    function = ast.parse(source).body[0]
    assert len(seen) == sum(bool(n._fields) for n in ast.walk(function) if not isinstance(n, ast.boolop))


@pytest.mark.parametrize(("name", "joins"), [("kb_metadata", []), ("kb_external", []), ("kb_entry_points", [0]), ("kb_resolved", [0]), ("kb_nodes", [0, 0]), ("kb_exact", [0, 3])])
def test_queries_write_and_resolve_only_what_they_read(spark, tmp_path, monkeypatch, name, joins):
    from corpusloom import code_queries, queries

    spark.createDataFrame([(k, k % 3) for k in range(1, 9)], "s_suppkey long, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    written, write = [], code_queries._written
    monkeypatch.setattr(code_queries, "_written", lambda df: written.append(df._jdf.queryExecution().analyzed().toString().count("Join ")) or write(df))
    assert queries.QUERIES[name](spark, str(tmp_path)).count() > 0
    assert written == joins


def test_files_of_a_module_are_gathered_once(spark):
    from corpusloom.operators import indices

    imports = spark.createDataFrame([("a", "m", "external"), ("b", "m", "external"), ("b", "m", "external"), (None, "m", "external"), ("c", "os", "stdlib")], "path string, module string, type string")
    found = indices.external_dependencies(imports)
    assert [tuple(r) for r in found.collect()] == [("m", ["a", "b"], 2)]
    assert "distinct" not in found._jdf.queryExecution().analyzed().toString()
