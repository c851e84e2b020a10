"""Documents from other programs, and vectors from models."""

import json

import numpy as np

from corpusloom.operators import embed
from corpusloom.plans import analyze
from corpusloom.sources import kb_json

NONE = {"params": [], "return_type": "", "docstring": "", "called_by": [], "variables": [], "control_flow": {"complexity": 1, "branches": [], "loops": [], "try_blocks": []}, "exceptions": {"raises": [], "propagates": [], "handles": []}, "complexity": 1, "is_async": False, "decorators": [], "tags": [], "importance_score": 0.5}


def function(name, line, calls=(), of=None):
    return NONE | {"id": f"method_{of}_{name}" if of else f"func_{name}", "name": name, "signature": f"def {name}()", "line_start": line, "line_end": line + 1, "calls": [{"callee": c, "defined_in": None, "line": line, "args": [], "is_conditional": False, "context": "unconditional"} for c in calls]}


def test_knowledge_document(spark, tmp_path):
    file = lambda **k: {"language": "python", "loc": 3, "imports": [{"module": "os", "items": [], "type": "stdlib"}], "functions": [], "classes": [], "global_vars": [], "todos": [], "security_notes": []} | k
    cls = {"id": "class_A", "name": "A", "bases": ["B"], "docstring": "", "line_start": 1, "line_end": 9, "attributes": [], "decorators": [], "methods": [function("m", 2, ["f"], "A")]}
    doc = {"metadata": {"project_name": "p"}, "structure": {"a.py": file(functions=[function("f", 1, ["g"]), function("main", 5, ["f"])], classes=[cls]), "b.py": file(functions=[function("g", 1)])}, "call_graph": {"nodes": [], "edges": [{"from": "func_f", "to": "g", "type": "calls", "conditional": False, "call_site_line": 1}]}}
    (tmp_path / "kb.json").write_text(json.dumps(doc, indent=1))
    parsed = kb_json.read_knowledge(spark, str(tmp_path / "kb.json"))
    from corpusloom.operators import facts

    k = analyze.tables(parsed.select("path", "lang", "loc"), parsed, facts.functions(parsed))
    assert {(r["kind"], r["id"], r["class_name"]) for r in k.functions.collect()} == {("function", "func_f", None), ("function", "func_main", None), ("function", "func_g", None), ("method", "method_A_m", "A")}
    assert {r["key"]: r["values"] for r in k.functions_calling.collect()} == {"g": ["func_f"], "f": ["func_main", "method_A_m"]}
    assert [tuple(r) for r in kb_json.read_edges(spark, str(tmp_path / "kb.json")).collect()] == [("func_f", "g", "calls", False, 1)]


def test_index_and_embeddings(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"functions_by_name": {"f": ["a.py:1"]}, "types_by_name": {}}, indent=1))
    assert [tuple(r) for r in kb_json.read_index(spark, str(tmp_path / "i.json"), "functions_by_name").collect()] == [("f", ["a.py:1"])]
    (tmp_path / "e.json").write_text(json.dumps({"model": "m", "dimension": 2, "total_chunks": 1, "embeddings": [{"id": "x", "chunk_type": "Function", "content": "c", "embedding": [1.0, 0.5], "metadata": {"file_path": "a.py", "language": "python", "line_start": 1, "line_end": 2, "name": "f", "complexity": 3}}]}))
    row = kb_json.read_embeddings(spark, str(tmp_path / "e.json")).first()
    assert (row["id"], row["chunk_type"], row["embedding"], row["file_path"], row["model"]) == ("x", "function", [1.0, 0.5], "a.py", "m")


def test_embedding(spark):
    states = np.array([[[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]], [[1.0, 1.0]] * 3])
    mask = np.array([[1, 1, 0], [0, 0, 0]])
    assert np.allclose(embed.mean_pooled(states, mask), [[0.6, 0.8], [0, 0]])
    df = spark.createDataFrame([(i, "x" * i if i % 3 else None) for i in range(150)], "id long, content string")
    encoder = lambda: lambda texts: np.array([[len(t), 1.0] for t in texts], np.float32)
    got = {r["id"]: r["embedding"] for r in embed.embedded(df, encoder).collect()}
    assert got == {i: [float(i if i % 3 else 0), 1.0] for i in range(150)}
    assert embed.embed_query("abc", encoder) == [3.0, 1.0]
    assert len(embed.without_model(df, 8).first()["embedding"]) == 8
