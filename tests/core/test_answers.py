"""Answers from vectors, the knowledge tables and the cache, on a small tree; searches whose way depends on size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import cache, fuzzy, graph, retrieve, search
from corpusloom.plans import analyze as A
from corpusloom.plans import router
from corpusloom.sources import files as S
from corpusloom.sources import parse_braces

TREE = {"a.py": "def load(x):\n    return parse(x)\n\n\ndef parse(x):\n    return x\n", "b.py": "def zebra():\n    return 1\n\n\ndef start():\n    return zebra()\n"}


@pytest.fixture(scope="module")
def known(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        (root / name).write_text(text)
    out = tmp_path_factory.mktemp("kb")
    A.analyze(spark, str(root), out=str(out / "work")).write(str(out / "tables"))
    return A.load(spark, str(out / "tables"))


def test_similar_chunks_and_the_cache(spark, known):
    """A chunk that no word leads to is in the context for its vector alone; a second run is answered from the cache."""
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    vectors = known.chunks.select(F.col("file_path").alias("file"), "id", F.when(F.col("name") == "zebra", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("embedding"))
    embed = lambda q: q.select("query_id", F.array(F.lit(0.9), F.lit(0.1)).alias("query"))
    asked = spark.createDataFrame([(1, "Explain the striped animal"), (2, "where is load ?")], "query_id long, question string")
    empty = spark.createDataFrame([], "query_hash string, query string, response string, checksum_hash string, created_at timestamp, expires_at timestamp")
    answers, new = router.answered(asked, known, empty, F.lit("k"), now, {"location": 1, "": 48}, vectors=vectors, embed=embed)
    got = {r["query_id"]: r for r in answers.collect()}
    assert "def zebra()" in got[1]["answer"] and "def load(x)" not in got[1]["answer"] and not got[1]["cached"]
    assert got[2]["answer"] == "Function load is at a.py:1"
    kept = spark.createDataFrame(new.collect(), empty.schema)
    again = {r["query_id"]: (r["answer"], r["cached"]) for r in router.answered(asked, known, kept, F.lit("k"), F.lit("2024-01-01 00:30:00").cast("timestamp"))[0].collect()}
    assert again == {i: (got[i]["answer"], True) for i in got}
    assert cache.hits(asked.withColumnRenamed("question", "query"), kept, F.lit("k"), F.lit("2024-01-01 02:00:00").cast("timestamp")).where("response IS NOT NULL").count() == 1


def test_facts_of_an_architecture(spark, known):
    calls = F.array(F.struct(F.lit("f").alias("callee"), F.lit("b.py").alias("defined_in")))

    class K:
        functions = known.functions.withColumn("calls", calls).where("path = 'a.py'")
        classes = known.classes

    asked = spark.createDataFrame([(1, "architecture", [], "")], "query_id long, type string, symbols array<string>, entity string")
    assert [tuple(r) for r in router.facts_of(asked, K).collect()] == [(1, "Calls between files: a.py to b.py (2)")]


def test_vector_search_is_the_same_on_both_ways(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(i, r.integers(-3, 4, 5).astype(float).tolist() if i % 17 else None, i % 3) for i in range(300)] + [(300, [0.0] * 5, 1), (301, [0.0] * 5, 1)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, label int")
    queries = df.where("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    got = []
    for most, block in ((10_000, 1024), (0, 1024), (0, 7), (10_000, 7)):
        monkeypatch.setattr(search, "BROADCAST_QUERIES", most)
        monkeypatch.setattr(search, "BLOCK", block)
        for options in ({}, {"where": F.col("label") == 1}, {"threshold": 0.5}):
            found = search.top_k_each(df, queries, 4, **options)
            assert found.columns == ["query_id", "id", "score", "rank"]
            got.append(sorted((a, b, round(s, 9), k) for a, b, s, k in (tuple(x) for x in found.collect())))
    assert got[:3] == got[3:6] == got[6:9] == got[9:] and len(got[0]) == 4 * queries.where("query IS NOT NULL").count()
    assert all(s >= 0.5 for _, _, s, _ in got[2])
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    want = [(q, *x) for q, v, _ in rows if q % 5 == 0 and v for x in [(i, round(float(unit(v) @ unit(w)), 9), k + 1) for k, (_, i, w) in enumerate(sorted((-round(float(unit(v) @ unit(w)), 10), i, w) for i, w, _ in rows if w)[:4])]]
    assert sorted((a, b, s, k) for a, b, s, k in want) == got[0]


def test_fuzzy_search_is_the_same_on_both_ways(spark, monkeypatch):
    from corpusloom.functions import text as T

    names = spark.createDataFrame([(x,) for x in ("load_all", "load", "parse", "parser", "x", "", "loader", "lo\nad", None, "straße")], "name string")
    asked = spark.createDataFrame([(1, "load"), (2, "pars"), (3, ""), (4, None), (5, "strasse"), (6, "zzz")], "query_id long, name string")
    pairs = names.where("name IS NOT NULL").select(F.col("name").alias("t")).crossJoin(asked.where("name IS NOT NULL")).withColumn("score", T.fuzzy_score(F.col("name"), F.col("t"))).where("score > 0").collect()
    want = {(r["query_id"], r["t"], r["score"]) for r in pairs if sum(o["query_id"] == r["query_id"] and (-o["score"], o["t"]) < (-r["score"], r["t"]) for o in pairs) < 3}
    for most in (20_000, 0):
        monkeypatch.setattr(fuzzy, "BROADCAST_QUERIES", most)
        assert {tuple(r)[:3] for r in fuzzy.most_like(names, asked, 3).collect()} == want


def test_deep_graphs(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(12)], "src string, dst string")
    roots = spark.createDataFrame([("0",)], "id string")
    assert graph.shortest_depths(edges, roots).agg(F.max("depth")).first()[0] == 12
    with pytest.raises(ValueError):
        graph.shortest_depths(edges, roots, most=3)


def test_files_that_are_not_text(spark, tmp_path):
    (tmp_path / "bad.py").write_bytes(b"x = '\xff\xfe'\n")
    (tmp_path / "good.py").write_text("x = 1\n")
    found = {r["path"]: r for r in S.read_tree(spark, str(tmp_path)).collect()}
    assert (found["bad.py"]["error"], found["bad.py"]["content"], found["good.py"]["error"]) == ("not UTF-8", None, None)
    parsed = {r["path"]: r["error"] for r in S.parsed(S.read_tree(spark, str(tmp_path))).collect()}
    assert parsed == {"bad.py": "not UTF-8", "good.py": None}


def test_loops_of_c():
    source = "int f(int n) {\n  do {\n    do step(n); while (n > 5);\n    while (n) n--;\n  } while (n > 0);\n  return n;\n}\n"
    f = parse_braces.parse_c(source)["functions"][0]
    assert [(x["loop_type"], x["line"], x["condition"]) for x in f["control_flow"]["loops"]] == [("do-while", 2, "n > 0"), ("do-while", 3, "n > 5"), ("while", 4, "n")]
    assert f["complexity"] == 4


def test_selection_and_window(spark):
    """The budget's fold and the window over related chunks, by hand."""
    chunk = "query_id long, id string, file string, start_line int, end_line int, content string, tokens long, score double"
    rows = [(1, "a", "f", 1, 10, "A", 100, 9.0), (1, "b", "f", 12, 20, "B", 50, 8.0), (1, "c", "g", 1, 5, "C", 70, 7.0), (1, "d", "g", 90, 95, "D", 500, 6.0), (1, "e", "g", 96, 99, "E", 1, 5.0)]
    limits = spark.createDataFrame([(1, 300)], "query_id long, budget long")
    picked = retrieve.select_chunks(spark.createDataFrame(rows, chunk), limits)
    assert [(r["ids"], r["content"], r["used"]) for r in picked.orderBy("used").collect()] == [(["a", "b"], "A\nB", 170), (["c"], "C", 260)]
    assert tuple(retrieve.assembled(picked).first()) == (1, 150 + 20 + 70 + 20, ["f", "g"])
    order = spark.createDataFrame([(1, 0, "a", 40), (1, 1, "b", 30), (1, 2, "c", 50)], "query_id long, position int, id string, tokens long")
    related = spark.createDataFrame([("a", "b", 30), ("a", "x", 20), ("b", "y", 5)], "id string, other string, tokens long")
    assert [(r["id"], r["used"]) for r in retrieve.context_window(order, related, 100).orderBy("used").collect()] == [("a", 40), ("b", 70), ("x", 90)]
