"""Column functions and retrieval operators on literal cases and against plain Python."""

import collections

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import classify as C
from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.operators import cache, chunks, diagnostics, graph, indices, patterns, retrieve, search


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def vec(x):
    return F.array(*(F.lit(float(v)) for v in x)) if x else F.array().cast("array<double>")


def test_vectors(spark):
    assert one(spark, V.cosine(vec([1, 0, 0]), vec([1, 0, 0]))) == pytest.approx(1)
    assert one(spark, V.cosine(vec([1, 0, 0]), vec([0, 1, 0]))) == pytest.approx(0)
    assert one(spark, V.cosine(vec([0, 0]), vec([1, 1]))) == 0 == one(spark, V.cosine(vec([1]), vec([1, 1])))
    assert one(spark, V.normalized(vec([3, 4]))) == [0.6, 0.8] and one(spark, V.normalized(vec([0, 0]))) == [0, 0]
    a, b, c = (one(spark, V.dummy_embedding(F.lit(t))) for t in ("test", "test", "other"))
    assert len(a) == 384 and a == b != c


def test_search(spark):
    rows = [(i, [float(i % 3), float(i % 5), 1.0], f"p/{i % 2}/x", "function" if i % 2 else "class", None if i % 4 else "Python") for i in range(20)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, file_path string, chunk_type string, language string")
    top = search.top_k(df, [1.0, 1.0, 1.0], 3).collect()
    assert [r["id"] for r in top] == [1, 16, 7] or top[0]["score"] >= top[-1]["score"]
    kept = search.top_k(df, [1.0, 0.0, 0.0], 50, where=search.filtered(["class"], ["Python"], ["/0/"])).collect()
    assert {r["id"] for r in kept} == {0, 4, 8, 12, 16}
    assert search.top_k(df.limit(0), [1.0], 5).collect() == []
    queries = df.selectExpr("id AS query_id", "embedding AS query")
    each = lambda: {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 9)) for r in search.top_k_each(df, queries, 4).collect()}
    fast = each()
    old, search.BROADCAST_QUERIES = search.BROADCAST_QUERIES, 3
    try:
        assert each() == fast and len(fast) == 80
    finally:
        search.BROADCAST_QUERIES = old
    assert search.top_k_each(df.limit(0), queries, 4).collect() == [] == search.top_k_each(df, queries.limit(0), 4).collect()
    assert search.compared(df, df.where("id > 0")).first()["only_a"] == 1
    with pytest.raises(Exception, match="vector of 4 numbers expected, found 3"):
        search.checked(df, 4).collect()
    assert [r["value"] for r in diagnostics.embedding_report(df, 20, 3).collect()] == [3.0, 3.0, 20.0, 0.0, 0.0]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text("abAB_", max_size=6), st.text("abAB_", min_size=1, max_size=6)), min_size=1, max_size=12))
def test_names_against_python(spark, pairs):
    def tokens(s):
        out = []
        for part in s.split("_"):
            at = 0
            for i in range(1, len(part) + 1):
                if i == len(part) or part[i].isupper():
                    out += [part[at:i].lower()] if part[at:i] else []
                    at = i
        return out

    def fuzzy(p, t):
        if p == t:
            return 1000
        if p in t:
            return 500
        common = collections.Counter(p) & collections.Counter(t)
        return 10 * sum(a == b for a, b in zip(p, t)) + 2 * sum(common.values()) - abs(len(t) - len(p))

    df = spark.createDataFrame(pairs, "p string, t string").select("p", "t", T.identifier_tokens(F.col("t")).alias("k"), T.fuzzy_score(F.col("p"), F.col("t")).alias("f"))
    for r in df.collect():
        assert r["k"] == tokens(r["t"]) and r["f"] == fuzzy(r["p"], r["t"])


def test_text(spark):
    assert [one(spark, T.count_lines(F.lit(t))) for t in ("", "a", "a\n", "a\nb", "\n", "a\n\n")] == [0, 1, 1, 2, 1, 2]
    assert one(spark, T.truncated(F.lit("x" * 3000))) == "x" * 1997 + "..."
    assert one(spark, T.truncated(F.lit("é" * 50 + "\n" + "x" * 30), 60)) == "é" * 50 + "..."
    assert one(spark, T.truncated(F.lit("short"))) == "short"
    assert one(spark, T.entity_name(F.lit("where is the function do_it now"))) == "do_it" and one(spark, T.entity_name(F.lit("what is"))) == ""
    assert one(spark, T.question_words(F.lit("How does (load_user) work, \"fast\"?"))) == ["load_user", "load", "user", "work", "fast"]
    assert one(spark, T.name_tags(F.lit("load_user_config"))) == ["configuration", "file-io"]


@pytest.mark.parametrize(
    ("question", "kind"),
    [("Why does login crash", "debug"), ("a versus b", "comparison"), ("show me how it runs", "example"), ("trace  data here", "dataflow"), ("is it vulnerable", "security"), ("the latest tests", "testing"), ("optimize it", "performance"), ("simplify it", "refactoring"),
     ("what depends on X", "dependency"), ("describe it", "documentation"), ("where is it", "location"), ("locate foo", "location"), ("who calls it", "usage"), ("high-level view", "architecture"), ("build a thing", "implementation"), ("Foo and Bar together", "understanding"), ("hm", "understanding")],
)
def test_question_types(spark, question, kind):
    assert one(spark, C.classify(F.lit(question)))["answer"]["type"] == kind


def test_names_in_questions(spark):
    assert one(spark, C.symbols(F.lit("Does HttpServer call run_all or MAX_SIZE? HttpServer"))) == ["HttpServer", "call", "run_all", "or", "MAX_SIZE"]
    assert one(spark, C.symbols(F.lit("HttpServer and x"), F.array(F.lit("x")))) == ["x"]
    assert [tuple(e) for e in one(spark, C.entities(F.array(F.lit("A"), F.lit("f"), F.lit("z")), F.array(F.lit("A")), F.array(F.lit("f"), F.lit("A"))))] == [("A", "type"), ("f", "function"), ("z", "unknown")]


def strings(*x):
    return F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")


def test_scores(spark):
    assert one(spark, retrieve.exact_score(F.lit("Run"), strings("Run"), strings("run"))) == 100 and one(spark, retrieve.exact_score(F.lit("Run"), strings("Run"), strings("run"), True)) == 90
    assert one(spark, retrieve.exact_score(F.lit("a"), strings("B"), strings("b"))) == 90 and one(spark, retrieve.exact_score(F.lit("a"), strings(), strings("b"))) == 0
    assert one(spark, retrieve.partial_score(F.lit("load_user"), strings(), strings("load", "user"))) == 30
    assert one(spark, retrieve.partial_score(F.lit("load_user"), strings(), strings("load"))) == 0
    assert one(spark, retrieve.partial_score(F.lit("load_user"), strings("loadAll"), strings("load"))) == 27
    score = lambda *a, **k: one(spark, retrieve.keyword_score(*a, **k))
    assert score(F.lit("load"), strings(), F.lit("text load"), F.lit("load.py"), F.lit("function"), strings("load"), strings("load")) == 20 + 2 + 1 + 1
    assert score(F.lit("x"), strings("loader"), F.lit(""), F.lit(""), F.lit("class"), strings("load"), strings("load")) == pytest.approx(7 + 5 + 0.8)
    assert score(F.lit("x"), strings(), F.lit(""), F.lit(""), F.lit("class"), strings("q"), strings()) == 0
    assert score(F.lit("x"), strings(), F.lit(""), F.lit(""), F.lit("class"), strings("q"), strings(), True) == pytest.approx(0.8)


def test_merge_of_strategies(spark):
    t = lambda *r: spark.createDataFrame([(1, *x) for x in r], "query_id long, id string, score double")
    got = {r["id"]: (round(r["score"], 3), r["match_type"], r["rank"]) for r in retrieve.merged(t(("a", 100.0)), t(("a", 30.0), ("b", 200.0)), t(("a", 5.0), ("b", 3.0), ("c", 4.0)), t(("c", 0.8), ("d", 0.6))).collect()}
    assert got == {"a": (103.5, "exact", 1), "b": (202.0, "partial", 2), "c": (4.4, "keyword", 3), "d": (0.3, "semantic", 4)}
    assert len(retrieve.merged(t(("a", 100.0)), t(("b", 1.0)), t(("c", 1.0)), t(), 2).collect()) == 2


def test_selection_and_merging(spark):
    rows = [(1, "a", "f", 1, 10, "A", 100, 9.0), (1, "b", "f", 14, 20, "B", 100, 8.0), (1, "c", "g", 1, 2, "C", 100, 7.0), (1, "d", "f", 21, 22, "D", 5000, 6.0), (1, "e", "h", 1, 2, "E", 1, 5.0), (2, "x", "f", 1, 2, "X", 50, 1.0)]
    df = spark.createDataFrame(rows, "query_id long, id string, file string, start_line int, end_line int, content string, tokens long, score double")
    limits = spark.createDataFrame([(1, 400), (2, 69)], "query_id long, budget long")
    got = [(r["query_id"], r["ids"], r["start_line"], r["end_line"], r["content"], r["used"]) for r in retrieve.select_chunks(df, limits).orderBy("query_id", "used").collect()]
    assert got == [(1, ["a", "b"], 1, 20, "A\nB", 220), (1, ["c"], 1, 2, "C", 340)]
    total = retrieve.assembled(retrieve.select_chunks(df, limits)).first()
    assert (total["total_tokens"], total["sources"]) == (340, ["f", "g"])


def test_context_window(spark):
    order = spark.createDataFrame([(1, 0, "a", 10), (1, 1, "b", 10), (1, 2, "c", 100)], "query_id long, position int, id string, tokens long")
    near = spark.createDataFrame([("a", "b", 10), ("a", "z", 50), ("b", "y", 5)], "id string, other string, tokens long")
    got = [(r["id"], r["used"]) for r in retrieve.context_window(order, near, 60).orderBy("used").collect()]
    assert got == [("a", 10), ("b", 20)]


def test_budget_and_spans(spark):
    assert one(spark, retrieve.budget(F.lit("x" * 40))) == int((8192 - 10 - 2350) * 0.85)
    spans = spark.createDataFrame([("f", 1, 10), ("f", 3, 4), ("f", 15, 20), ("f", 26, 30), ("g", 1, 1)], "file string, start long, end long")
    assert {tuple(r) for r in retrieve.spans_merged(spans, ["file"]).collect()} == {("f", 1, 20, 3), ("f", 26, 30, 1), ("g", 1, 1, 1)}


def test_look_up_by_location(spark):
    pieces = spark.createDataFrame([("f", "a", 1, 100), ("f", "b", 50, 300), ("g", "c", 1, 9)], "file string, id string, start_line int, end_line int")
    places = spark.createDataFrame([("f:60",), ("f:200-210",), ("f:900",), ("g:5",), ("odd",), ("x:y:7",)], "location string")
    assert {tuple(r) for r in retrieve.at_location(pieces, places).collect()} == {("f:60", "a"), ("f:200-210", "b"), ("g:5", "c")}


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("x", "y")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "id string")
    assert {(r["id"], r["depth"]) for r in graph.transitive_dependencies(edges, roots, 2).collect()} == {("b", 1), ("c", 2), ("d", 3)}
    assert {(r["id"], r["depth"]) for r in graph.shortest_depths(edges, roots).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 4), ("f", 5)}
    assert {r["neighbour"] for r in graph.neighbours(edges, roots, "in").collect()} == {"c"}


def test_postings(spark):
    df = spark.range(500).selectExpr("id % 3 AS k", "id AS v")
    got = collections.defaultdict(list)
    for r in indices.postings(df, F.col("k"), F.col("v"), 8).collect():
        assert len(r["values"]) < 60
        got[r["key"]] += r["values"]
    whole = {r["key"]: r["values"] for r in indices.inverted(df, F.col("k"), F.col("v")).collect()}
    assert {k: sorted(v) for k, v in got.items()} == whole


def test_routes(spark):
    assert one(spark, patterns.route_path(F.lit("@app.get('/a/b-c')"))) == "/a/b-c" and one(spark, patterns.route_path(F.lit("@app.get()"))) is None
    assert one(spark, patterns.http_methods(F.lit("@r(methods=['put', 'POST'])"))) == ["POST", "PUT"] and one(spark, patterns.http_methods(F.lit("@route"))) == ["GET"]
    assert one(spark, chunks.importance(F.lit("class"), F.lit(12))) == pytest.approx(1.0) and one(spark, chunks.importance(F.lit("file"), F.lit(0))) == 0.4
    assert one(spark, chunks.content_symbols(F.lit("f"), F.lit("  - g (line 3)\n  - x: int\nend"))) == ["f", "g"]


def test_answer_cache(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    made = cache.entries(spark.createDataFrame([("what is main?", "old", "k1"), ("other", "r", "k1")], "query string, response string, checksum_hash string"), now)
    newer = cache.entries(spark.createDataFrame([("what is main?", "new", "k1")], "query string, response string, checksum_hash string"), F.lit("2024-01-01 01:00:00").cast("timestamp"))
    both = cache.upserted(made, newer)
    asked = spark.createDataFrame([("what is main?",), ("unknown",)], "query string")
    read = lambda key, t: {r["query"]: r["response"] for r in cache.hits(asked, both, F.lit(key), F.lit(t).cast("timestamp")).collect()}
    assert read("k1", "2024-01-01 02:00:00") == {"what is main?": "new", "unknown": None}
    assert read("k2", "2024-01-01 02:00:00")["what is main?"] is None and read("k1", "2024-01-03 00:00:00")["what is main?"] is None
    assert cache.stats(both, F.lit("2024-01-02 00:30:00").cast("timestamp")).first().asDict() == {"total": 2, "valid": 1}
    assert cache.matching(both, "MAIN").count() == 1 and cache.invalidated(both, F.lit("k2")).isEmpty()
