"""Questions to answers: the question's type picks a look-up, a walk of the graph, or retrieval for a language model.

All questions of a table (query_id, question) are answered by one plan; the model is a function that the caller gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as T
from ..operators import cache, fuzzy, retrieve, search
from ..operators import chunks as chunk_ops

TEMPLATES = {
    "understanding": "Explain how this works.", "debug": "Find the likely cause of the problem and how to check it.", "comparison": "Compare the named parts.", "refactoring": "Suggest changes that make the code simpler, with reasons.",
    "performance": "Find what costs time or memory.", "security": "Find what an attacker could use.", "documentation": "Describe purpose, inputs and results.", "example": "Show how it is used.", "testing": "Suggest tests and what they should check.",
    "implementation": "Say where and how this would be added.", "architecture": "Describe the parts and how they depend on each other.", "dataflow": "Follow the data from where it enters.",
}
#: Least similarity of a chunk that is taken for it, and calls between files that are told of an architecture.
SIMILAR, ADJACENT = 0.5, 20
GROUND = "Answer from the context alone; name only code that is in it, and say so when it isn't enough."


def classified(questions: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """questions with type, confidence, needs_context, symbols, entity; with ``names`` (key) only names that are there are symbols, unless it is empty.

    The check is a join with the names, not an array of them, so it holds for any number.
    """
    found = questions.select("query_id", "question", C.symbols(F.col("question")).alias("found"))
    if names is not None and not names.isEmpty():
        known = found.select("query_id", F.posexplode("found").alias("at", "key")).join(names.select("key").distinct(), "key", "left_semi").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "key"))), lambda x: x["key"]).alias("known"))
        found = found.join(known, "query_id", "left").select("query_id", "question", F.coalesce("known", F.array().cast("array<string>")).alias("found"))
    c = found.withColumn("_c", C.classify(F.col("question"), F.col("found")))
    return c.select("query_id", "question", F.col("_c.answer.type").alias("type"), F.col("_c.answer.confidence").alias("confidence"), F.col("_c.answer.needs_context").alias("needs_context"), F.col("_c.symbols").alias("symbols"), T.entity_name(F.btrim("question", F.lit("?!. "))).alias("entity"))


def _answers(df: DataFrame, text) -> DataFrame:
    return df.select("query_id", text.alias("answer"))


def locations(asked: DataFrame, functions_by_name: DataFrame, types_by_name: DataFrame) -> DataFrame:
    """(query_id, answer): where the entity is; the five names most like it where it isn't."""
    names = functions_by_name.select("key", "values", F.lit("function").alias("kind"), F.lit(0).alias("_o")).unionByName(types_by_name.select("key", "values", F.lit("type").alias("kind"), F.lit(1).alias("_o")))
    exact = asked.join(names, asked["entity"] == names["key"]).groupBy("query_id").agg(F.min_by(F.struct("kind", "key", "values"), "_o").alias("m"))
    found = _answers(exact, F.concat(F.initcap("m.kind"), F.lit(" "), "m.key", F.lit(" is at "), F.array_join("m.values", ", ")))
    missing = asked.join(exact.select("query_id"), "query_id", "left_anti").select("query_id", "entity")
    # Names are compared in lower case and shown as they are; a name of both kinds is shown as each.
    shown = names.select(F.lower("key").alias("name"), F.concat("key", F.lit(" ("), "kind", F.lit(")")).alias("t")).distinct()
    near = fuzzy.most_like(shown.select("name"), missing.select("query_id", F.lower("entity").alias("name")), 5).join(shown, "name")
    best = near.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", "t"))), 1, 5).alias("best"))
    rest = _answers(missing.join(best, "query_id", "left"), F.concat(F.lit("No "), "entity", F.coalesce(F.concat(F.lit("; similar: "), F.array_join(F.transform("best", lambda x: x["t"]), ", ")), F.lit("; nothing similar"))))
    return found.unionByName(rest)


def usages(asked: DataFrame, edges: DataFrame, functions: DataFrame, functions_calling: DataFrame, types_by_name: DataFrame | None = None) -> DataFrame:
    """(query_id, answer): what the entity calls, and what calls it; for a type, what its methods call and what calls these."""
    named = functions.select(F.col("name").alias("entity"), "id", F.col("name").alias("callee"))
    if types_by_name is not None:
        members = functions.where("class_name IS NOT NULL").select(F.col("class_name").alias("entity"), "id", F.col("name").alias("callee"))
        named = named.unionByName(members.join(types_by_name.select(F.col("key").alias("entity")), "entity", "left_semi"))
    at = asked.select("query_id", "entity").join(named.distinct(), "entity")
    out = at.join(edges.where("dst IS NOT NULL").select(F.col("src").alias("id"), F.col("dst").alias("n")), "id").groupBy("query_id").agg(F.array_sort(F.collect_set("n")).alias("calls"))
    wanted = at.select("query_id", "callee").unionByName(asked.select("query_id", F.col("entity").alias("callee"))).distinct()
    back = wanted.join(functions_calling, wanted["callee"] == functions_calling["key"]).select("query_id", F.explode("values").alias("n")).groupBy("query_id").agg(F.array_sort(F.collect_set("n")).alias("callers"))
    both = asked.join(out, "query_id", "left").join(back, "query_id", "left")
    return _answers(both, F.concat("entity", F.lit(" calls "), _shown("calls"), F.lit("; called by "), _shown("callers")))


def _shown(c: str):
    return F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit("nothing"))


def dependencies(asked: DataFrame, edges: DataFrame, functions: DataFrame, depth: int = 2) -> DataFrame:
    """(query_id, answer): what the entity depends on, directly and through others, and what depends on it."""
    from ..operators.graph import reachable

    ids = functions.select(F.col("name").alias("entity"), "id").distinct()
    at = asked.select("query_id", "entity").join(ids, "entity")
    known = edges.where("dst IS NOT NULL")
    reach = reachable(known, at.select("id"), depth + 1).select(F.col("root").alias("rid"), F.col("id").alias("n"), "depth")
    down = at.join(reach, at["id"] == reach["rid"]).groupBy("query_id").agg(F.array_sort(F.collect_set(F.when(F.col("depth") == 1, F.col("n")))).alias("direct"), F.array_sort(F.collect_set(F.when(F.col("depth") > 1, F.col("n")))).alias("further"))
    up = at.join(known.select(F.col("dst").alias("id"), F.col("src").alias("n")), "id").groupBy("query_id").agg(F.array_sort(F.collect_set("n")).alias("by"))
    both = asked.join(down, "query_id", "left").join(up, "query_id", "left")
    return _answers(both, F.concat("entity", F.lit(" depends on "), _shown("direct"), F.lit("; through them on "), _shown("further"), F.lit("; needed by "), _shown("by")))


def facts_of(asked: DataFrame, k) -> DataFrame:
    """(query_id, facts): what the tables know for a question's type, to go before its context.

    implementation: where the names in the question are; architecture: the calls between files, most frequent first;
    dataflow: what the entity calls, with the file of each.
    """
    # Callers aren't asked for, so the table without them is read where there is one.
    functions = k.located if hasattr(k, "located") else k.functions
    places = functions.select(F.col("name").alias("symbol"), F.concat("path", F.lit(":"), F.col("line_start").cast("string")).alias("at")).unionByName(k.classes.select(F.col("name").alias("symbol"), F.concat("path", F.lit(":"), F.col("line_start").cast("string")).alias("at")))
    named = asked.where("type = 'implementation'").select("query_id", F.explode("symbols").alias("symbol")).join(places, "symbol").groupBy("query_id", "symbol").agg(F.array_sort(F.collect_set("at")).alias("at"))
    found = named.groupBy("query_id").agg(F.concat(F.lit("Defined: "), F.array_join(F.array_sort(F.collect_list(F.concat("symbol", F.lit(" at "), F.array_join("at", ", ")))), "; ")).alias("facts"))
    called = functions.select(F.col("path").alias("src"), F.explode("calls").alias("c")).where("c.defined_in IS NOT NULL AND c.defined_in <> src").groupBy("src", F.col("c.defined_in").alias("dst")).agg(F.count("*").alias("n"))
    most = called.orderBy(F.desc("n"), "src", "dst").limit(ADJACENT).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("_o"), "src", "dst", "n"))).alias("e"))
    between = asked.where("type = 'architecture'").select("query_id").crossJoin(F.broadcast(most)).where(F.size("e") > 0).select("query_id", F.concat(F.lit("Calls between files: "), F.array_join(F.transform("e", lambda x: F.concat(x["src"], F.lit(" to "), x["dst"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), "; ")).alias("facts"))
    callees = functions.select(F.col("name").alias("entity"), F.explode("calls").alias("c")).select("entity", F.concat("c.callee", F.coalesce(F.concat(F.lit(" in "), "c.defined_in"), F.lit(""))).alias("n"))
    flow = asked.where("type = 'dataflow'").select("query_id", "entity").join(callees, "entity").groupBy("query_id", "entity").agg(F.array_sort(F.collect_set("n")).alias("n")).select("query_id", F.concat("entity", F.lit(" calls "), F.array_join("n", ", ")).alias("facts"))
    return found.unionByName(between).unionByName(flow)


def contexts(asked: DataFrame, chunks: DataFrame, edges: DataFrame | None = None, max_tokens: int = 8192, top: int = 100, knowledge: tuple[DataFrame, DataFrame] | None = None, vectors: DataFrame | None = None, question_vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, context, total_tokens, sources): the chunks that fit, best first.

    Four strategies are merged: the names that the knowledge tables (functions, classes) hold, names and symbols of the
    chunks, words, and, where ``vectors`` (file, id, embedding) of the chunks and ``question_vectors`` (query_id, query) are
    given, a similarity of SIMILAR or more.  Chunks are known by file and id.  The questions are met with the chunks by
    blocks: a question is a row of its own for each chunk only within a task, and what is shuffled is the chunks that score.
    """
    c = chunks.select(F.concat_ws("|", "file_path", "id").alias("id"), F.col("id").alias("node"), "name", F.col("file_path").alias("file"), "chunk_type", "line_start", "line_end", "content", "tokens").withColumn("symbols", chunk_ops.content_symbols(F.col("name"), F.col("content")))
    q = asked.select("query_id", T.symbol_candidates(F.col("question")).alias("wanted"), T.question_words(F.col("question")).alias("words"))
    pairs = c.crossJoin(F.broadcast(q) if asked.limit(1001).count() <= 1000 else q)
    scored = pairs.select(
        "query_id", "id", retrieve.exact_score(F.col("name"), F.col("symbols"), F.col("wanted")).alias("e"), retrieve.partial_score(F.col("name"), F.col("symbols"), F.col("wanted")).alias("p"),
        retrieve.keyword_score(F.col("name"), F.col("symbols"), F.col("content"), F.col("file"), F.col("chunk_type"), F.col("wanted"), F.col("words")).alias("k"),
    )
    part = lambda s: scored.where(F.col(s) > 0).select("query_id", "id", F.col(s).alias("score"))
    exact, similar = part("e"), part("e").limit(0)
    if knowledge is not None:
        known = retrieve.kb_lookup(q.select("query_id", F.explode("wanted").alias("name")), *knowledge).select("query_id", F.concat_ws("|", "file", "id").alias("id"), "score")
        exact = exact.unionByName(known).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    if vectors is not None and question_vectors is not None:
        keyed = vectors.select(F.concat_ws("|", "file", "id").alias("id"), "embedding")
        similar = search.top_k_each(keyed, question_vectors, top, "id", threshold=SIMILAR).select("query_id", "id", "score")
    best = retrieve.merged(exact, part("p"), part("k"), similar, top)
    if edges is not None:
        # Edges name ids; a neighbour is a chunk of that id in any file.
        at = c.select("node", "id")
        linked = edges.where("dst IS NOT NULL").select(F.col("src").alias("node"), "dst").distinct().join(at, "node").select(F.col("id").alias("src"), F.col("dst").alias("node")).join(at, "node").select("src", F.col("id").alias("dst"))
        wide = retrieve.with_neighbours(best, linked)
    else:
        wide = retrieve.hot_files(best.join(c.select("id", "file"), "id"))
    full = wide.select("query_id", "id", "score").join(c, "id").select("query_id", "id", "file", F.col("line_start").alias("start_line"), F.col("line_end").alias("end_line"), "content", "tokens", "score")
    limits = asked.select("query_id", retrieve.budget(F.col("question"), max_tokens).alias("budget"))
    selected = retrieve.select_chunks(full, limits)
    text = selected.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("used", "content"))), lambda x: x["content"]), "\n\n").alias("context"))
    return text.join(retrieve.assembled(selected), "query_id")


def prompts(asked: DataFrame, context: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(query_id, type, prompt, answer, sources) for the questions that need context; a comparison needs two names."""
    template = F.create_map(*(F.lit(x) for pair in TEMPLATES.items() for x in pair))
    short = (F.col("type") == "comparison") & (F.size("symbols") < 2)
    known = asked.where("needs_context").join(context, "query_id", "left")
    known = known.join(facts, "query_id", "left") if facts is not None else known.withColumn("facts", F.lit(None).cast("string"))
    body = F.concat_ws("\n\n", F.coalesce(F.try_element_at(template, F.col("type")), F.lit(TEMPLATES["understanding"])), F.lit(GROUND), F.col("facts"), F.concat(F.lit("Context:\n"), F.coalesce("context", F.lit("(none)"))), F.concat(F.lit("Question: "), "question"))
    return known.select("query_id", "type", F.when(short, F.lit(None)).otherwise(body).alias("prompt"), F.when(short, "A comparison needs at least two names.").alias("answer"), "sources")


def route(questions: DataFrame, k, model: Callable[[DataFrame], DataFrame] | None = None, max_tokens: int = 8192, vectors: DataFrame | None = None, embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, type, answer) of every question; ``model`` turns (query_id, prompt) into (query_id, answer), and without one the prompt is the answer.

    With ``vectors`` (file, id, embedding) of the chunks and ``embed``, which turns (query_id, question) into (query_id, query),
    contexts also hold what is similar.
    """
    asked = classified(questions, k.functions_by_name.select("key").unionByName(k.types_by_name.select("key")))
    of = lambda kind: asked.where(F.col("type") == kind)
    direct = locations(of("location"), k.functions_by_name, k.types_by_name).unionByName(usages(of("usage"), k.edges, k.located, k.functions_calling, k.types_by_name)).unionByName(dependencies(of("dependency"), k.edges, k.located))
    needing = asked.where("needs_context")
    seen = embed(needing.select("query_id", "question")) if embed is not None and vectors is not None else None
    asking = prompts(asked, contexts(needing, k.chunks, k.edges, max_tokens, knowledge=(k.located, k.classes), vectors=vectors, question_vectors=seen), facts_of(needing, k))
    told = model(asking.where("prompt IS NOT NULL").select("query_id", "prompt")) if model else asking.where("prompt IS NOT NULL").select("query_id", F.col("prompt").alias("answer"))
    every = direct.unionByName(told.select("query_id", "answer")).unionByName(asking.where("prompt IS NULL").select("query_id", "answer"))
    return asked.select("query_id", "type").join(every, "query_id")


def answered(questions: DataFrame, k, kept: DataFrame, checksum, now, hours: dict[str, int] | int = 24, **options) -> tuple[DataFrame, DataFrame]:
    """Answers (query_id, answer, cached) of questions, and the new entries of the answer cache ``kept``.

    A question with a valid answer for this state of the sources (``checksum``) is answered from the cache; the others are
    routed, and their answers become entries that end after so many hours, by type where ``hours`` is a dict (with a default
    under "").
    """
    had = cache.hits(questions.withColumnRenamed("question", "query"), kept, checksum, now)
    known = had.where("response IS NOT NULL").select("query_id", F.col("response").alias("answer"), F.lit(True).alias("cached"))
    new = route(had.where("response IS NULL").select("query_id", F.col("query").alias("question")), k, **options)
    texts = new.join(questions, "query_id").select(F.col("question").alias("query"), F.col("answer").alias("response"), checksum.alias("checksum_hash"), "type")
    return known.unionByName(new.select("query_id", "answer", F.lit(False).alias("cached"))), cache.entries(texts, now, hours)
