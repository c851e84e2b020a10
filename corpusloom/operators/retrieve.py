"""Hybrid retrieval: scores by names, words and vectors, merged, spread over the graph and cut to a token budget.

Chunks are (id, name, symbols, content, file, chunk_type, tokens, start_line, end_line, importance).  Questions are
(query_id, question); every question is answered in one plan.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

BLOCK = 64
OVERHEAD, MERGE_GAP, HOT_CANDIDATES, HOT_FILE, HOT_BONUS, NEIGHBOUR = 20, 5, 20, 3, 0.2, 0.9


def budget(question: Column, max_tokens: int = 8192) -> Column:
    """Tokens for context: 85 % of what the question, the prompts and the answer leave."""
    return F.floor((F.lit(max_tokens) - T.estimated_tokens(question) - 150 - 200 - 2000) * 0.85).cast("long")


def _lower(names: Column) -> Column:
    return F.transform(names, F.lower)


def exact_score(name: Column, symbols: Column, wanted: Column, compat: bool = False) -> Column:
    """100 for a wanted name, 90 for a wanted symbol, else 0; ``compat``: a symbol hit also lowers a name hit to 90."""
    w = _lower(wanted)
    by_symbol = F.arrays_overlap(_lower(symbols), w)
    by_name = F.array_contains(w, F.lower(name))
    return (F.when(by_symbol, 90.0).when(by_name, 100.0) if compat else F.when(by_name, 100.0).when(by_symbol, 90.0)).otherwise(0.0)


def partial_score(name: Column, symbols: Column, wanted: Column) -> Column:
    """15 for each wanted part of the name and 12 of a symbol; while no part has matched, 8 and 6 for a substring.  0 below two parts, or one and over 15."""

    def fold(state: Column, target: Column, part: float, piece: float) -> Column:
        tokens, lower = T.identifier_tokens(target), F.lower(target)

        def one(s: Column, w: Column) -> Column:
            hit = F.array_contains(tokens, w)
            n = s["n"] + hit.cast("int")
            return F.struct(n.alias("n"), (s["score"] + F.when(hit, part).otherwise(0.0) + F.when((n == 0) & F.contains(lower, w), piece).otherwise(0.0)).alias("score"))

        return F.aggregate(_lower(wanted), state, one)

    state = fold(F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("score")), name, 15.0, 8.0)
    state = F.aggregate(symbols, state, lambda s, symbol: fold(s, symbol, 12.0, 6.0))
    return F.when((state["n"] >= 2) | ((state["n"] == 1) & (state["score"] > 15)), state["score"]).otherwise(0.0)


def keyword_score(name: Column, symbols: Column, content: Column, file: Column, chunk_type: Column, wanted: Column, words: Column, compat: bool = False) -> Column:
    """Name 20 (10 for a part, until the name itself), symbols 15 (7), words in symbols 10 (5), in the content 2, in the file's name 1; 1, 0.8 or 0.6 for functions, classes or methods.

    The bonus needs a hit; with ``compat`` it is given to all.
    """

    def stops(target: Column, full: float, part: float) -> Column:
        lower = F.lower(target)
        step = lambda s, w: F.when(s["done"], s).otherwise(F.struct((s["score"] + F.when(lower == w, full).when(F.contains(lower, w), part).otherwise(0.0)).alias("score"), (lower == w).alias("done")))
        return F.aggregate(_lower(wanted), F.struct(F.lit(0.0).alias("score"), F.lit(False).alias("done")), step)["score"]

    total = lambda of, value: F.aggregate(of, F.lit(0.0), lambda s, x: s + value(x))
    hits = stops(name, 20.0, 10.0)
    hits = hits + total(symbols, lambda x: stops(x, 15.0, 7.0) + total(words, lambda w: F.when(F.lower(x) == w, 10.0).when(F.contains(F.lower(x), w), 5.0).otherwise(0.0)))
    # The texts are lower-cased once, as the elements of an array, and not for each word.
    hits = hits + F.aggregate(F.array(F.struct(F.lower(content).alias("c"), F.lower(file).alias("f"))), F.lit(0.0), lambda s, x: s + total(words, lambda w: F.when(F.contains(x["c"], w), 2.0).otherwise(0.0) + F.when(F.contains(x["f"], w), 1.0).otherwise(0.0)))
    bonus = F.when(chunk_type == "function", 1.0).when(chunk_type == "class", 0.8).when(chunk_type == "method", 0.6).otherwise(0.0)
    return hits + (bonus if compat else F.when(hits > 0, bonus).otherwise(0.0))


def merged(exact: DataFrame, partial: DataFrame, words: DataFrame, vectors: DataFrame, top: int = 100) -> DataFrame:
    """(query_id, id, score, match_type) of strategies (query_id, id, score): exact as it is, partial 1.5 over or added on, words 2.0, similarity by half.

    Exact hits come first, then by score; ``top`` a question.
    """
    parts = [df.select("query_id", "id", F.lit(kind).alias("kind"), F.col("score").cast("double").alias("score")) for kind, df in (("exact", exact), ("partial", partial), ("keyword", words), ("semantic", vectors))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = every.groupBy("query_id", "id").agg(*(F.max(F.when(F.col("kind") == k, F.col("score"))).alias(k) for k in ("exact", "partial", "keyword", "semantic")))
    score = F.coalesce("exact", F.lit(0.0))
    score = F.greatest(score, F.when(F.col("partial").isNotNull(), F.when(score > 0, F.greatest(score, "partial") + 1.5).otherwise(F.col("partial"))).otherwise(0.0))
    score = F.greatest(score, F.when(F.col("keyword").isNotNull(), F.when(score > 0, F.greatest(score, "keyword") + 2.0).otherwise(F.col("keyword"))).otherwise(0.0))
    score = score + F.coalesce(F.col("semantic") * 0.5, F.lit(0.0))
    kind = F.when(F.col("exact").isNotNull(), "exact").when(F.col("partial").isNotNull(), "partial").when(F.col("keyword").isNotNull(), "keyword").otherwise("semantic")
    order = Window.partitionBy("query_id").orderBy((F.col("match_type") == "exact").desc(), F.desc("score"), "id")
    return best.select("query_id", "id", score.alias("score"), kind.alias("match_type")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def with_neighbours(scored: DataFrame, edges: DataFrame, take: int = 20) -> DataFrame:
    """(query_id, id, score): scores, and for the neighbours of the ``take`` best nine tenths of theirs; the greatest counts."""
    best = scored.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("_r") <= take)
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("to")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("to")))
    near = best.join(both, "id").select("query_id", F.col("to").alias("id"), (F.col("score") * NEIGHBOUR).alias("score"))
    return scored.select("query_id", "id", "score").unionByName(near).groupBy("query_id", "id").agg(F.max("score").alias("score"))


def hot_files(scored: DataFrame) -> DataFrame:
    """Candidates (query_id, id, file, score): with 20 or more of them, those of files with 3 or more get 0.2.

    The candidates are counted by grouped counts, so no task holds a question's rows, and the hot files, of which a question
    has a third of its candidates at most, are joined back.
    """
    here = scored.groupBy("query_id", "file").agg(F.count("*").alias("_n"))
    all_ = here.groupBy("query_id").agg(F.sum("_n").alias("_all")).where(F.col("_all") >= HOT_CANDIDATES).select("query_id")
    hot = here.where(F.col("_n") >= HOT_FILE).join(all_, "query_id", "left_semi").select("query_id", F.col("file").alias("_file"), F.lit(HOT_BONUS).alias("_bonus"))
    return scored.join(hot.withColumnRenamed("query_id", "_q"), (F.col("query_id") == F.col("_q")) & F.col("file").eqNullSafe(F.col("_file")), "left").withColumn("score", F.col("score") + F.coalesce("_bonus", F.lit(0.0))).drop("_q", "_file", "_bonus")


def kb_lookup(wanted: DataFrame, functions: DataFrame, classes: DataFrame) -> DataFrame:
    """(query_id, file, id, score) of wanted (query_id, name): 120 for a function, 113 a method, 118 a class, 95 a method's class; 93.5 what a function calls, in the file that the call resolves to.

    Names are compared without regard to case; ids are kept apart by their file.
    """
    w = wanted.select("query_id", F.lower("name").alias("_w")).distinct()
    fn = functions.select(F.col("path").alias("file"), "id", "kind", "class_name", "calls", F.lower("name").alias("_w"))
    hit = w.join(fn, "_w")
    own = hit.select("query_id", "file", "id", F.when(F.col("kind") == "method", 113.0).otherwise(F.lit(120.0)).alias("score"))
    of_class = w.join(classes.select(F.col("path").alias("file"), "id", F.lower("name").alias("_w")), "_w").select("query_id", "file", "id", F.lit(118.0).alias("score"))
    parents = hit.where("class_name IS NOT NULL").join(classes.select(F.col("path").alias("file"), F.col("name").alias("class_name"), F.col("id").alias("_class")), ["file", "class_name"]).select("query_id", "file", F.col("_class").alias("id"), F.lit(95.0).alias("score"))
    called = hit.select("query_id", F.explode("calls").alias("c")).where("c.defined_in IS NOT NULL").select("query_id", F.col("c.defined_in").alias("file"), F.lower("c.callee").alias("_w")).join(fn.select("file", "_w", "id"), ["file", "_w"]).select("query_id", "file", "id", F.lit(93.5).alias("score"))
    return own.unionByName(of_class).unionByName(parents).unionByName(called).groupBy("query_id", "file", "id").agg(F.max("score").alias("score"))


def at_location(chunks: DataFrame, places: DataFrame) -> DataFrame:
    """places (location, as path:line or path:a-b) with the first chunk of that file whose lines overlap.

    An equality join on file and block of lines, so a long file isn't compared with all its places.
    """
    # One cut at the last colon, and one at the dash.
    cut = places.select("location", F.substring_index("location", ":", -1).alias("_lines")).where(F.col("_lines").rlike(r"^\d+(-\d+)?$"))
    p = cut.select("location", F.left("location", F.length("location") - F.length("_lines") - 1).alias("file"), F.substring_index("_lines", "-", 1).cast("int").alias("_a"), F.substring_index("_lines", "-", -1).cast("int").alias("_b")).where("file <> ''")
    blocks = lambda low, high: F.explode(F.sequence(F.floor(low / BLOCK), F.floor(high / BLOCK))).alias("_block")
    pieces = chunks.select("file", "id", "start_line", "end_line").where("start_line <= end_line").select("*", blocks(F.col("start_line"), F.col("end_line")))
    return p.where("_a <= _b").select("*", blocks(F.col("_a"), F.col("_b"))).join(pieces, ["file", "_block"]).where("start_line <= _b AND end_line >= _a").groupBy("location").agg(F.min_by("id", F.struct("start_line", "id")).alias("id"))


def packed(scored: DataFrame, tokens: Column, limit: int, by: list[str], order: list[Column]) -> DataFrame:
    """The rows before the first at which the sum of tokens and OVERHEAD passes ``limit``; ``used`` is the sum so far.

    A row costs OVERHEAD at least, so only a group's first limit / OVERHEAD rows can be among them; each task keeps as many
    of its own before the shuffle, and a group that a third of the rows are in sends no more.
    """
    order_by = Window.partitionBy(*by).orderBy(*order)
    first = scored.withColumn("_r", F.row_number().over(order_by)).where(F.col("_r") <= limit // OVERHEAD).drop("_r")
    return first.withColumn("used", F.sum(tokens + OVERHEAD).over(order_by.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("used") <= limit)


SELECTED = "query_id long, id string, file string, start_line int, end_line int, content string, tokens long, ids array<string>, used long"


def select_chunks(scored: DataFrame, limits: DataFrame) -> DataFrame:
    """Chunks of each question in order of score until the budget would be passed; one that is within 5 lines of the chunk taken last, in one file, is merged with it, which saves its overhead.

    Scored is (query_id, id, file, start_line, end_line, content, tokens, score), limits (query_id, budget).  An ordered
    fold, so it runs in Python, a question at a time; there are ``top`` candidates a question at most.
    """

    def fold(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["score", "id"], ascending=[False, True])
        out, used = [], 0
        for r in table.itertuples():
            cost = r.tokens + OVERHEAD
            if used + cost > r.budget:
                break
            last = out[-1] if out else None
            gap = None if last is None or last["file"] != r.file else max(0, r.start_line - last["end_line"], last["start_line"] - r.end_line)
            if gap is not None and gap <= MERGE_GAP:
                if r.start_line > last["end_line"]:
                    last["content"] += "\n" + r.content
                elif last["start_line"] > r.end_line:
                    last["content"] = r.content + "\n" + last["content"]
                last |= {"start_line": min(last["start_line"], r.start_line), "end_line": max(last["end_line"], r.end_line), "tokens": last["tokens"] + r.tokens, "ids": [*last["ids"], r.id]}
                used += r.tokens
            else:
                out.append({"query_id": r.query_id, "id": r.id, "file": r.file, "start_line": r.start_line, "end_line": r.end_line, "content": r.content, "tokens": r.tokens, "ids": [r.id]})
                used += cost
            out[-1]["used"] = used
        return pd.DataFrame(out, columns=[c.split()[0] for c in SELECTED.split(", ")])

    return scored.join(limits, "query_id").groupBy("query_id").applyInPandas(fold, SELECTED)


def spans_merged(spans: DataFrame, by: list[str], gap: int = MERGE_GAP) -> DataFrame:
    """(by, start, end, n): islands of spans (start, end) that overlap or are at most ``gap`` apart."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("_new", F.when(F.col("start") - before <= gap, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_island")


def assembled(selected: DataFrame) -> DataFrame:
    """(query_id, total_tokens, sources): tokens with overhead, and the distinct files in order."""
    return selected.groupBy("query_id").agg(F.sum(F.col("tokens") + OVERHEAD).alias("total_tokens"), F.array_sort(F.collect_set("file")).alias("sources"))


def context_window(chunks: DataFrame, related: DataFrame, max_tokens: int) -> DataFrame:
    """Chunks of ids in order, each followed by its related ones, each once, until a chunk doesn't fit.

    Chunks (query_id, position, id, tokens), related (id, other, tokens).  A related chunk that doesn't fit ends only its
    list, a chunk of the order ends the window.
    """
    near = chunks.join(related, "id", "left").groupBy("query_id", "position", "id", chunks["tokens"]).agg(F.array_sort(F.collect_set(F.when(F.col("other").isNotNull(), F.struct(F.col("other").alias("id"), related["tokens"].alias("tokens"))))).alias("near"))

    def fold(table: pd.DataFrame) -> pd.DataFrame:
        out, seen, used = [], set(), 0
        for r in table.sort_values("position").itertuples():
            if r.id in seen:
                continue
            if used + r.tokens > max_tokens:
                break
            seen.add(r.id)
            used += r.tokens
            out.append((r.query_id, r.id, used))
            for x in r.near if r.near is not None else []:
                if x["id"] in seen:
                    continue
                if used + x["tokens"] > max_tokens:
                    break
                seen.add(x["id"])
                used += x["tokens"]
                out.append((r.query_id, x["id"], used))
        return pd.DataFrame(out, columns=["query_id", "id", "used"])

    return near.groupBy("query_id").applyInPandas(fold, "query_id long, id string, used long")


