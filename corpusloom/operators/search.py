"""Exact vector search and the vector index's reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine

#: Query vectors that are sent to every task at most; more are met in blocks.
BROADCAST_QUERIES = 10_000
#: Vectors and queries that are multiplied at a time.
BLOCK = 1024


def top_k(vectors: DataFrame, query: list[float], k: int, key: str = "id", where: Column | None = None, threshold: float | None = None) -> DataFrame:
    """The k most similar vectors to one: filters come before scoring, ties go by key; TakeOrdered keeps k rows a task."""
    kept = vectors if where is None else vectors.where(where)
    scored = kept.withColumn("score", cosine(F.col("embedding"), F.array(*(F.lit(float(x)) for x in query))))
    return (scored if threshold is None else scored.where(F.col("score") >= threshold)).orderBy(F.desc("score"), key).limit(k)


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int, key: str = "id", where: Column | None = None, threshold: float | None = None) -> DataFrame:
    """(query_id, key, score, rank): the k most similar vectors to each of many queries (query_id, query), exactly.

    Up to BROADCAST_QUERIES of them go to every task.  More are packed into blocks of BLOCK, as the vectors are, and every
    block of queries meets every block of vectors.  Either way two blocks are multiplied as matrices and give their k best a
    query, so what is shuffled is k rows a query and block.  ``where`` comes before scoring, ``threshold`` before the ranks.
    Scores are ranked to 10 places, ties by key.  All vectors must have one size; a null one is left out.
    """
    best = Window.partitionBy("query_id").orderBy(F.round("score", 10).desc(), key)
    wanted = queries.select("query_id", F.col("query").alias("embedding")).where("embedding IS NOT NULL")
    kept = (vectors if where is None else vectors.where(where)).select(key, "embedding").where("embedding IS NOT NULL")
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((wanted, "query_id"), (kept, key))]
    out = f"query_id {kinds[0]}, `{key}` {kinds[1]}, score double"

    def met(queries: tuple[pa.Array, np.ndarray], ids: pa.Array, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(queries[0]), BLOCK):
            some, names = queries[1][start : start + BLOCK], queries[0].slice(start, BLOCK)
            scores = rows @ some.T
            rounded = np.round(scores, 10)
            if threshold is not None:
                rounded[scores < threshold] = -np.inf
            top = _first(rounded, k)
            value = np.take_along_axis(scores, top, 0)
            good = np.take_along_axis(rounded, top, 0).ravel() > -np.inf
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in (names.take(pa.array(np.tile(np.arange(len(names)), len(top)))), ids.take(pa.array(top.ravel())), pa.array(value.ravel()))], ["query_id", key, "score"])

    if wanted.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES:
        known = wanted.toArrow().combine_chunks()
        sent = vectors.sparkSession.sparkContext.broadcast((_whole(known["query_id"]), _matrix(known["embedding"])))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.sort_by(key)
                for start in range(0, batch.num_rows if len(sent.value[0]) else 0, BLOCK):
                    part = batch.slice(start, BLOCK)
                    yield from met(sent.value, part.column(key), _matrix(part.column("embedding")))

        found = kept.mapInArrow(search, out)
    else:
        names = [f"ids array<{kind}>, numbers array<double>" for kind in kinds]
        pairs = _packed(kept, key, names[1]).crossJoin(_packed(wanted, "query_id", names[0]).withColumnsRenamed({"ids": "query_ids", "numbers": "query_numbers"}))

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, numbers, query_ids, query_numbers = (batch.column(c)[i].values for c in range(4))
                    yield from met((query_ids, query_numbers.to_numpy().reshape(len(query_ids), -1)), ids, numbers.to_numpy().reshape(len(ids), -1))

        found = pairs.mapInArrow(join, out)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _packed(vectors: DataFrame, key: str, schema: str) -> DataFrame:
    """(ids, numbers): blocks of unit vectors in the order of their ids."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.sort_by(key)
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (part.column(key), pa.array(_matrix(part.column("embedding")).ravel()))]
                yield pa.RecordBatch.from_arrays(lists, ["ids", "numbers"])

    return vectors.mapInArrow(pack, schema)


def _first(rows: np.ndarray, k: int) -> np.ndarray:
    """The places of each column's k greatest numbers, of equal ones the first, in order."""
    if len(rows) > 4 * k:
        # All that reach the k-th greatest number; the rest can't be among the first k.
        least = -np.partition(-rows, k - 1, axis=0)[k - 1]
        some = np.flatnonzero((rows >= least).any(1))
        if len(some) < len(rows):
            return some[np.argsort(-rows[some], axis=0, kind="stable")[:k]]
    return np.argsort(-rows, axis=0, kind="stable")[:k]


def _whole(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors as rows."""
    lists = _whole(column)
    return _unit(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1 if len(lists) else 0))


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def filtered(chunk_type: list[str] | None = None, language: list[str] | None = None, paths: list[str] | None = None) -> Column:
    """The condition of a filtered search; a null fails a filter that is given."""
    out = F.lit(True)
    if chunk_type:
        out &= F.coalesce(F.col("chunk_type").isin(chunk_type), F.lit(False))
    if language:
        out &= F.coalesce(F.col("language").isin(language), F.lit(False))
    if paths:
        some = F.lit(False)
        for p in paths:
            some |= F.coalesce(F.contains("file_path", F.lit(p)), F.lit(False))
        out &= some
    return out


def checked(vectors: DataFrame, size: int) -> DataFrame:
    """The vectors, all of ``size``; another size ends the query with an error that names it."""
    wrong = F.raise_error(F.concat(F.lit(f"vector of {size} numbers expected, found "), F.size("embedding").cast("string")))
    return vectors.withColumn("embedding", F.when(F.size("embedding") == size, F.col("embedding")).otherwise(wrong.cast("array<float>")))


def stats(vectors: DataFrame, by: str) -> DataFrame:
    """(by, n, share in percent) of each kind, most frequent first."""
    return vectors.groupBy(by).agg(F.count("*").alias("n")).withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def size_mb(vectors: DataFrame, key: str = "id") -> DataFrame:
    """Bytes of 4-byte numbers and ids, in MB."""
    return vectors.agg((F.sum(F.size("embedding") * 4 + F.octet_length(F.col(key).cast("string"))) / 1048576).alias("size_mb"))


def compared(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """One row: how many ids are in one index alone, differ in size, and the greatest difference of a number."""
    both = a.select(key, F.col("embedding").alias("x")).join(b.select(key, F.col("embedding").alias("y")), key, "full")
    apart = F.array_max(F.zip_with("x", "y", lambda p, q: F.abs(p.cast("double") - q.cast("double"))))
    return both.agg(F.count_if(F.col("y").isNull()).alias("only_a"), F.count_if(F.col("x").isNull()).alias("only_b"), F.count_if(F.size("x") != F.size("y")).alias("other_size"), F.max(apart).alias("max_difference"))
