"""The names most like each of many: fuzzy search in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are sent to every task at most; more are joined in as many blocks, each with all names.
BROADCAST_QUERIES = 20_000
BLOCK = 512


class Names:
    """Names as rows of character codes, with counts of each character of an alphabet."""

    def __init__(self, names: list[str]):
        self.names = names
        self.length = np.array([len(x) for x in names], np.int32)
        width = int(self.length.max(initial=0))
        self.code = np.zeros((len(names), width), np.int32)
        for i, x in enumerate(names):
            self.code[i, : len(x)] = np.frombuffer(x.encode("utf-32-le"), np.int32)

    def counts(self, alphabet: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.names), len(alphabet)), np.int32)
        at = np.searchsorted(alphabet, self.code)
        at[at == len(alphabet)] = 0
        row, column = np.nonzero((alphabet[at] == self.code) & (self.code != 0))
        np.add.at(out, (row, at[row, column]), 1)
        return out


def scores(patterns: Names, targets: Names) -> np.ndarray:
    """``text.fuzzy_score`` of each pattern (rows) with each target."""
    alphabet = np.unique(patterns.code)
    alphabet = alphabet[alphabet != 0]
    width = min(patterns.code.shape[1], targets.code.shape[1])
    out = np.zeros((len(patterns.names), len(targets.names)), np.int32)
    for j in range(width):
        a, b = patterns.code[:, j], targets.code[:, j]
        out += 10 * ((a[:, None] == b) & (a[:, None] != 0))
    p, t = patterns.counts(alphabet), targets.counts(alphabet)
    for c in range(len(alphabet)):
        out += 2 * np.minimum(p[:, c][:, None], t[:, c])
    out -= np.abs(patterns.length[:, None] - targets.length)
    inside = "\n".join(targets.names)
    for i, pattern in enumerate(patterns.names):
        # A pattern that is nowhere in the block's names is in none of them.
        if pattern in inside:
            out[i, [k for k, x in enumerate(targets.names) if pattern in x]] = 500
            out[i, [k for k, x in enumerate(targets.names) if pattern == x]] = 1000
    return out


def most_like(names: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, name, score, rank): the k distinct names (name) most like each query (query_id, name), of a score over 0; ties go by name.

    A block of names is scored with a block of queries as arrays, and gives its k best a query, so what is shuffled is k
    rows a query and block of names.  Up to BROADCAST_QUERIES queries go to every task; more come in so many blocks, and every
    task of names meets each block.
    """
    known = names.where("name IS NOT NULL").select("name").distinct()
    asked = queries.where("name IS NOT NULL").select("query_id", "name")
    kind = asked.schema["query_id"].dataType.simpleString()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "name")

    def met(ids: pa.Array, patterns: list[str], targets: list[str]) -> Iterator[pa.RecordBatch]:
        order = sorted(targets)
        for a in range(0, len(order), BLOCK):
            block = Names(order[a : a + BLOCK])
            for b in range(0, len(patterns), BLOCK):
                score = scores(Names(patterns[b : b + BLOCK]), block)
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                value = np.take_along_axis(score, top, 1)
                row, column = np.nonzero(value > 0)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(b + row)), pa.array([block.names[x] for x in top[row, column]], pa.string()), pa.array(value[row, column])], ["query_id", "name", "score"])

    if asked.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES:
        table = asked.toArrow().combine_chunks()
        sent = names.sparkSession.sparkContext.broadcast((table["query_id"].combine_chunks() if isinstance(table["query_id"], pa.ChunkedArray) else table["query_id"], table["name"].to_pylist()))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from met(*sent.value, batch.column("name").to_pylist())

        found = known.mapInArrow(search, f"query_id {kind}, name string, score int")
    else:
        blocks = [df.groupBy((F.monotonically_increasing_id() / BLOCK).cast("long").alias("_b")).agg(F.collect_list(x).alias(n)).drop("_b") for df, x, n in ((known, F.col("name"), "names"), (asked, F.struct("query_id", "name"), "asked"))]

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    asked = batch.column("asked")[i].values
                    yield from met(asked.field("query_id"), asked.field("name").to_pylist(), batch.column("names")[i].values.to_pylist())

        found = blocks[0].crossJoin(blocks[1]).mapInArrow(join, f"query_id {kind}, name string, score int")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
