"""Operator 8: benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the power of two of their number of distinct shingles.  A partition has its sketch size (the
least hashes of an item, a uniform sample of its shingles; all of them up to ``sketch``) and from its bounds the least
number of sketch hits and the least document size at which containment can reach the threshold.  A short item in a
document a thousand times longer has a Jaccard similarity near 0.001, at which equal-minhash tables find little; so
the item's minhashes are looked up among all shingles of the document, whose hit rate is the containment itself,
whatever the sizes.  Candidates are verified by the exact share of the item's shingles: where hashes are equal, the words are
compared.

Plan.  With the benchmark's sketches within ``BROADCAST_HASHES`` they go to every task, and each document is searched
and verified where it is read: no shuffle.  Beyond it, shingles are joined with the sketches by hash, hits counted by
(document, item), and the texts of candidate pairs joined for verification.  Both ways give the same rows.

Defined results: null texts, texts and items without words, and item_ids that are null or no numbers match nothing; rows
without a doc_id (null, or no number) are searched, and their doc_id is null.  Fewer than ``k`` words make one shingle of
all of them.  Repeated rows give one result row.  Ties in item_id (several texts under one id) are items of their own; the
greatest containment counts.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import document_id, minus
from .textkit import WORDS_SQL, Words, signed, slices

K, THRESHOLD, SKETCH = 3, 0.6, 32
#: Sketch hashes and item characters that are sent to every task at most.
BROADCAST_HASHES, BROADCAST_CHARS = 2_000_000, 64_000_000
OUT = "doc_id long, item_id long, containment double"


def least_hits(n: int, threshold: float, sketch: int = SKETCH) -> int:
    """Sketch hits that an item of n distinct shingles needs to be a candidate: three deviations under the mean."""
    if n <= sketch:
        return max(1, math.ceil(threshold * n - 1e-9))
    return max(1, math.floor(sketch * threshold - 3 * math.sqrt(sketch * threshold * (1 - threshold))))


def sketches(items: DataFrame, k: int = K, sketch: int = SKETCH, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, text, size, needs, hashes): of each item its size, the least hits of a candidate, and its least hashes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                g, of = Words(part.column("text")).shingles(k)
                sets = [np.unique(g[a:b]) for a, b in zip(of[:-1], of[1:], strict=True)]
                needs = [least_hits(len(s), threshold, sketch) if len(s) else 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("item_id"), part.column("text"), pa.array([len(s) for s in sets], pa.int32()), pa.array(needs, pa.int32()), pa.array([signed(s[:sketch]) for s in sets], pa.list_(pa.int64()))],
                    ["item_id", "text", "size", "needs", "hashes"],
                )

    known = items.select(F.col("item_id").try_cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    return known.mapInArrow(make, "item_id long, text string, size int, needs int, hashes array<long>").where("size > 0")


class Item:
    """An item's distinct shingles in the order of their hashes, as hashes and as words."""

    def __init__(self, text: str, k: int):
        w = Words(pa.array([text]), places=True)
        g, _ = w.shingles(k)
        self.g, first = np.unique(g, return_index=True)
        self.words = [spelt(w, i, k) for i in first.tolist()]

    def share(self, w: Words, g: np.ndarray, of: np.ndarray, doc: int, k: int) -> float:
        """The share of the shingles that are in one of the texts of ``w``, whose shingles are ``g``."""
        own = g[of[doc] : of[doc + 1]]
        at = np.minimum(np.searchsorted(self.g, own), len(self.g) - 1)
        found = np.flatnonzero(self.g[at] == own)
        hit, first = np.unique(at[found], return_index=True)
        # Shingles begin at each word of a text, so their places are words' places.
        return sum(self.words[i] == spelt(w, int(w.of[doc] + found[j]), k, doc) for i, j in zip(hit.tolist(), first.tolist(), strict=True)) / len(self.g)


def spelt(w: Words, at: int, k: int, doc: int = 0) -> tuple[bytes, ...]:
    return tuple(w.data[w.start[i] : w.end[i]].tobytes() for i in range(at, min(at + k, int(w.of[doc + 1]))))


def _searched(docs: DataFrame, known: list, k: int, threshold: float, sketch: int) -> DataFrame:
    spark = docs.sparkSession
    hashes = np.concatenate([np.zeros(0, np.int64), *(np.array(r["hashes"], np.int64) for r in known)]).view(np.uint64)
    whose = np.repeat(np.arange(len(known)), [len(r["hashes"]) for r in known])
    order = np.argsort(hashes, kind="stable")
    hashes, whose = hashes[order], whose[order]
    needs = np.array([r["needs"] for r in known], np.int64)
    fits = np.array([math.ceil(threshold * 2 ** int(math.log2(r["size"])) - 1e-9) for r in known], np.int64)
    sent = spark.sparkContext.broadcast((hashes, whose, needs, fits, [(r["item_id"], r["text"]) for r in known]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, whose, needs, fits, items = sent.value
        bits = min(24, max(10, len(hashes).bit_length() + 4))
        maybe = np.zeros(1 << bits, bool)
        maybe[(hashes >> np.uint64(64 - bits)).astype(np.int64)] = True
        made: dict[int, Item] = {}
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column("text"), places=True)
                g, of = w.shingles(k)
                at = np.flatnonzero(maybe[(g >> np.uint64(64 - bits)).astype(np.int64)])
                low, high = np.searchsorted(hashes, g[at], "left"), np.searchsorted(hashes, g[at], "right")
                some = high > low
                at, low, high = at[some], low[some], high[some]
                if not len(at):
                    continue
                doc = np.searchsorted(of, at, "right") - 1
                n = high - low
                place = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                hits = np.unique(np.repeat(doc, n) * len(hashes) + place)
                pair, count = np.unique(hits // len(hashes) * len(items) + whose[hits % len(hashes)], return_counts=True)
                doc, item = pair // len(items), pair % len(items)
                rows = []
                for j in np.flatnonzero((count >= needs[item]) & (np.diff(of)[doc] >= fits[item])):
                    d, i = int(doc[j]), int(item[j])
                    if i not in made:
                        made[i] = Item(items[i][1], k)
                    if (c := made[i].share(w, g, of, d, k)) >= threshold:
                        rows.append((part.column("doc_id")[d].as_py(), items[i][0], c))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["doc_id", "item_id", "containment"])

    return docs.mapInArrow(search, OUT)


def _joined(docs: DataFrame, known: DataFrame, k: int, threshold: float, sketch: int) -> DataFrame:
    from .dedup import shingle_lists

    # Items are named by their id and a digest of their text, which alone goes through the count of the hits.
    known = known.withColumn("digest", F.md5("text"))
    keys = known.select("item_id", "digest", "size", "needs", F.explode("hashes").alias("h"))
    # Of a document that can hold no item of a partition, that partition's hits can't count: the size bound follows the counts.
    hits = shingle_lists(docs, k).select("doc_id", F.size("shingles").alias("n"), F.explode("shingles").alias("h")).join(keys, "h").groupBy("doc_id", "n", "item_id", "digest", "size", "needs").agg(F.count("*").alias("hits"))
    pairs = hits.where((F.col("hits") >= F.col("needs")) & (F.col("n") >= threshold * F.pow(F.lit(2.0), F.floor(F.log2("size"))) - 1e-9)).select("doc_id", "item_id", "digest").distinct()
    both = pairs.join(known.select("item_id", "digest", F.col("text").alias("item")), ["item_id", "digest"]).join(docs, "doc_id").select("doc_id", "item_id", "item", "text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = []
            for item, text in zip(batch.column("item"), batch.column("text"), strict=True):
                w = Words(pa.array([text]), places=True)
                c.append(Item(item.as_py(), k).share(w, *w.shingles(k), 0, k))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("item_id"), pa.array(c, pa.float64())], ["doc_id", "item_id", "containment"])

    return both.mapInArrow(verify, OUT).where(F.col("containment") >= threshold)


def found(docs: DataFrame, items: DataFrame, k: int = K, threshold: float = THRESHOLD, sketch: int = SKETCH, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """As ``leaks``, with the ``document_id`` of each document."""
    known = sketches(items, k, sketch, threshold)
    size = known.agg(F.sum(F.size("hashes")).alias("hashes"), F.sum(F.length("text")).alias("chars")).first()
    docs = docs.where("text IS NOT NULL").select(document_id().alias("doc_id"), F.col("text").cast("string").alias("text"))
    if (size["hashes"] or 0) <= broadcast_hashes and (size["chars"] or 0) <= BROADCAST_CHARS:
        out = _searched(docs, known.orderBy("item_id", "text").collect(), k, threshold, sketch)
    else:
        out = _joined(docs, known, k, threshold, sketch)
    return out.groupBy("doc_id", "item_id").agg(F.round(F.max("containment"), 6).alias("containment"))


def leaks(docs: DataFrame, items: DataFrame, **parameters) -> DataFrame:
    """(doc_id, item_id, containment): each document with each item of whose shingles it holds the share ``threshold`` or more."""
    given = F.when(F.col("doc_id") >= -(1 << 62), F.col("doc_id"))
    return found(docs, items, **parameters).groupBy(given.alias("doc_id"), "item_id").agg(F.max("containment").alias("containment"))


def decontaminated(docs: DataFrame, items: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that hold no item; rows that share a doc_id are one document."""
    return minus(docs, found(docs, items, **parameters).select("doc_id").distinct())


_SHINGLES = f"""SELECT {{id}}, unnest(CASE WHEN len(w) >= {K} THEN list_transform(range(1, len(w) - {K - 2}), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM (SELECT {{id}}, {WORDS_SQL} AS w FROM {{table}} WHERE text IS NOT NULL)"""
SQL = f"""WITH d AS (SELECT DISTINCT doc_id, s FROM ({_SHINGLES.format(id="doc_id", table="documents")})),
i AS (SELECT DISTINCT item_id, s FROM ({_SHINGLES.format(id="item_id", table="benchmark")})),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id)
SELECT doc_id, item_id, round(count(*) / any_value(n), 6) AS containment
FROM d JOIN i USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) / any_value(n) >= {THRESHOLD}"""
