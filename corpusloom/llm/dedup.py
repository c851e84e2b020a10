"""Operator 1: near-duplicate groups by MinHash with tensored banding.

Banding with L tables of keys of 2r hashes each would need 2rL minhashes a document.  Here two collections of m half
keys (r minhashes each) are computed, and the m * m table keys are their pairs, so 2rm minhashes serve m * m tables:
about the square root.  Two documents share a table when they share a half key of either collection, which for
similarity s has probability (1 - (1 - s^r)^m)^2.

Plan.  One pass over the texts makes, per document, two fingerprints of its shingles and the half keys.  Documents
with equal fingerprints are copies; one of each set goes on (a grouped minimum, combined before the shuffle, so a text
that occurs a billion times is no hot key).  The table keys are exploded in the JVM and sorted by ranges.  In a bucket of up
to ``NEAR`` + 1 documents all pairs are candidates; in a larger one a document is first a candidate with the bucket's first
document and with its ``NEAR`` predecessors in the order of one more minhash.  Each candidate pair is verified by the exact
Jaccard similarity of the shingle sets.  Groups are the connected components of the verified pairs.

The pairs that this leaves in larger buckets matter where they join groups.  So the documents of the larger buckets that
hold more than one group are joined exactly: shingles are put in one order, the rarest first, and two documents at
the threshold have their first common shingle in the first n - ceil(threshold * n) + 1 of either, with enough shingles
after it in both (prefix and position filter).  A passage that thousands share stands at the end of that order, so it
makes no candidates by itself; nothing at the threshold is lost.  Shingles within one group are left out of the join.

Defined results: a null text, or one without any word, is in no group.  ``near_duplicates`` leaves rows out whose doc_id
is null or no number; ``without_near_duplicates`` takes such a row as a document named by its text, so copies of it go too.
Rows that share a doc_id are one document with the shingles of each row; they make no pair with themselves, and of rows
that are equal in all columns one stays.  Fewer than ``k`` words make one shingle.  Extra columns are ignored.  An empty
table has no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, document_id, minus, with_ids, written
from .textkit import Words, mix, reduced, signed, slices

K, THRESHOLD, TABLES_SIDE, ROWS = 3, 0.55, 12, 2
#: Up to so many candidate documents are sent to the tasks as a list of 8 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 4_000_000
#: Predecessors in a bucket that a document is paired with; buckets with more documents before one are joined exactly.
NEAR = 16
#: Counters of shingles by the top bits of their hash; they only order the shingles, so a shared counter costs no pair.
_BITS = 20
_SEED = 20


def signatures(docs: DataFrame, k: int = K, side: int = TABLES_SIDE, rows: int = ROWS) -> DataFrame:
    """(doc_id, fp, fq, place, u, v): two fingerprints, a minhash for order, and the two collections of half keys."""
    random = np.random.default_rng(_SEED)
    factors = random.integers(0, 1 << 63, 2 * side * rows + 1, np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = random.integers(0, 1 << 63, len(factors), np.uint64)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                g, of = Words(part.column("text")).shingles(k)
                some = np.flatnonzero((np.diff(of) > 0) & part.column("doc_id").is_valid().to_numpy(zero_copy_only=False))
                least = [mix(reduced(g * a + b, of, np.minimum)[some]) for a, b in zip(factors, shifts, strict=True)]
                halves = []
                for j in range(0, len(least) - 1, rows):
                    key = np.zeros(len(some), np.uint64)
                    for x in least[j : j + rows]:
                        key = mix(key * factors[0] + x)
                    halves.append(key)
                lists = [
                    pa.ListArray.from_arrays(np.arange(0, len(some) * side + 1, side, dtype=np.int32), signed(np.stack(halves[a : a + side], 1).ravel()))
                    for a in (0, side)
                ]
                prints = [signed(reduced(mix(g ^ x), of, np.add)[some]) for x in factors[:2]]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(some)).cast(pa.int64()), *map(pa.array, prints), pa.array(signed(least[-1])), *lists], ["doc_id", "fp", "fq", "place", "u", "v"]
                )

    return docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        make, "doc_id long, fp long, fq long, place long, u array<long>, v array<long>"
    )


def shingle_lists(docs: DataFrame, k: int = K, only: np.ndarray | None = None) -> DataFrame:
    """(doc_id, shingles): the distinct shingle hashes; ``only``: the sorted doc_ids to make them for."""
    kept = docs.sparkSession.sparkContext.broadcast(only) if only is not None else None

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            if kept is not None:
                ids = batch.column("doc_id").to_numpy()
                at = np.searchsorted(kept.value, ids)
                at[at == len(kept.value)] = 0
                batch = batch.filter(pa.array(kept.value[at] == ids if len(kept.value) else np.zeros(len(ids), bool)))
            for part in slices(batch):
                g, of = Words(part.column("text")).shingles(k)
                whose = np.repeat(np.arange(len(of) - 1), np.diff(of))
                order = np.lexsort((g, whose))
                g, whose = g[order], whose[order]
                new = np.ones(len(g), bool)
                new[1:] = (g[1:] != g[:-1]) | (whose[1:] != whose[:-1])
                of = np.concatenate([[0], np.cumsum(np.bincount(whose[new], minlength=part.num_rows))])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(of.astype(np.int32), signed(g[new]))], ["doc_id", "shingles"])

    return docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(make, "doc_id long, shingles array<long>")


def bucketed(reps: DataFrame) -> DataFrame:
    """(kind, x, y): candidate pairs of documents (kind 0), and the documents y of each bucket x of over NEAR + 1 (kind 1).

    The table keys are sorted over all tasks by ranges of (key, place, doc_id), so a bucket that a third of the documents
    are in lies across as many tasks as it fills.  Each task pairs a document with up to NEAR before it in its bucket and
    with the bucket's first.  A task's first and last bucket may go on elsewhere: their first and last rows (kind 2) are
    paired by a second, small step, and they count as over NEAR + 1.
    """
    keyed = reps.select("doc_id", "place", "v", F.posexplode("u").alias("i", "x")).select("doc_id", "place", "i", "x", F.posexplode("v").alias("j", "y")).select(F.xxhash64("i", "j", "x", "y").alias("key"), "place", "doc_id")
    ordered = keyed.repartitionByRange("key", "place", "doc_id").sortWithinPartitions("key", "place", "doc_id").select("key", "doc_id")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        # Of the bucket that is open: its key, rows so far, first document, last NEAR + 1 documents, and those not yet known to be in a large one.
        open_key, count, lead, tail, waiting, leading = None, 0, 0, none, none, True
        for batch in batches:
            key, doc = batch.column("key").to_numpy(), batch.column("doc_id").to_numpy()
            if not len(key):
                continue
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(start, len(key)))
            goes_on = key[0] == open_key
            had = count if goes_on else 0
            if not goes_on:
                leading = leading and open_key is None
                tail = waiting = none
            run = np.repeat(np.arange(len(start)), size)
            rank = np.arange(len(key)) - start[run]
            rank[: size[0]] += had
            first = doc[start]
            if goes_on:
                first[0] = lead
            ext, a, b = np.concatenate([tail, doc]), [], []
            for d in range(1, NEAR + 1):
                at = np.flatnonzero(rank >= d)
                if not len(at):
                    break
                a.append(doc[at])
                b.append(ext[at + len(tail) - d])
            far = np.flatnonzero(rank > NEAR)
            a, b = np.concatenate([none, *a, doc[far]]), np.concatenate([none, *b, first[run[far]]])
            other = a != b
            out = [(0, np.minimum(a, b)[other], np.maximum(a, b)[other])]
            total = size.copy()
            total[0] += had
            large = total > NEAR + 1
            large[0] |= leading
            if large[0] and len(waiting):
                out.append((1, np.full(len(waiting), key[0]), waiting))
                waiting = none
            inside = large[run]
            out.append((1, key[inside], doc[inside]))
            if leading and had <= NEAR:
                head = slice(0, min(int(size[0]), NEAR + 1 - had))
                out.append((2, key[head], doc[head]))
            last = slice(int(start[-1]), len(key))
            if len(start) > 1:
                leading, tail, waiting = False, none, none
            if not large[-1]:
                waiting = np.concatenate([waiting, doc[last]])
            open_key, count, lead, tail = key[-1], int(total[-1]), int(first[-1]), np.concatenate([tail, doc[last]])[-NEAR - 1 :]
            yield _rows(out)
        if open_key is not None:
            yield _rows([(1, np.full(len(waiting), open_key), waiting), (2, np.full(len(tail), open_key), tail)])

    return ordered.mapInArrow(pair, "kind int, x long, y long")


def _rows(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    kind, x, y = (np.concatenate(c) for c in zip(*((np.full(len(x), k, np.int32), x, y) for k, x, y in parts), strict=True))
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(x), pa.array(y)], ["kind", "x", "y"])


def candidates(buckets: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b: all pairs of a bucket of up to NEAR + 1; in a larger one each document with the first and those before it."""
    ends = buckets.where("kind = 2").select(F.col("x").alias("key"), F.col("y").alias("doc_id")).distinct()
    order = Window.partitionBy("key").orderBy("doc_id")
    known = ends.select("doc_id", F.collect_list("doc_id").over(order.rowsBetween(-NEAR, -1)).alias("before"), F.first("doc_id").over(order).alias("first"))
    across = known.select("doc_id", F.explode(F.array_union("before", F.array("first"))).alias("other")).where("doc_id <> other")
    return buckets.where("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(across.select(F.col("other").alias("a"), F.col("doc_id").alias("b"))).distinct()


def grouped(ids: DataFrame, groups: DataFrame) -> DataFrame:
    """``ids`` with ``root``, the kept_id of the document's group in ``groups``, or itself."""
    return ids.join(groups, "doc_id", "left").withColumn("root", F.coalesce("kept_id", "doc_id")).drop("kept_id")


def crowded(buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, root) of the documents of the buckets of over NEAR + 1 that hold more than one group."""
    large = grouped(buckets.where("kind = 1").select(F.col("x").alias("key"), F.col("y").alias("doc_id")), groups)
    mixed = large.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
    return large.join(mixed, "key", "left_semi").select("doc_id", "root").distinct()


def joined_exactly(lists: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """Distinct (a, b), a < b, of different ``roots``: a superset of the pairs at the threshold among ``lists`` (doc_id, shingles)."""
    bins = lists.select(F.explode("shingles").alias("h")).groupBy(F.shiftrightunsigned("h", 64 - _BITS).alias("bin")).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(1 << _BITS, np.int64)
    counts[bins.column("bin").to_numpy()] = bins.column("n").to_numpy()
    sent = lists.sparkSession.sparkContext.broadcast(counts)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for doc, shingles in zip(batch.column("doc_id").to_pylist(), batch.column("shingles"), strict=True):
                h = shingles.values.to_numpy()
                n = len(h)
                first = h[np.lexsort((h, sent.value[(h.view(np.uint64) >> np.uint64(64 - _BITS)).astype(np.int64)]))][: n - math.ceil(threshold * n - 1e-9) + 1]
                parts.append((np.full(len(first), doc), first, np.full(len(first), n), n - np.arange(len(first))))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["doc_id", "h", "n", "rest"])

    some = lists.where(F.size("shingles") > 0)
    first = written(some.mapInArrow(make, "doc_id long, h long, n long, rest long").join(roots, "doc_id"), "prefixes")
    several = first.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("h")
    first = first.join(several, "h", "left_semi")
    left, right = (first.select("h", *(F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "n", "rest", "root"))) for x in "ab")
    enough = F.least("rest_a", "rest_b") * (1 + threshold) >= threshold * (F.col("n_a") + F.col("n_b")) - 1e-6
    return left.join(right, "h").where((F.col("doc_id_a") < F.col("doc_id_b")) & (F.col("root_a") != F.col("root_b")) & enough).select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, kept_id) for each node of ``edges`` (a, b) but the least of its component, which is kept_id.

    Large-star and small-star steps (Kiveris et al. 2014) until nothing changes; each step is written to the shared
    folder, so a lost executor costs one step at most.
    """
    # Each step reads its edges several times, so they are written before the first one too.
    now = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("w")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("w")))
        least = both.groupBy("u").agg(F.least(F.min("w"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("w > u").select(F.col("w").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w"))
        least = down.groupBy("u").agg(F.min("w").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("w").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        nxt = written(small, "components")
        # Finished when every node has one edge and no edge's end has one of its own: a forest of stars.
        state = nxt.groupBy("a").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"]
        if state is None or (state == 1 and nxt.join(nxt.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()):
            return nxt.select(F.col("a").alias("doc_id"), F.col("b").alias("kept_id"))
        now = nxt


def lists_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """shingle_lists of the documents whose doc_id is in ``ids``."""
    if ids.count() <= BROADCAST_IDS:
        return shingle_lists(docs, k, np.sort(np.concatenate([np.zeros(0, np.int64), *(b.column(0).to_numpy() for b in ids.toArrow().to_batches())])))
    return shingle_lists(docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi"), k)


def verified(docs: DataFrame, pairs: DataFrame, k: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of ``threshold`` or more."""
    lists = lists_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), k)
    left, right = lists.select(F.col("doc_id").alias("a"), F.col("shingles").alias("s")), lists.select(F.col("doc_id").alias("b"), F.col("shingles").alias("t"))
    joined = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("s", "t")))
    return joined.where(F.col("both") >= threshold * (F.size("s") + F.size("t") - F.col("both"))).select("a", "b")


def near_duplicates(docs: DataFrame, k: int = K, threshold: float = THRESHOLD, side: int = TABLES_SIDE, rows: int = ROWS) -> DataFrame:
    """(doc_id, kept_id): each document that is a copy or near copy, and the least doc_id of its group, which stays."""
    made = written(signatures(docs, k, side, rows), "signatures")
    ident = ["fp", "fq"]
    first = made.groupBy(*ident).agg(F.min("doc_id").alias("least"))
    copies = made.select("doc_id", *ident).join(first, ident).where("doc_id <> least").select(F.col("least").alias("a"), F.col("doc_id").alias("b"))
    reps = made.join(first.select(F.col("least").alias("doc_id"), *ident), ["doc_id", *ident], "left_semi")
    buckets = written(bucketed(reps), "buckets")
    groups = components(verified(docs, written(candidates(buckets), "candidates"), k, threshold).unionByName(copies))
    rest = written(crowded(buckets, groups), "crowded")
    if rest.isEmpty():
        return groups
    lists = written(lists_of(docs, rest.select("doc_id").distinct(), k), "crowded-shingles")
    more = verified(docs, written(joined_exactly(lists, rest, threshold), "candidates"), k, threshold)
    return components(more.unionByName(groups.select(F.col("kept_id").alias("a"), F.col("doc_id").alias("b"))))


def without_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` whose document is in no group or the least of its group; of equal rows one."""
    kept = minus(docs, near_duplicates(with_ids(docs), **parameters).select("doc_id"))
    again = written(docs.groupBy(document_id().alias("_again")).agg(F.count("*").alias("n")).where("n > 1").select("_again"), "repeated")
    many = again.count()
    if not many:
        return kept
    again = F.broadcast(again) if many <= BROADCAST_ROWS else again
    mine = document_id() == again["_again"]
    return kept.join(again, mine, "left_anti").unionByName(kept.join(again, mine, "left_semi").dropDuplicates())
