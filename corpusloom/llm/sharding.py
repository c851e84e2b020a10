"""Operator 5: sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard has ``VNODES`` points on the ring of 64-bit hashes; a key belongs to the arc that ends at the next point at
or after its hash, and asks that point's shard.  No shard takes more than ceil((1 + EPS) * keys / shards).  Keys that a
full shard can't take go on clockwise to the next point, round by round: in a round the points are served in ring order,
and of the keys of one arc those of least (hash, key) first; a key once taken stays.  So a key only moves past full
shards, and a new shard takes keys from its neighbours on the ring, not from everywhere.

Plan.  Only the key column is read.  The keys are counted by arc; the rounds are played on the counts of the arcs on the
driver (shards * VNODES numbers, whatever the input).  Arcs that go to one shard whole need no order.  Of arcs that are
split, the rows of each key are counted (combined before the shuffle), the keys are ranked by the sum of the counts before
them, within ranges of the hash, and a key's rows are written out again in runs of ``RUN``, spread over the tasks.  So
neither a long arc nor a key that a third of all rows have is one task's.

Defined results: a null key hashes like any key, to one place.  Repeated rows are keys of their own; as they are alike, it is
their number that is split between shards.  A key may have any type with an order.  Extra columns are ignored.  An empty
table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS, VNODES, EPS = 64, 128, 0.05
#: Pieces of arcs that are broadcast at most; it follows from the ring's size, not from the data.
BROADCAST_PIECES = 1_000_000
#: Top bits of the hash that name a range, and rows of one key that are written out by one step.
_BITS, RUN = 20, 1 << 16


def ring(shards: list[int], vnodes: int = VNODES) -> tuple[np.ndarray, np.ndarray]:
    """The points in ring order, and the shard of each."""
    points = [(np.uint64(xxhash.xxh64_intdigest(f"{s}#{v}", 42)).astype(np.int64), s) for s in shards for v in range(vnodes)]
    points.sort()
    return np.array([p for p, _ in points], np.int64), np.array([s for _, s in points], np.int64)


def placed(counts: dict[int, int], owner: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """(arc, from, to, shard): the keys of each arc by rank, from <= rank < to, and where they go."""
    room = {int(s): capacity for s in np.unique(owner)}
    pending = [(arc, arc, 0, n) for arc, n in sorted(counts.items())]
    out = []
    while pending:
        later = []
        for point, arc, low, high in pending:
            shard = int(owner[point])
            if take := min(room[shard], high - low):
                room[shard] -= take
                out.append((arc, low, low + take, shard))
                low += take
            if low < high:
                later.append(((point + 1) % len(owner), arc, low, high))
        pending = sorted(later)
    return out


def assign(docs: DataFrame, shards: int | list[int] = SHARDS, vnodes: int = VNODES, eps: float = EPS, key: str = "doc_id") -> DataFrame:
    """(key, shard, home): the shard of each key, and the one that it asked first."""
    points, owner = ring(list(range(shards)) if isinstance(shards, int) else shards, vnodes)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(points)

    def arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(sent.value, batch.column("h").to_numpy()) % len(sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("h"), pa.array(at.astype(np.int32))], ["key", "h", "arc"])

    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    keys = docs.select(F.col(key).alias("key")).withColumn("h", F.xxhash64("key")).mapInArrow(arcs, f"key {kind}, h long, arc int")
    counts = {r["arc"]: r["n"] for r in keys.groupBy("arc").agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    pieces = placed(counts, owner, -int(-(1 + eps) * n // len(np.unique(owner))) if n else 0)
    table = spark.createDataFrame([(a, low, high, s, int(owner[a]), low == 0 and high == counts[a]) for a, low, high, s in pieces], "arc int, low long, high long, shard long, home long, whole boolean")
    small = (lambda x: F.broadcast(x)) if len(pieces) <= BROADCAST_PIECES else (lambda x: x)
    whole = keys.join(small(table.where("whole")), "arc").select("key", "shard", "home")
    split = table.where("NOT whole")
    each = keys.join(small(split.select("arc").distinct()), "arc", "left_semi").groupBy("arc", "h", "key").agg(F.count("*").alias("n")).withColumn("range", F.shiftright("h", 64 - _BITS))
    ranges = each.groupBy("arc", "range").agg(F.sum("n").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy("arc").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = Window.partitionBy("arc", "range").orderBy("h", F.col("key").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = each.withColumn("earlier", F.coalesce(F.sum("n").over(within), F.lit(0))).join(ranges, ["arc", "range"]).withColumn("from", F.col("start") + F.col("earlier"))
    rows = F.least("high", F.col("from") + F.col("n")) - F.greatest("low", "from")
    parted = ranked.join(small(split), (ranked["arc"] == split["arc"]) & (F.col("from") < F.col("high")) & (F.col("from") + F.col("n") > F.col("low"))).select("key", "shard", "home", rows.alias("rows"))
    runs = parted.select("key", "shard", "home", "rows", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / RUN))).alias("run")).repartition("key", "run")
    out = runs.select("key", "shard", "home", F.explode(F.array_repeat(F.lit(0), F.least(F.lit(RUN), F.col("rows") - F.col("run") * RUN).cast("int"))).alias("_")).drop("_")
    return whole.unionByName(out).withColumnRenamed("key", key)
