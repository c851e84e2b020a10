"""Operator 6: best-fit packing by hierarchical residual packing.

A document is a string of ``length`` units (UTF-8 bytes by default, for byte-level sequences; any integer column, such
as a token count, can be named).  Whole pieces of ``capacity`` units are bins of their own; what remains of each
document is an item.  Items go to groups of about ``GROUP`` by a hash of the doc_id; each group is packed by best fit
in decreasing order of length.  Bins filled to ``FULL`` or more are emitted; the underfull ones become items of the next
round, in which ``FAN`` neighbouring groups are merged, until one group has been packed.

After best fit in decreasing order all bins of a group but one are over half full, so what later rounds can still put
together is little, and a group's fullest underfull bins are the least likely to take anything.  Of these a group hands
on the ``GROUP / FAN * 2`` emptiest at most and emits the rest, so a task holds at most about two groups' items in any round,
whatever the lengths are, and the number of rounds is the logarithm of the number of groups.  That bound costs fullness only:
every piece is in exactly one bin.

Plan.  The lengths are taken in the JVM and written (12 bytes a document); texts aren't shuffled.  Each round's result is
written to the shared folder.  A bin is a row with its pieces in order.

Defined results: null and empty texts have no piece.  A doc_id that is null or no number is null in the pieces.  Repeated rows
are documents of their own.  Equal lengths go by doc_id, then by start.  Extra columns are ignored.  An empty table has no
bins.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

CAPACITY, FULL, GROUP, FAN = 8192, 0.995, 20_000, 8
PIECE = "struct<doc_id:long,start:long,length:int>"
_PIECE = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32())])


def best_fit(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each length, taken in the given order: the fullest bin that it fits, the oldest of equals, or a new one."""
    rooms: dict[int, deque[int]] = {}
    open_rooms = 0  # bit r: there is a bin with room r
    out, bins = [], 0
    for n in lengths:
        fits = open_rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            have = rooms[room]
            b = have.pop()
            if not have:
                open_rooms ^= 1 << room
        else:
            room, b, bins = capacity, bins, bins + 1
        if left := room - n:
            have = rooms.setdefault(left, deque())
            if not have:
                open_rooms |= 1 << left
            # The oldest bin is at the end; one that comes to this room later goes before those that are there.
            have.appendleft(b)
        out.append(b)
    return out


def _round(items: DataFrame, capacity: int, most: int) -> DataFrame:
    """(g, pieces, fill, open): the bins of each group's items (g, pieces, fill); the ``most`` emptiest under FULL are open."""

    def pack(table: pa.Table) -> pa.Table:
        fill = table["fill"].to_numpy()
        pieces = table["pieces"].combine_chunks()
        flat, of = pieces.flatten(), pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        first = flat.take(pa.array(of[:-1]))
        doc = first.field("doc_id")
        order = np.lexsort((first.field("start").to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy(zero_copy_only=False), doc.is_null().to_numpy(zero_copy_only=False), -fill))
        b = np.array(best_fit(fill[order].tolist(), capacity), np.int64)
        by_bin = np.argsort(b, kind="stable")
        order = order[by_bin]
        n = np.diff(of)[order]
        place = np.repeat(of[:-1][order] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        per = np.bincount(b[by_bin], weights=n).astype(np.int64)
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(per)]).astype(np.int32), flat.take(pa.array(place)))
        total = np.bincount(b[by_bin], weights=fill[order]).astype(np.int32)
        still = np.zeros(len(per), bool)
        still[np.argsort(total, kind="stable")[:most]] = True
        return pa.table({"g": pa.array(np.full(len(per), table["g"][0].as_py(), np.int64)), "pieces": lists, "fill": pa.array(total), "open": pa.array(still & (total < FULL * capacity))})

    return items.groupBy("g").applyInArrow(pack, f"g long, pieces array<{PIECE}>, fill int, open boolean")


def pack(docs: DataFrame, capacity: int = CAPACITY, length: Column | None = None, group: int = GROUP) -> DataFrame:
    """(doc_ids, starts, lengths, fill): one row a bin, with the documents' pieces in order."""
    length = F.octet_length(F.col("text").cast("string")) if length is None else length
    known = written(docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), length.cast("long").alias("n")).where("n > 0"), "lengths")
    piece = lambda start, n: F.struct(F.col("doc_id"), start.cast("long").alias("start"), n.cast("int").alias("length"))
    whole = known.where(F.col("n") >= capacity).select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("n") / capacity).cast("long") - 1)).alias("k"))
    bins = [whole.select(F.array(piece(F.col("k") * capacity, F.lit(capacity))).alias("pieces"), F.lit(capacity).alias("fill"))]
    rest = F.col("n") % capacity
    groups = max(1, -(-known.count() // group))
    items = known.where(rest > 0).select(F.pmod(F.xxhash64("doc_id", "n"), F.lit(groups)).alias("g"), F.array(piece(F.col("n") - rest, rest)).alias("pieces"), rest.cast("int").alias("fill"))
    while True:
        done = written(_round(items, capacity, max(1, 2 * group // FAN)), "bins")
        if groups == 1:
            bins.append(done.select("pieces", "fill"))
            break
        bins.append(done.where("NOT open").select("pieces", "fill"))
        merged = -(-groups // FAN)
        items = done.where("open").select(F.floor(F.col("g") * merged / groups).alias("g"), "pieces", "fill")
        groups = merged
    out = bins[0]
    for b in bins[1:]:
        out = out.unionByName(b)
    return out.select(F.col("pieces.doc_id").alias("doc_ids"), F.col("pieces.start").alias("starts"), F.col("pieces.length").alias("lengths"), "fill")
