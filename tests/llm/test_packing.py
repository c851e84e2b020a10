import collections

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import packing

from .cases import ODD, docs


def brute(lengths, capacity):
    rooms, out = [], []
    for n in lengths:
        fits = [(room, k) for k, room in enumerate(rooms) if room >= n]
        k = min(fits)[1] if fits else len(rooms)
        if not fits:
            rooms.append(capacity)
        rooms[k] -= n
        out.append(k)
    return out, rooms


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit(lengths):
    got, (want, rooms) = packing.best_fit(lengths, 50), brute(lengths, 50)
    left = collections.Counter()
    for n, b in zip(lengths, got):
        left[b] += n
    # Among bins of equal room another may be taken; rooms and number are the same.
    assert sorted(left.values()) == sorted(50 - r for r in rooms) and len(want) == len(got)


@pytest.mark.parametrize("group", [20, 300, 100_000])
def test_every_piece_once(spark, group):
    rows = [(i, "é" * (i * 7919 % 400) + "x" * (i % 5)) for i in range(1500)]
    bins = packing.pack(docs(spark, rows), capacity=256, group=group).collect()
    got = collections.defaultdict(list)
    for b in bins:
        assert b["fill"] == sum(b["lengths"]) <= 256
        for piece in zip(b["doc_ids"], b["starts"], b["lengths"]):
            got[piece[0]].append(piece[1:])
    for i, text in rows:
        at = 0
        for start, n in sorted(got[i]):
            assert start == at
            at += n
        assert at == len(text.encode())
    least = sum(len(t.encode()) for _, t in rows) / 256
    assert len(bins) <= least * (1.12 if group == 20 else 1.03)


def test_one_group_is_best_fit_decreasing(spark):
    rows = [(i, "x" * (i * 37 % 99 + 1)) for i in range(200)]
    bins = packing.pack(docs(spark, rows), capacity=100).collect()
    _, rooms = brute(sorted((len(t) for _, t in rows if len(t) < 100), reverse=True), 100)
    assert len(bins) == len(rooms) + sum(len(t) == 100 for _, t in rows)


def test_same_result_from_other_partitions(spark):
    rows = [(i, "x" * (i * 7919 % 300 + 1)) for i in range(400)]
    key = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert key(packing.pack(docs(spark, rows), 256, group=50)) == key(packing.pack(docs(spark, rows[::-1]).repartition(7), 256, group=50))


def test_odd_rows(spark):
    rows = [*ODD, *ODD]
    bins = packing.pack(docs(spark, rows, extra=True), capacity=1000).collect()
    total = collections.Counter()
    for b in bins:
        for d, n in zip(b["doc_ids"], b["lengths"]):
            total[d] += n
    want = collections.Counter()
    for d, t in rows:
        if t:
            want[d] += len(t.encode())
    assert total == want
    assert packing.pack(docs(spark, [])).collect() == []
    assert packing.pack(docs(spark, [(1, "")])).collect() == []


def test_lengths_that_never_fit_together(spark):
    """All over half a bin: no round saves anything, and still every group's bins come out, however many groups there are."""
    rows = [(i, "x" * (600 + i % 7)) for i in range(3000)]
    bins = packing.pack(docs(spark, rows), capacity=1000, group=20).collect()
    assert len(bins) == 3000 and {b["doc_ids"][0] for b in bins} == set(range(3000))


def test_later_rounds_fill_what_groups_leave(spark):
    """Groups of one kind of length each; only merged groups can put a long and a short piece together."""
    rows = [(i, "x" * (700 if i % 2 else 300)) for i in range(2000)]
    bins = packing.pack(docs(spark, rows), capacity=1000, group=10).collect()
    assert sum(b["fill"] for b in bins) == 1_000_000 and len(bins) <= 1.15 * 1000


def test_other_lengths(spark):
    bins = packing.pack(docs(spark, [(1, "a b c"), (2, "d e")]), capacity=4, length=F.size(F.split("text", " "))).collect()
    assert sorted((b["doc_ids"], b["fill"]) for b in bins) == [([1], 3), ([2], 2)]
