import collections

import numpy as np
import xxhash

from corpusloom.llm import sharding

from .cases import ODD, docs


def brute(keys, shards, vnodes, eps):
    """Key by key, by the rule in words: round by round, points in ring order, least (hash, key) of each arc first."""
    points, owner = sharding.ring(list(range(shards)), vnodes)
    capacity = -int(-(1 + eps) * len(keys) // shards)
    load, at, arc = collections.Counter(), {}, {}
    for k in keys:
        h = np.uint64(xxhash.xxh64_intdigest(int(k).to_bytes(8, "little", signed=True), 42)).astype(np.int64)
        arc[k] = int(np.searchsorted(points, h)) % len(points)
        at[k] = (arc[k], int(h))
    home = {k: int(owner[arc[k]]) for k in keys}
    out, waiting = {}, {k: arc[k] for k in keys}
    while waiting:
        for k, point in sorted(waiting.items(), key=lambda x: (x[1], arc[x[0]], at[x[0]][1], x[0])):
            shard = int(owner[point])
            if load[shard] < capacity:
                load[shard] += 1
                out[k] = shard
                del waiting[k]
            else:
                waiting[k] = (point + 1) % len(points)
    return {(k, out[k], home[k]) for k in keys}


def test_against_brute_force(spark):
    keys = [k * 37 - 500 for k in range(700)]
    for shards, vnodes, eps in ((8, 4, 0.02), (5, 16, 0.25), (3, 1, 0.0)):
        got = sharding.assign(docs(spark, [(k, "t") for k in keys]), shards, vnodes, eps).collect()
        assert {tuple(r) for r in got} == brute(keys, shards, vnodes, eps) and len(got) == len(keys)


def test_balance_and_limited_movement(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    ten = {r["doc_id"]: r["shard"] for r in sharding.assign(df, 10).collect()}
    assert max(collections.Counter(ten.values()).values()) <= 1.05 * 2000 + 1
    eleven = {r["doc_id"]: r["shard"] for r in sharding.assign(df, 11).collect()}
    assert sum(ten[k] != eleven[k] for k in ten) < 0.35 * len(ten)  # a plain hash modulo would move nine tenths


def test_odd_rows(spark):
    rows = [*ODD, *ODD, *[(None, "n")] * 50, *[(7, "same")] * 50]
    got = sharding.assign(docs(spark, rows, extra=True), 6, 8)
    assert got.columns == ["doc_id", "shard", "home"]
    rows_out = got.collect()
    assert len(rows_out) == len(rows)
    assert max(collections.Counter(r["shard"] for r in rows_out).values()) <= -int(-1.05 * len(rows) // 6)
    assert sharding.assign(docs(spark, [])).collect() == []
    assert [r["shard"] for r in sharding.assign(docs(spark, [(1, "a")]), 1).collect()] == [0]


def test_a_hot_key_is_split_by_number(spark):
    """One key has two thirds of the rows: its rows go to several shards, each filled to its bound, and no other row is lost."""
    df = spark.range(1000).selectExpr("id + 10 AS doc_id").unionByName(spark.range(2000).selectExpr("CAST(NULL AS BIGINT) AS doc_id"))
    rows = sharding.assign(df, 6, 16).collect()
    assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter([None] * 2000 + list(range(10, 1010)))
    load = collections.Counter(r["shard"] for r in rows)
    assert max(load.values()) <= -int(-1.05 * 3000 // 6) and len({r["shard"] for r in rows if r["doc_id"] is None}) >= 4
    assert {tuple(r) for r in rows} == {tuple(r) for r in sharding.assign(df.repartition(5), 6, 16).collect()}


def test_runs_of_a_key(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 7)
    rows = sharding.assign(spark.range(100).selectExpr("CAST(id % 3 AS STRING) AS doc_id"), 4, 8).collect()
    assert collections.Counter(r["doc_id"] for r in rows) == {"0": 34, "1": 33, "2": 33}
    assert max(collections.Counter(r["shard"] for r in rows).values()) <= 27
