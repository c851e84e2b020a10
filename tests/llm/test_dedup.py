import collections
import random

from corpusloom.llm import dedup
from corpusloom.llm.textkit import shingle_set

from .cases import ODD, docs, edited, prose


def brute(rows, threshold=dedup.THRESHOLD):
    """(doc_id, kept_id) by comparing all pairs."""
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None and t is not None and shingle_set(t)]
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    pairs = []
    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if i != j and (both := len(s & t)) >= threshold * (len(s) + len(t) - both):
                pairs.append((i, j))
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {(i, top(i)) for i in up if top(i) != i}, pairs


def test_against_brute_force(spark):
    rows, r = [], random.Random(1)
    for g in range(60):
        text = prose(g, r.choice([8, 40, 150, 600]))
        rows += [(len(rows) * 7 % 1000 + g * 1000 + k, text if k % 3 == 0 else edited(text, g * 100 + k)) for k in range(r.choice([1, 1, 2, 3, 12]))]
    shared = prose("passage", 60)
    rows += [(100_000 + k, prose(f"own{k}", 200) + " " + shared) for k in range(40)]
    r.shuffle(rows)
    expected, pairs = brute(rows)
    got = {tuple(x) for x in dedup.near_duplicates(docs(spark, rows)).collect()}
    to = dict(got)
    assert sum(to.get(a, a) == to.get(b, b) for a, b in pairs) >= 0.97 * len(pairs)
    # A group that lacks a link may fall in two, so one document may have another kept_id, but never one outside its group.
    of = dict(expected)
    assert all(of.get(i, i) == of.get(j, j) for i, j in got)
    assert len(got & expected) >= 0.95 * len(expected)
    assert not {i for i, _ in got} & set(range(100_000, 100_040))


def test_large_group_and_ties(spark):
    text = prose("hot", 80)
    rows = [(i, text if i % 2 else edited(text, i, 0.02)) for i in range(1500)]
    got = dict(map(tuple, dedup.near_duplicates(docs(spark, rows)).collect()))
    assert len(got) >= 0.97 * 1499 and set(got.values()) == {0}


def test_odd_rows(spark):
    rows = [*ODD, (1, prose(1, 50)), (1, prose(1, 50)), (2, prose(1, 50)), (3, "x"), (908, "*** %%% !!!")]
    got = {tuple(x) for x in dedup.near_duplicates(docs(spark, rows, extra=True)).collect()}
    assert got == {(2, 1), (903, 3)}
    kept = dedup.without_near_duplicates(docs(spark, rows, extra=True))
    assert kept.columns == docs(spark, rows, extra=True).columns
    # Of the two equal rows 1 one stays, of the texts of 2 and 3 none.
    assert kept.count() == len(rows) - 3
    text = prose(8, 50)
    rows = [(None, text), (None, text), (None, edited(text, 1)), (5, prose(9, 50)), (None, prose(9, 50)), (None, "Another text"), (6, None), (6, None), (7, "")]
    left = [tuple(r)[:2] for r in dedup.without_near_duplicates(docs(spark, rows, extra=True)).collect()]
    assert len(left) == 5 and len([x for x in left if x[1] and x[1].startswith(text[:9]) or x == (None, edited(text, 1))]) == 1
    assert {(None, "Another text"), (6, None), (7, "")} <= set(left)


def test_empty(spark):
    assert dedup.near_duplicates(docs(spark, [])).collect() == []
    assert dedup.without_near_duplicates(docs(spark, [])).collect() == []


def test_many_candidates_go_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BROADCAST_IDS", 0)
    rows = [(i, edited(prose(i // 2, 100), i)) for i in range(20)]
    assert {tuple(x) for x in dedup.near_duplicates(docs(spark, rows)).collect()} == brute(rows)[0]


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150)]
    random.Random(3).shuffle(edges)
    got = {tuple(x) for x in dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(1, 41)} | {(200, 100), (150, 100)}


def test_pairs_among_thousands_that_share_a_passage(spark):
    """The passage alone is under the threshold; a planted pair has some more in common."""
    passage = prose("passage", 202)
    rows = [(i, passage + " " + prose(f"own{i}", 88)) for i in range(2500)]
    for i in range(0, 200, 2):
        own = prose(f"own{i}", 88).split()
        rows[i + 1] = (i + 1, passage + " " + " ".join(own[:33]) + " " + prose(f"new{i}", 55))
    r = random.Random(5)
    r.shuffle(rows)
    planted = dict(rows)
    for i in (0, 100):
        s, t, u = (shingle_set(planted[j]) for j in (i, i + 1, i + 2))
        assert len(s & t) >= dedup.THRESHOLD * len(s | t) and len(s & u) < dedup.THRESHOLD * len(s | u)
    got = {tuple(x) for x in dedup.near_duplicates(docs(spark, rows)).collect()}
    assert got == {(i + 1, i) for i in range(0, 200, 2)}


def isolated_pairs(n=600):
    """Pairs of a similarity between 0.55 and 0.57, each with words of its own."""
    rows = []
    for i in range(n):
        text = prose(f"pair{i}", 200, 10**6).split()
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text[: 143 + i % 3] + prose(f"rest{i}", 57 - i % 3, 10**6).split()))]
    return rows


def test_isolated_pairs_just_over_the_threshold(spark):
    rows = isolated_pairs()
    got = {tuple(x) for x in dedup.near_duplicates(docs(spark, rows)).collect()}
    assert got <= {(i + 1, i) for i in range(0, len(rows), 2)} and len(got) >= 0.95 * len(rows) / 2


def test_buckets_against_all_pairs(spark):
    """Buckets of all sizes over many tasks: every pair of a small one, and every document of a large one linked and told."""
    r, rows = random.Random(2), []
    sizes = [1, 2, 3, 16, 17, 18, 40, 500] * 2 + [3000]
    for g, n in enumerate(sizes):
        rows += [(g * 10_000 + i, r.randrange(-(10**6), 10**6), [g], [g]) for i in range(n)]
    r.shuffle(rows)
    reps = spark.createDataFrame(rows, "doc_id long, place long, u array<long>, v array<long>")
    for n in (1, 7, 64):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            found = dedup.bucketed(reps).collect()
            pairs = {tuple(x) for x in dedup.candidates(dedup.bucketed(reps)).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        large = {x["y"] for x in found if x["kind"] == 1}
        for g, k in enumerate(sizes):
            ids = [g * 10_000 + i for i in range(k)]
            if k <= dedup.NEAR + 1:
                assert {(a, b) for a in ids for b in ids if a < b} <= pairs
            else:
                assert set(ids) <= large
                near, seen, at = collections.defaultdict(set), {ids[0]}, [ids[0]]
                for a, b in pairs:
                    near[a].add(b)
                    near[b].add(a)
                while at:
                    at = [j for i in at for j in near[i] if j not in seen and not seen.add(j)]
                assert seen == set(ids), (n, k)
        assert all(a // 10_000 == b // 10_000 and a < b for a, b in pairs)
