import collections
import random

import numpy as np

from corpusloom.llm import lmscore

from .cases import ODD, docs

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=300):
    r, rows, good = random.Random(8), [], {}
    words = {k: [f"{k}{r.randrange(10**6)}" for _ in range(300)] for k in ("inside", "other")}
    for i in range(n):
        good[i] = i % 3 == 0
        rows.append((i, " ".join(r.choices(words["inside" if good[i] else "other"], k=r.randrange(3, 60)))))
    return rows, good


def gains(rows, labels):
    """token -> gain for the in-domain dictionary; under 0 for the general one."""
    said = collections.defaultdict(set)
    for i, q, _ in labels:
        said[i] |= {q} - {None}
    good = {i for i in said if said[i] == {1} and i is not None}
    sums = {True: collections.Counter(), False: collections.Counter()}
    for i, t in rows:
        for w in (t or "").split():
            for k in range(0, len(w), lmscore.PIECE):
                if len(w[k : k + lmscore.PIECE].encode()) >= lmscore.LEAST:
                    sums[i in good][w[k : k + lmscore.PIECE]] += 1
    total = {k: sum(c.values()) for k, c in sums.items()}
    share = lambda k, w: sums[k][w] / total[k] if total[k] else 0.0
    return {w: len(w.encode()) * (share(True, w) - share(False, w)) for w in sums[True] | sums[False]}


def brute(rows, labels, size):
    gain, made = gains(rows, labels), []
    for sign in (1, -1):
        out, used = [], 0
        for w, g in sorted(gain.items(), key=lambda x: (-sign * x[1], x[0])):
            if sign * g <= 0 or used + len(w.encode()) + 1 > size:
                break
            out.append(w.encode() + b" ")
            used += len(out[-1])
        made.append(lmscore.compressor(b"".join(reversed(out))))
    return {(i, len((t or "").encode()), *lmscore.sizes_and_score(*made, (t or "").encode())) for i, t in rows}


def test_against_brute_force(spark):
    rows, good = corpus()
    rows += [(10_000, None), (10_001, ""), (10_002, "xyzzy " * 50_000)]
    labels = [(i, 1, 0) for i in good if good[i] and i % 2 == 0] + [(3, 1, 0), (3, 0, 0)]
    for size in (lmscore.DICTIONARY, 600):
        got = lmscore.scored(docs(spark, rows), spark.createDataFrame(labels, LABELS), size).collect()
        assert {tuple(r) for r in got} == brute(rows, labels, size) and len(got) == len(rows)


def test_held_out_texts(spark):
    rows, good = corpus()
    labels = [(i, 1, 0) for i in good if good[i] and i % 2 == 0]
    found = {r["doc_id"]: r["score"] for r in lmscore.scored(docs(spark, rows), spark.createDataFrame(labels, LABELS), 3000).collect()}
    held = [i for i in good if not (good[i] and i % 2 == 0)]
    a, b = np.array([found[i] for i in held if good[i]]), np.array([found[i] for i in held if not good[i]])
    assert (a[:, None] > b).mean() > 0.95


def test_counts_follow_the_corpus(spark):
    rows, _ = corpus()
    labels = spark.createDataFrame([], LABELS)
    once = lmscore.token_counts(docs(spark, rows), labels).agg({"n": "sum", "inside": "sum"}).first()
    twice = lmscore.token_counts(docs(spark, rows + rows), labels).agg({"n": "sum", "inside": "sum"}).first()
    assert twice["sum(n)"] == 2 * once["sum(n)"] > 0 == once["sum(inside)"]


def test_odd_rows(spark):
    labels = spark.createDataFrame([(None, 1, 0), (903, None, 0), (904, 1, 0)], LABELS)
    df = docs(spark, [*ODD, *ODD], extra=True)
    found = lmscore.scored(df, labels).collect()
    assert len(found) == 2 * len(ODD)
    assert {r["score"] for r in found if r["doc_id"] in (900, 901)} == {0.0}
    assert lmscore.scored(docs(spark, []), labels).collect() == []


def test_a_long_unbroken_token_leaves_the_dictionaries_filled(spark):
    rows, good = corpus()
    r = random.Random(9)
    blob = "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ+/0123456789", k=150_000))
    rows += [(10_000, blob), (10_001, "漢字" * 40_000)]
    labels = [(i, 1, 0) for i in good if good[i]] + [(10_000, 1, 0)]
    counts = lmscore.token_counts(docs(spark, rows), spark.createDataFrame(labels, LABELS))
    inside, general = lmscore.dictionaries(counts)
    known, gain = {x["token"]: x for x in counts.collect()}, gains(rows, labels)
    once = max(abs(gain[w]) for w in gain if len(w) == lmscore.PIECE and known[w]["n"] == 1)
    worth = lambda sign: {w for w, g in gain.items() if sign * g > once}
    assert worth(1) <= set(inside.decode().split()) and worth(-1) <= set(general.decode().split()) and len(worth(1)) > 200
    # The general side has fewer tokens than fit, so it has all of them.
    assert lmscore.DICTIONARY - 4 * lmscore.PIECE <= len(inside) <= lmscore.DICTIONARY
    assert set(general.decode().split()) == {w for w, g in gain.items() if g < 0}
    assert sum(len(w) * x["n"] for w, x in known.items() if w.startswith("漢")) == 80_000


def test_one_source_alone(spark):
    rows, good = corpus(60)
    for labels in ([], [(i, 1, 0) for i, _ in rows]):
        counts = lmscore.token_counts(docs(spark, rows), spark.createDataFrame(labels, LABELS))
        inside, general = lmscore.dictionaries(counts)
        full, empty = (inside, general) if labels else (general, inside)
        assert empty == b"" and set(full.decode().split()) == {w for _, t in rows for w in t.split() if len(w) >= 4}
        assert {tuple(r) for r in lmscore.scored(docs(spark, rows), spark.createDataFrame(labels, LABELS)).collect()} == brute(rows, labels, lmscore.DICTIONARY)
