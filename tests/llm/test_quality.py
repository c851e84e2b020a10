import collections
import functools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from corpusloom.llm import quality
from corpusloom.llm.textkit import Words, words

from .cases import ODD, docs

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=600):
    r, rows, good = random.Random(5), [], {}
    word = lambda: "".join(r.choice("abcdefghijklmno") for _ in range(r.randrange(2, 9)))
    for i in range(n):
        kind = r.choice(["good"] * 7 + ["shout", "marks", "repeat"])
        w = [word() for _ in range(r.randrange(5, 300))]
        text = {"good": lambda: " ".join(w).capitalize() + ".", "shout": lambda: "!! ".join(w).upper(), "marks": lambda: "*** ".join(w), "repeat": lambda: " ".join(x for x in w for _ in range(20))}[kind]()
        rows.append((i, text))
        good[i] = kind == "good"
    return rows, good


def scored(spark, rows, labels, **parameters):
    return {r["doc_id"]: r for r in quality.scored(docs(spark, rows, **parameters), spark.createDataFrame(labels, LABELS)).collect()}


def test_held_out_accuracy(spark):
    rows, good = corpus()
    # A third of the good documents is labelled; no bad one is.
    labels = [(i, 1, 0) for i in good if good[i] and i % 3 == 0]
    found = scored(spark, rows, labels)
    held = [i for i in good if not (good[i] and i % 3 == 0)]
    assert np.mean([found[i]["keep"] == good[i] for i in held]) >= 0.97
    assert all(found[i]["keep"] for i in good if good[i])


def shares_of(rows, labels):
    """Everything before the fit by plain loops: (doc_id, cell) of every document, and the positives."""
    hashed = functools.cache(lambda text, k: [int(x) for x in (Words(pa.array([text])).h if k == 1 else Words(pa.array([text])).shingles(k)[0])])
    said = collections.defaultdict(set)
    for i, q, _ in labels:
        said[i] |= {q} - {None}
    good = {i for i in said if said[i] == {1}}
    half = {i: int(xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), 42) % 2) for i, _ in rows}
    sizes = list(quality.GRAMS.values())

    def grams(text):
        data, known = text.encode(), words(text)
        return [
            [(data[j] * 961 + data[j + 1] * 31 + data[j + 2]) % sizes[0] for j in range(len(data) - 2)], [hashed(x, 1)[0] % sizes[1] for x in known],
            [hashed(" ".join(x), 2)[0] % sizes[2] for x in (zip(known, known[1:]) if len(known) > 1 else [known] if known else [])],
        ]

    found = {i: grams(t or "") for i, t in rows}
    counts = {(h, c, k): collections.Counter() for h in (0, 1) for c in "np" for k in range(3)}
    for i, lists in found.items():
        for k, codes in enumerate(lists):
            counts[half[i], "n", k].update(codes)
            if i in good:
                counts[half[i], "p", k].update(codes)
    bins = {}
    for i, lists in found.items():
        bins[i] = []
        for k, codes in enumerate(lists):
            n, p = counts[1 - half[i], "n", k], counts[1 - half[i], "p", k]
            ratio = lambda x: math.log((p[x] + 1) / (sum(p.values()) + sizes[k])) - math.log((n[x] + 1) / (sum(n.values()) + sizes[k])) if p else 0.0  # noqa: B023, E731
            total = math.fsum(map(ratio, codes))
            bins[i].append(max(0, min(2047, math.floor(math.copysign(math.log1p(abs(total)), total) * 24) + 1024)))
            mean = total / (len(codes) + 30) if k == 0 else mean
        bins[i].append(max(0, min(2047, math.floor(mean * 576) + 1024)))
    begin = []
    for k in range(4):
        own = sorted(bins[i][k] for i in good if i in bins)
        fixed = [math.floor(x * 576) + 1024 for x in (-0.5, -0.1)] if k == 3 else [math.floor(-math.log1p(x) * 24) + 1024 for x in (30, 4)]
        begin.append(fixed + [own[next(j for j in range(len(own)) if (j + 1) / len(own) >= q)] for q in quality.QUANTILES])
    cells = {}
    for i, t in rows:
        cell = 0
        for k in range(4):
            cell = cell * 6 + sum(bins[i][k] >= x for x in begin[k])
        for x, cut in zip(shape_of(t or ""), quality.SHAPE.values()):
            cell = cell * 3 + sum(x >= c for c in cut)
        cells[i] = cell
    return cells, good


def shape_of(text):
    w = words(text)
    size, length = len(text.encode()), sum(len(x.encode()) for x in w)
    lines = [x for x in (tuple(sorted(words(line))) for line in text.split("\n")) if x]
    return sum(a == b for a, b in zip(w, w[1:])) / (len(w) + 8), length / max(1, len(w)), (size - length) / (size + 8), (len(lines) - len(set(lines))) / (len(lines) + 8), len(w)


def test_against_brute_force(spark):
    rows, good = corpus(120)
    rows += [(1000, "one line\none line\nOther line\n\none line"), (1001, "x"), (1002, "go go go go stop"), (1003, "Ünïcode — ✓ 漢字 words"), (1004, ""), (1005, None), (1006, "ab")]
    labels = [(i, 1, 0) for i in good if good[i] and i % 2 == 0] + [(1000, 1, 0), (1001, 1, 0), (1001, 0, 0), (3, None, 1)]
    cells, positive = shares_of(rows, labels)
    counts = collections.Counter(cells.values())
    score, _ = quality.fit([(c, n, sum(cells.get(i) == c for i in positive)) for c, n in counts.items()])
    found = scored(spark, rows, labels)
    assert {i: round(found[i]["score"], 9) for i in found} == {i: 0.0 if c % 3 == 0 else round(score[c], 9) for i, c in cells.items()}


def test_risk_and_gradient_document_by_document():
    r = np.random.default_rng(4)
    cell = r.choice(quality.CELLS, 40, replace=False)
    x = quality.levels(cell)
    assert x.shape[1] == 4 * 6 + 5 * 3 + 1 and (x.sum(1) >= 10).all() and len({tuple(v) for v in x}) == 40
    unlabelled, positive = r.choice(40, 900), r.choice(15, 200)
    u, p = (np.bincount(y, minlength=40) / len(y) for y in (unlabelled, positive))
    for prior, scale in ((0.3, 0.2), (0.9, 0.2), (0.9, 3.0), (None, 1.0)):
        w = r.normal(0, scale, x.shape[1])

        def plain(w):
            loss = lambda j, y: math.log1p(math.exp(-y * float(x[j] @ w)))
            mean = lambda of, y: math.fsum(loss(j, y) for j in of) / len(of)
            if prior is None:
                return mean(positive, 1) + mean(unlabelled, -1), 0
            negative = mean(unlabelled, -1) - prior * mean(positive, -1)
            return prior * mean(positive, 1) + max(0.0, negative), negative

        value, toward = quality.risk(w, x, p, u, prior)
        assert math.isclose(value, plain(w)[0], rel_tol=1e-9)
        # Where the part for negatives is under 0 it alone is descended, backwards.
        part = (lambda v: plain(v)[0]) if prior is None or plain(w)[1] >= 0 else lambda v: -plain(v)[1]
        step = np.eye(len(w)) * 1e-5
        slope = np.array([(part(w + d) - part(w - d)) / 2e-5 for d in step])
        assert np.allclose(slope, toward, atol=1e-6)


@pytest.mark.parametrize("kind", ["other words", "shuffled letters", "menu words", "digits in words", "joined words"])
def test_junk_that_no_measure_was_made_for(spark, kind):
    """Junk in the shape of good text, length, case, marks and lines alike: told by its n-grams alone."""
    r = random.Random(kind)
    vocabulary = ["".join(r.choice("abcdefghijklmno") for _ in range(r.randrange(2, 9))) for _ in range(1500)]
    others = ["".join(r.choice("abcdefghijklmno") for _ in range(r.randrange(2, 9))) for _ in range(1500)]
    make = {
        "other words": lambda w: [r.choice(others) for _ in w], "shuffled letters": lambda w: ["".join(r.sample(x, len(x))) if len(x) > 2 else r.choice("xyz") + x for x in w], "menu words": lambda w: [r.choice(others[:40]) if r.random() < 0.5 else x for x in w],
        "digits in words": lambda w: [x[:-1] + r.choice("0123456789") for x in w], "joined words": lambda w: [a[: len(a) // 2] + b[len(b) // 2 :] for a, b in zip(w, w[1:] + w[:1])],
    }[kind]
    rows, good = [], {}
    for i in range(900):
        w = r.choices(vocabulary, k=r.randrange(30, 200))
        good[i] = r.random() < 0.8
        rows.append((i, " ".join(w if good[i] else make(w))))
    labels = [(i, 1, 0) for i in good if good[i] and i % 3 == 0]
    found = scored(spark, rows, labels)
    held = [i for i in good if not (good[i] and i % 3 == 0)]
    a, b = (np.array([found[i]["score"] for i in held if good[i] == g]) for g in (True, False))
    assert ((a[:, None] > b).mean() + (a[:, None] == b).mean() / 2) > 0.97
    assert np.mean([found[i]["keep"] for i in held if good[i]]) >= 0.98 and np.mean([found[i]["keep"] for i in held if not good[i]]) <= 0.3


def test_class_prior():
    r = np.random.default_rng(1)
    score = np.concatenate([r.integers(5, 10, 7000), r.integers(0, 6, 3000)])
    u = np.bincount(score, minlength=10).astype(float)
    p = np.bincount(r.integers(5, 10, 2000), minlength=10).astype(float)
    assert abs(quality.class_prior(np.arange(10.0), p, u) - 0.7) < 0.06


def test_order_and_repeats_of_labels_do_not_matter(spark):
    rows, good = corpus(200)
    labels = [(i, 1, 0) for i in good if good[i] and i % 2 == 0]
    once = scored(spark, rows, labels)
    again = scored(spark, rows[::-1], [*labels, *labels, (None, 1, 0), (1, None, 0), (10**9, 1, 0)])
    assert {i: once[i]["score"] for i in once} == {i: again[i]["score"] for i in again}


def test_odd_rows(spark):
    rows, good = corpus(200)
    df = docs(spark, [*rows, *ODD], extra=True)
    labels = spark.createDataFrame([(i, 1, 0) for i in good if good[i]] + [(903, 1, 0), (904, 1, 1), (904, 0, 0)], LABELS)
    found = {r["doc_id"]: r for r in quality.scored(df, labels).collect()}
    assert [(found[i]["score"], found[i]["keep"]) for i in (900, 901, 902, 907)] == [(0.0, False)] * 4
    assert found[903]["keep"] and found[904]["keep"]
    assert not found[905]["keep"]
    kept = quality.good_documents(df, labels)
    assert kept.columns == df.columns
    assert None in {r["doc_id"] for r in kept.collect()}


def test_without_positives_and_empty(spark):
    found = scored(spark, [(1, "some words"), (2, "")], [(1, 0, 0)])
    assert (found[1]["score"], found[1]["keep"], found[2]["keep"]) == (None, True, False)
    assert scored(spark, [], [(1, 1, 0)]) == {}
