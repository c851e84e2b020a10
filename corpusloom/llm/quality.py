"""Operator 2: quality classifier by positive-unlabelled learning.

Trusted positives are the documents labelled good; all other text is unlabelled.  The class prior of the unlabelled
text is estimated (``class_prior``), and a logistic model is fitted by minimising the non-negative unbiased risk
(Kiryo et al. 2017)

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]).

Features.  Three kinds of hashed n-grams (``GRAMS``: of three bytes, of a word, of two words) are counted over all documents
and over the positives, and a document's measure of each kind is the sum of the log ratios of the two shares over its n-grams
(the evidence of a naive Bayes model: near 0 for a short text, however it is written), on a logarithmic scale; for three bytes
also the mean, which tells a text that is bad in part.  A document is measured by the counts of the other half of the documents (by a hash of the doc_id), so that no document
is known by its own words.  Five measures of its shape (``SHAPE``) go with them.  The n-gram measures are cut into levels at
``QUANTILES`` of the positives and at ``AGAINST``, the shape at fixed points, and the model has a weight for each level.  So the risk
depends on the documents only through their counts in at most ``CELLS`` cells: the fit is over every unlabelled document
exactly, at any size, from one grouped count.  Positives too are counted over all labelled rows; no sample is drawn.

Plan.  One pass over the texts counts n-grams (each task adds its own up first; what is shuffled is as many rows a task as
there are buckets), one gives (doc_id, shape, three measures), written; the labels join with that small table; counts go to
the driver; scoring is a look-up by cell.  The ids of the positives are broadcast to the counting pass up to
``shared.BROADCAST_ROWS`` of them, beyond which they are joined with the texts by a shuffle.

Defined results: a null or empty text has the cell of a text without words, score 0, and isn't kept.  A document is a
positive if all its labels say quality 1 (null labels say nothing); repeated labels count once.  Without positives
there is no model: all scores are null and all texts with a word are kept.  Repeated rows are scored each.  Extra
columns are ignored.  A doc_id that is null or no number is null in the result; ``good_documents`` judges such rows too.  Rows
that share a doc_id are one document there, which goes if one of them isn't kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, minus, with_ids, written
from .textkit import STEP, Words, raw, reduced, slices

#: Kinds of n-grams and their hash buckets.
GRAMS = {"three bytes": 4096, "a word": 8192, "two words": 8192}
#: Measure of the shape, and the points at which its levels begin.
SHAPE = {
    "share of words that repeat the word before": (0.05, 0.25),
    "bytes a word": (3.0, 9.0),
    "share of bytes in no word": (0.22, 0.36),
    "share of lines that repeat a line": (0.15, 0.50),
    "words": (1, 20),
}
#: Shares of the positives that lie under the points at which a level of an n-gram measure begins.
QUANTILES = (0.10, 0.50, 0.90)
#: Evidence against a text, and means against it, at which levels begin besides: texts a little under all positives aren't junk.
AGAINST = ((-30.0, -4.0), (-30.0, -4.0), (-30.0, -4.0), (-0.5, -0.1))
MEASURES = len(AGAINST)
SHAPES, LEVELS = 3 ** len(SHAPE), len(QUANTILES) + len(AGAINST[0]) + 1
CELLS = SHAPES * LEVELS**MEASURES
#: A document goes when it is nineteen times as likely bad as good, as losing good text costs more than keeping some bad.
THRESHOLD = 0.05
STEPS, RATE, PENALTY, DELTA, ALPHA = 400, 0.1, 1e-4, 0.1, 1.0
#: A sum x of log ratios is kept as sign(x) * log(1 + |x|) in steps of 1 / FINE, a mean in steps of 1 / FINE**2, from -BINS / 2 to BINS / 2 of them.
FINE, BINS = 24, 2048
#: A mean is drawn to 0 by as many imaginary n-grams.
FEW = 30
#: A share is drawn to 0 by as many imaginary bytes, words or lines, so that a short text isn't judged by one mark.
_DRAW = 8
_FIRST = np.concatenate([[0], np.cumsum(list(GRAMS.values()))])


def trigrams(data: np.ndarray, offset: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every three bytes within a text, by steps."""
    for at in range(0, len(data), STEP):
        part = data[at : at + STEP + 2].astype(np.int32)
        whose = np.searchsorted(offset, np.arange(at, at + max(0, len(part) - 2)), "right") - 1
        inside = np.arange(at, at + len(whose)) + 3 <= offset[whose + 1]
        yield whose[inside], ((part[:-2] * 961 + part[1:-1] * 31 + part[2:]) % GRAMS["three bytes"])[inside]


def word_buckets(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every word, and of every two words (a text of one word has that one)."""
    pairs, of = w.shingles(2)
    return [(np.repeat(np.arange(len(of) - 1), n), (h % np.uint64(b)).astype(np.int64)) for h, n, b in ((w.h, w.n, GRAMS["a word"]), (pairs, np.diff(of), GRAMS["two words"]))]


def gram_counts(docs: DataFrame, good: DataFrame) -> np.ndarray:
    """half of the documents x unlabelled, positive x bucket: how often each n-gram occurs; documents (doc_id, text), good (doc_id)."""
    some = good.select(F.col("doc_id").alias("_good"))
    some = F.broadcast(some) if some.count() <= BROADCAST_ROWS else some
    texts = docs.join(some, F.col("doc_id") == F.col("_good"), "left").select("text", _half().alias("half"), F.col("_good").isNotNull().alias("good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, _FIRST[-1]), np.int64)
        for batch in batches:
            for part in slices(batch):
                group = part.column("half").to_numpy() * 2 + part.column("good").to_numpy(zero_copy_only=False)
                texts = part.column("text")
                for kind, (whose, bucket) in [*((0, x) for x in trigrams(*raw(texts))), *enumerate(word_buckets(Words(texts)), 1)]:
                    size = _FIRST[kind + 1] - _FIRST[kind]
                    sums[:, _FIRST[kind] : _FIRST[kind + 1]] += np.bincount(group[whose] * size + bucket, minlength=4 * size).reshape(4, size)
        bucket, half = np.divmod(np.flatnonzero((sums[0::2] + sums[1::2]).T.ravel()), 2)
        rest, own = sums[half * 2, bucket], sums[half * 2 + 1, bucket]
        yield pa.RecordBatch.from_arrays([pa.array(half.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(rest + own), pa.array(own)], ["half", "bucket", "n", "p"])

    found = texts.mapInArrow(count, "half int, bucket int, n long, p long").groupBy("half", "bucket").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).toArrow()
    out = np.zeros((2, 2, _FIRST[-1]))
    for j, c in enumerate(("n", "p")):
        out[found["half"].to_numpy(), j, found["bucket"].to_numpy()] = found[c].to_numpy()
    return out


def _half():
    return F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")


def ratios(counts: np.ndarray) -> np.ndarray:
    """half x bucket: the log ratio of an n-gram's share of the positives to that of all text, from the other half's counts; 0 where that has no positive."""
    out = np.zeros((2, _FIRST[-1]))
    for kind in range(len(GRAMS)):
        at = slice(_FIRST[kind], _FIRST[kind + 1])
        for half in (0, 1):
            n, p = counts[1 - half, :, at]
            if p.sum():
                out[half, at] = np.log((p + ALPHA) / (p.sum() + ALPHA * len(p))) - np.log((n + ALPHA) / (n.sum() + ALPHA * len(n)))
    return out


def shapes(texts: pa.Array, w: Words) -> np.ndarray:
    """The number of the shape of each text."""
    size = np.diff(w.offset)
    h = w.h
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[w.of[:-1][w.n > 0]] = False
    length = reduced(w.end - w.start, w.of, np.add)
    # Lines: a line's hash is the sum of its words' hashes; lines without a word count as none.
    ends = np.flatnonzero(w.data == 10)
    line, doc = np.searchsorted(ends, w.start), np.repeat(np.arange(len(size)), w.n)
    new = np.ones(len(h), bool)
    new[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(new)
    sums = np.add.reduceat(h, starts) if len(starts) else h
    whose = doc[starts]
    order = np.lexsort((sums, whose))
    again = np.zeros(len(order), bool)
    again[1:] = (sums[order][1:] == sums[order][:-1]) & (whose[order][1:] == whose[order][:-1])
    lines, repeats = np.bincount(whose, minlength=len(size)), np.bincount(whose[order][again], minlength=len(size))
    measures = (reduced(same.astype(np.int64), w.of, np.add) / (w.n + _DRAW), length / np.maximum(w.n, 1), (size - length) / (size + _DRAW), repeats / (lines + _DRAW), w.n)
    out = np.zeros(len(size), np.int32)
    for x, cut in zip(measures, SHAPE.values(), strict=True):
        out = out * 3 + np.searchsorted(cut, x, "right").astype(np.int32)
    return out


def binned(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """MEASURES rows of bins, from the sums of the log ratios of each kind, and the number of three bytes."""
    scaled = np.concatenate([np.sign(sums) * np.log1p(np.abs(sums)) * FINE, sums[:1] / (n + FEW) * FINE**2])
    return np.clip(np.floor(scaled) + BINS // 2, 0, BINS - 1).astype(np.int32)


def measured(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, shape, m0 to m3): the shape and the n-gram measures, as bins, of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(ratio)
    names = [f"m{j}" for j in range(MEASURES)]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = sent.value
        for batch in batches:
            for part in slices(batch):
                texts, half = part.column("text"), part.column("half").to_numpy()
                w = Words(texts, places=True)
                sums, data = np.zeros((len(GRAMS), part.num_rows)), raw(texts)
                for kind, (whose, bucket) in [*((0, x) for x in trigrams(*data)), *enumerate(word_buckets(w), 1)]:
                    sums[kind] += np.bincount(whose, ratio[half[whose], _FIRST[kind] + bucket], part.num_rows)
                bins = binned(sums, np.maximum(np.diff(data[1]) - 2, 0))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shapes(texts, w)), *map(pa.array, bins)], ["doc_id", "shape", *names])

    return docs.select("doc_id", "text", _half().alias("half")).mapInArrow(make, "doc_id long, shape int, " + ", ".join(f"{c} int" for c in names))


def cuts(measure: int, bins: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The bins at which levels begin: where QUANTILES of the positives (n of them in each bin) are reached, and at AGAINST."""
    order = np.argsort(bins)
    upto = np.cumsum(n[order]) / n.sum()
    fixed = np.array(AGAINST[measure])
    fixed = binned(np.stack([fixed] * len(GRAMS)), np.full(len(fixed), 1 - FEW))[-1 if measure == MEASURES - 1 else 0]
    return np.sort(np.concatenate([fixed, bins[order][np.searchsorted(upto, QUANTILES, "left")]]))


def levels(cell: np.ndarray) -> np.ndarray:
    """One row a cell: 1 for each of a measure's levels that it has reached, so that near levels have near weights, and a constant."""
    sizes = [LEVELS] * MEASURES + [3] * len(SHAPE)
    out = np.zeros((len(cell), sum(sizes) + 1))
    out[:, -1] = 1
    at, rest = sum(sizes), cell.copy()
    for size in reversed(sizes):
        at -= size
        out[:, at : at + size] = np.arange(size) <= (rest % size)[:, None]
        rest = rest // size
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def risk(w: np.ndarray, x: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float | None) -> tuple[float, np.ndarray]:
    """The risk and the direction to descend; p and u are the shares of the positive and the unlabelled documents in each cell.

    Where the part for negatives is under 0 it is descended alone and backwards, as in the paper.  With ``prior`` None the
    risk is an ordinary classifier's, of positives against unlabelled.
    """
    score = x @ w
    s, up, down = _sigmoid(score), np.logaddexp(0, -score), np.logaddexp(0, score)
    if prior is None:
        return float(p @ up + u @ down), x.T @ (p * (s - 1) + u * s)
    negative = u @ down - prior * (p @ down)
    toward = x.T @ (u * s - prior * p * s)
    return float(prior * (p @ up) + max(0.0, negative)), (prior * (x.T @ (p * (s - 1))) + toward if negative >= 0 else -toward)


def _fit(x: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float | None) -> np.ndarray:
    """Weights by Adam on the whole risk."""
    w, m, v = np.zeros(x.shape[1]), 0.0, 0.0
    p, u = p / p.sum(), u / u.sum()
    for t in range(1, STEPS + 1):
        grad = risk(w, x, p, u, prior)[1] + PENALTY * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def class_prior(score: np.ndarray, p: np.ndarray, u: np.ndarray, delta: float = DELTA) -> float:
    """Best-bin estimate (Garg et al. 2021): the least ratio of the unlabelled to the positive share above a score.

    Bounds of probability 1 - delta on both shares keep small bins from being chosen.
    """
    order = np.argsort(-score, kind="stable")
    last = np.append(score[order][1:] != score[order][:-1], True)
    above_p, above_u = (np.cumsum(x[order])[last] / x.sum() for x in (p, u))
    slack = sum(np.sqrt(np.log(4 / delta) / (2 * x.sum())) for x in (p, u))
    some = above_p > 0
    best = np.argmin(((above_u + slack) / np.where(some, above_p, 1))[some])
    return float(np.clip((above_u[some] / above_p[some])[best], 0.01, 0.99))


def fit(counts: list[tuple[int, int, int]]) -> tuple[dict[int, float], float | None]:
    """Score by cell, and the class prior, from (cell, documents, positives)."""
    cell, n, p = (np.array(x, np.int64) for x in zip(*sorted(counts), strict=True)) if counts else [np.zeros(0, np.int64)] * 3
    if not p.sum():
        return {}, None
    x, p, u = levels(cell), p.astype(float), n.astype(float)
    prior = class_prior(x @ _fit(x, p, u, None), p, u)
    return dict(zip(cell.tolist(), _sigmoid(x @ _fit(x, p, u, prior)).tolist(), strict=True)), prior


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, keep) of every document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    good = labels.select(F.col("doc_id").try_cast("long").alias("doc_id"), "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    good = written(good, "good")
    found = written(measured(docs, ratios(gram_counts(docs, good))), "measures")
    kinds = [f"m{j}" for j in range(MEASURES)]
    marked = found.join(good.select("doc_id", F.lit(1).alias("p")), "doc_id", "left")
    rows = marked.where("p = 1").select(F.posexplode(F.array(*kinds)).alias("kind", "bin")).groupBy("kind", "bin").agg(F.count("*").alias("n")).collect()
    wordless = F.col("shape") % 3 == 0
    if not rows:
        return found.select("doc_id", F.lit(None).cast("double").alias("score"), (~wordless).alias("keep"))
    begin = [cuts(k, *(np.array([r[c] for r in rows if r["kind"] == k], np.int64) for c in ("bin", "n"))) for k in range(MEASURES)]
    cell = F.lit(0)
    for k, at in zip(kinds, begin, strict=True):
        cell = cell * LEVELS + sum((F.col(k) >= int(x)).cast("int") for x in at)
    cell = (cell * SHAPES + F.col("shape")).alias("cell")
    counts = marked.groupBy(cell).agg(F.count("*").alias("n"), F.count("p").alias("p")).collect()
    score, _ = fit([tuple(r) for r in counts])
    table = np.zeros(CELLS)
    table[list(score)] = list(score.values())
    sent = spark.sparkContext.broadcast(table)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.where(cell % 3 == 0, 0.0, sent.value[cell]))], ["doc_id", "score"])

    return found.select("doc_id", cell).mapInArrow(look_up, "doc_id long, score double").withColumn("keep", F.col("score") >= threshold)


def good_documents(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The rows of documents that the classifier keeps."""
    return minus(docs, scored(with_ids(docs), labels, **parameters).where("NOT keep").select("doc_id").distinct())
