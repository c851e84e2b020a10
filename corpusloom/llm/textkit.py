"""Words, shingles and their 64-bit hashes for whole Arrow batches, without a Python loop over words.

A word is a run of ASCII letters and digits and of any characters beyond ASCII, after lower-casing; all else separates
words.  The same words come from SQL by ``WORDS_SQL``.  A text is never cut: a batch is handled in slices of about
``SLICE`` bytes, of whole rows, and a longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 18
#: Bytes that are gone through at a time.
STEP = 1 << 19
WORD_PATTERN = r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
#: DuckDB: the list of words of the column ``text``.
WORDS_SQL = rf"regexp_extract_all(lower(text), '{WORD_PATTERN}')"
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_ROLE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _power(base: int) -> np.ndarray:
    """The powers of a base from 0 to STEP."""
    if base not in _powers:
        have = np.full(STEP + 1, base, np.uint64)
        have[0] = 1
        _powers[base] = np.multiply.accumulate(have)
    return _powers[base]


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of the batch, of whole rows, with about SLICE bytes of text each."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.cumsum(size)
    start = 0
    while start < batch.num_rows:
        done = at[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(at, done + SLICE, "right")))
        yield batch.slice(start, end - start)
        start = end


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins (and the end); null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    texts = pa.concat_arrays([texts]) if texts.offset == 0 else pa.concat_arrays([texts.slice(0)])
    _, offsets, data = texts.buffers()
    offset = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offset[0] : offset[-1]], offset - offset[0]


class Words:
    """The words of some texts: ``h``, a hash of each, the same for the same word anywhere, and ``of``, where each text's words begin.

    The bytes are gone through by steps of STEP, and a word that goes on past a step is carried over, so what is held
    besides the texts is about five numbers a word, however long a text or a word is.  With ``places`` also ``start``
    and ``end`` of each word in ``data``.
    """

    def __init__(self, texts: pa.Array, places: bool = False):
        self.data, self.offset = raw(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())))
        data, offset = self.data, self.offset
        hashes, starts, ends, counts = [], [], [], np.zeros(len(offset), np.int64)
        begun, partial, up, down = -1, 0, _power(_P), _power(_PINV)
        total = 0
        for at in range(0, len(data), STEP):
            part = data[at : at + STEP]
            n = len(part)
            word = _IS_WORD[part]
            edge = np.zeros(n + 1, bool)
            low, high = np.searchsorted(offset, [at, at + n + 1])
            edge[offset[low:high] - at] = True
            before, after = np.empty(n, bool), np.empty(n, bool)
            before[1:], before[0] = word[:-1], at > 0 and _IS_WORD[data[at - 1]]
            after[:-1], after[-1] = word[1:], at + n < len(data) and _IS_WORD[data[at + n]]
            start, end = np.flatnonzero(word & ~(before & ~edge[:n])), np.flatnonzero(word & ~(after & ~edge[1:])) + 1
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
            # Where each text begins among the words of this step; one that begins at its end is counted in the next.
            low, high = np.searchsorted(offset, [at, at + n])
            counts[low:high] = total + np.searchsorted(start, offset[low:high] - at)
            total += len(start)
            first = np.zeros(0, np.uint64)
            if begun >= 0:
                here = int(sums[end[0]] if len(end) else sums[n])
                partial = (partial + here * pow(_P, at - begun, 1 << 64)) % (1 << 64)
                if not len(end):
                    continue
                first, begun = np.array([partial], np.uint64), -1
                if places:
                    ends.append(end[:1] + at)
                end = end[1:]
            if len(start) > len(end):
                begun, partial = at + int(start[-1]), (int(sums[n]) - int(sums[start[-1]])) * pow(_PINV, int(start[-1]), 1 << 64) % (1 << 64)
            if places:
                starts.append(start + at)
                ends.append(end + at)
            whole = start[: len(end)]
            hashes += [first, (sums[end] - sums[whole]) * down[whole]]
        counts[np.searchsorted(offset, len(data)) :] = total
        self.h = mix(np.concatenate([np.zeros(0, np.uint64), *hashes]))
        if places:
            none = np.zeros(0, np.int64)
            self.start, self.end = np.concatenate([none, *starts]), np.concatenate([none, *ends])
        self.of = counts
        self.n = np.diff(self.of)

    def shingles(self, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words (a text of fewer words has one shingle, of all its words), and where each text's begin."""
        h, n = self.h, self.n
        m = max(0, len(h) - k + 1)
        out, keep = np.zeros(len(h), np.uint64), np.ones(len(h), bool)
        for j in range(k if m else 0):
            out[:m] += h[j : j + m] * _ROLE[j]
        for j in range(1, k):
            keep[(self.of[1:] - j)[n >= j]] = False
        few = np.flatnonzero((n > 0) & (n < k))
        first = self.of[:-1][few]
        for j in range(k - 1):
            some = n[few] > j
            out[first[some]] = (out[first[some]] if j else 0) + h[first[some] + j] * _ROLE[j]
        keep[first] = True
        of = np.concatenate([[0], np.cumsum(np.where((n > 0) & (n < k), 1, np.maximum(n - k + 1, 0)))])
        return mix(out[keep]), of


def reduced(values: np.ndarray, of: np.ndarray, how: np.ufunc, empty: int = 0) -> np.ndarray:
    """``how`` over each text's values; ``empty`` where it has none."""
    out = np.full(len(of) - 1, empty, values.dtype)
    some = np.diff(of) > 0
    if some.any():
        out[some] = how.reduceat(values, of[:-1][some])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def words(text: str | None) -> list[str]:
    """The words of one text, for verifying candidates and for tests."""
    data, out, at = pc.utf8_lower(pa.scalar(text or "", pa.large_string())).as_py().encode(), [], None
    for i, b in enumerate(data):
        if _IS_WORD[b]:
            at = i if at is None else at
        elif at is not None:
            out.append(data[at:i])
            at = None
    return [w.decode("utf-8", "replace") for w in ([*out, data[at:]] if at is not None else out)]


def shingle_set(text: str | None, k: int = 3) -> set[tuple[str, ...]]:
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
