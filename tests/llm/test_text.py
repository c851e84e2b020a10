"""Word and shingle hashing against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm.textkit import SLICE, WORD_PATTERN, Words, shingle_set, slices, words


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.characters(codec="utf-8", exclude_characters="İ"), max_size=40)), min_size=1, max_size=6))
def test_words_and_shingles(texts):
    w = Words(pa.array(texts, pa.string()))
    assert list(w.n) == [len(words(t)) for t in texts]
    g, of = w.shingles(3)
    sets = [set(g[a:b].tolist()) for a, b in zip(of[:-1], of[1:])]
    assert [len(s) for s in sets] == [len(shingle_set(t)) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            assert len(sets[i] & sets[j]) == len(shingle_set(texts[i]) & shingle_set(texts[j]))


def test_pattern_is_the_same_for_sql():
    text = "It's  Ünïcode_1, 3.5\tπ—x"
    assert words(text) == re.findall(WORD_PATTERN, text.lower())


def test_slices_cut_no_text():
    texts = ["a " * SLICE, "b", None, "", "c " * 10]
    batch = pa.record_batch({"text": pa.array(texts)})
    parts = list(slices(batch))
    assert sum(p.num_rows for p in parts) == 5
    assert [x for p in parts for x in p.column("text").to_pylist()] == texts
    assert int(np.sum([Words(p.column("text")).n.sum() for p in parts])) == SLICE + 11


def test_a_sliced_array():
    whole = pa.array(["one two", "three", "four five six"])
    assert list(Words(whole.slice(1)).n) == [1, 3]
