import pyarrow as pa
import pytest

from corpusloom.llm import decontam
from corpusloom.llm.textkit import shingle_set

from .cases import ODD, docs, edited, prose


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def brute(rows, known):
    return {
        (i, j, round(len(q & shingle_set(t)) / len(q), 6))
        for j, x in known if j is not None and (q := shingle_set(x))
        for i, t in rows if t is not None and len(q & shingle_set(t)) >= decontam.THRESHOLD * len(q)
    }


def cases():
    known = [(i, prose(f"item{i}", n)) for i, n in enumerate([3, 10, 20, 45, 59, 300, 5000])]
    rows = []
    for i, text in known:
        for k, share in enumerate((0, 0.02, 0.05, 0.3, 0.9)):
            for around in (0, 30, 8000):
                rows.append((len(rows), f"{prose(f'a{i}{k}', around)} {edited(text, k, share).upper()}, {prose(f'b{i}{k}', around)}"))
    return rows + [(5000 + k, prose(f"clean{k}", 400)) for k in range(50)], known


def test_against_brute_force(spark):
    rows, known = cases()
    expected = brute(rows, known)
    for most in (decontam.BROADCAST_HASHES, 0):
        got = {tuple(x) for x in decontam.leaks(docs(spark, rows), items(spark, known), broadcast_hashes=most).collect()}
        assert got <= expected and len(got) >= 0.97 * len(expected)


@pytest.mark.parametrize("most", [decontam.BROADCAST_HASHES, 0])
def test_odd_rows(spark, most):
    known = [(1, "Two words"), (2, None), (3, ""), (None, "a b c d"), (4, "the very same item text"), (4, "another text with one id"), (4, "the very same item text"), (5, "the very same item text")]
    rows = [*ODD, (10, "the very same item text"), (10, "the very same item text"), (11, "so: THE very same item text!"), (None, "the very same item text"), (None, "and THE very same item text"), (12, "the very same item te xt")]
    got = {tuple(x) for x in decontam.leaks(docs(spark, rows, extra=True), items(spark, known), broadcast_hashes=most).collect()}
    assert got == {(904, 1, 1.0), *((d, i, 1.0) for d in (10, 11, None) for i in (4, 5)), (12, 4, round(2 / 3, 6)), (12, 5, round(2 / 3, 6))}
    kept = decontam.decontaminated(docs(spark, rows, extra=True), items(spark, known), broadcast_hashes=most)
    assert kept.count() == len(rows) - 7 and kept.columns == docs(spark, rows, extra=True).columns
    # Ids that are no numbers.
    odd = docs(spark, rows).selectExpr("'x' || coalesce(doc_id, 0) AS doc_id", "text")
    assert decontam.decontaminated(odd, items(spark, known), broadcast_hashes=most).count() == len(rows) - 7


def test_words_are_compared_where_hashes_are_equal():
    a, b = decontam.Item("one two three four", 3), decontam.Words(pa.array(["zero one two three five", "one two three four"]), places=True)
    g, of = b.shingles(3)
    assert [a.share(b, g, of, d, 3) for d in (0, 1)] == [0.5, 1.0]
    a.words[0] = (b"other", b"words", b"here")
    assert a.share(b, g, of, 1, 3) == 0.5


def test_empty(spark):
    assert decontam.leaks(docs(spark, []), items(spark, [(1, "a b c")])).collect() == []
    assert decontam.leaks(docs(spark, [(1, "a b c")]), items(spark, [])).collect() == []
