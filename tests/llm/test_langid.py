import itertools

import pyarrow as pa
import pytest

from corpusloom.llm import langid

from .cases import ODD, docs, prose

WORDS = {"en": "the and of with from this that house river", "de": "der und mit von aus dieser das haus fluss", "fr": "le et avec de depuis cette maison rivière été"}


def texts(n=30):
    import random

    out = []
    for k in range(n):
        for lang, w in WORDS.items():
            out.append((len(out), " ".join(random.Random(f"{k}{lang}").choices(w.split(), k=12 if k else 3)), lang, f"{lang}-site"))
    return out


def identify(df):
    return {r["doc_id"]: r for r in langid.identify(langid.records_of_documents(df), ["doc_id"]).collect()}


def test_held_out_texts_without_a_declaration(spark):
    rows = texts()
    known = identify(docs(spark, [(i, t, lang if i < 60 else None, s if i < 60 else "elsewhere") for i, t, lang, s in rows]))
    right = sum(known[i]["lang"] == lang for i, _, lang, _ in rows)
    assert right >= 0.95 * len(rows)
    assert all(known[i]["accepted"] for i, *_ in rows)


def test_evidence_moves_an_unclear_text(spark):
    rows = [*texts(), (500, "o 12", "de", "de-site"), (501, "o 12", "fr", "fr-site"), (502, "o 12", "fr", None), (503, "o 12", None, "de-site"), (504, "12 +3", "de", "de-site")]
    known = identify(docs(spark, rows))
    assert [known[i]["lang"] for i in (500, 501, 502, 503)] == ["de", "fr", "fr", "de"]
    assert (known[504]["lang"], known[504]["posterior"]) == ("und", 1.0)


def test_unlike_every_language(spark):
    rows = [*texts(), (600, "漢字かな交じり文と仮名" * 20, None, "en-site")]
    known = identify(docs(spark, rows))
    assert known[600]["lang"] == "und" and not known[600]["accepted"]


def test_odd_rows(spark):
    rows = [*texts(), *((i, t, None, None) for i, t in ODD), (7, "the and of", "en-US", "x"), (8, "the and of", "??", "x")]
    df = docs(spark, rows, extra=True)
    known = identify(df)
    assert [(known[i]["lang"], known[i]["posterior"], known[i]["accepted"]) for i in (900, 901)] == [("und", 1.0, False)] * 2
    kept = langid.in_known_language(df)
    assert kept.columns == df.columns
    left = {r["doc_id"] for r in kept.collect()}
    assert not left & {900, 901} and {7, 8} <= left


def test_no_declaration_at_all(spark):
    rows = [(1, "some text", None), (2, "", None), (3, None, None)]
    known = identify(docs(spark, rows))
    assert (known[1]["lang"], known[1]["accepted"]) == (None, True)
    assert (known[2]["lang"], known[2]["accepted"]) == ("und", False)
    assert [r["doc_id"] for r in langid.in_known_language(docs(spark, rows)).collect()] == [1]


def test_empty(spark):
    assert identify(docs(spark, [])) == {}


def test_pages(spark):
    page = lambda i, lang, text, url: (i, url, f"<html lang='{lang}'><script>the the the</script><p>{text}</p></html>")
    pages = spark.createDataFrame([page(i, lang, t, f"https://{lang}.example.{lang}/p{i}") for i, t, lang, _ in texts()] + [(900, None, None), (901, "no address", "<p>der und mit das haus</p>"), (902, "http://USER@de.example.de:80/x", "<p>o</p>")], "page_id long, url string, html string")
    known = {r["page_id"]: r["lang"] for r in langid.identify(langid.records_of_pages(pages), ["page_id"]).collect()}
    assert all(known[i] == lang for i, _, lang, _ in texts())
    assert (known[900], known[901], known[902]) == ("und", "de", "de")


def test_long_text_counts_whole(spark):
    rows = [*texts(), (700, prose(1, 3) + " " + "der und mit von aus dieser das haus fluss " * 20_000, None, None)]
    assert identify(docs(spark, rows))[700]["lang"] == "de"


@pytest.mark.parametrize("order", list(itertools.permutations((None, "", "the and of with from", " 12 ++ ", "x"))))
def test_every_order_of_empty_and_other_texts_in_a_slice(spark, order):
    """In one slice of one batch, whatever comes first; the trigrams of each text are those it has alone."""
    code, of = langid._trigrams(pa.array(order, pa.string()))
    alone = [langid._trigrams(pa.array([x], pa.string()))[0].tolist() for x in order]
    assert [code[a:b].tolist() for a, b in zip(of[:-1], of[1:])] == alone and len(of) == len(order) + 1


@pytest.mark.parametrize("first", [(None, "en"), ("", "en"), (None, None), ("", None), (" 1 ", None)])
def test_empty_text_first(spark, first):
    rows = [(1000, *first, None), *texts(), (1001, None, "de", None), (1002, "the house with this river", None, None), (1003, "", None, None)]
    df = docs(spark, rows).coalesce(1)
    known = identify(df)
    assert [(known[i]["lang"], known[i]["posterior"]) for i in (1000, 1001, 1003)] == [("und", 1.0)] * 3
    assert known[1002]["lang"] == "en" and known[1002]["accepted"]
    assert all(known[i]["lang"] == lang for i, _, lang, _ in texts())
    assert {r["doc_id"] for r in langid.in_known_language(df).collect()} == {i for i, *_ in texts()} | {1002}


def test_rare_declarations_are_no_classes(spark):
    rows = [*texts(400), (5000, "o", "qq", None), (5001, "the river with this house", "qq", None)]
    known = identify(docs(spark, rows))
    assert {r["lang"] for r in known.values()} <= {"en", "de", "fr"} and known[5001]["lang"] == "en"


def test_rows_without_a_number_for_an_id(spark):
    df = docs(spark, texts()).selectExpr("concat('d', doc_id) AS doc_id", "text", "lang", "source", "n_chars")
    df = df.unionByName(df.limit(1).selectExpr("'z' AS doc_id", "repeat('漢字かな交じり文と仮名', 20) AS text", "CAST(NULL AS string) AS lang", "CAST(NULL AS string) AS source", "n_chars"))
    kept = langid.in_known_language(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {f"d{i}" for i, *_ in texts()}
