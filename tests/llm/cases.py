"""Tables for the operators' tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=False):
    """Documents of (doc_id, text[, lang, source]); ``extra`` adds columns whose names the operators use themselves."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        for name in ("_gone", "key", "h", "score", "keep", "fp", "a", "b", "u", "host", "declared", "cell", "fill", "n", "token", "arc"):
            df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def prose(seed, n, vocabulary=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def edited(text, seed, share=0.03):
    r = random.Random(seed)
    return " ".join(f"x{r.randrange(10**6)}" if r.random() < share else w for w in text.split())


ODD = [(None, "no id here at all"), (900, None), (901, ""), (902, "   \n\t "), (903, "x"), (904, "two words"), (905, "word " * 60_000), (906, "Ünïcode — ✓ 漢字 😀"), (907, "*** %%% !!!")]
