"""The pipeline, stage by stage on each stage's own input, and its parts against brute force."""

import random

import corpus_pipeline
from corpusloom.llm import packing

from .cases import docs, edited
from .test_decontam import brute as leaks
from .test_dedup import brute as groups


def corpus():
    r = random.Random(6)
    words = {k: ["".join(r.choice(a) for _ in range(r.randrange(2, 8))) for _ in range(2000)] for k, a in (("en", "abcdefgh"), ("de", "ijklmnöü"))}
    prose = lambda lang, n: " ".join(r.choices(words[lang], k=n)).capitalize() + "."
    rows, clean = [], []
    for _ in range(300):
        lang = r.choice(["en", "de"])
        clean.append((len(rows), prose(lang, r.randrange(20, 300)), lang))
        rows.append(clean[-1])
    copies = [(1000 + i, edited(rows[i][1], i, 0.02) if i % 2 else rows[i][1], rows[i][2]) for i in range(30)]
    items = [(i, prose("en", 40)) for i in range(5)]
    leaking = [(2000 + i, f"{prose('en', 100)} {t} {prose('en', 100)}", "en") for i, t in items]
    bad = [(3000 + i, "!! ".join(prose("en", 50).upper().split()), "en") for i in range(20)] + [(3100 + i, "*** ".join(prose("en", 50).split()), "en") for i in range(20)]
    foreign = [(4000 + i, "漢字かな交じり文と仮名" * 9 + str(i), None) for i in range(3)]
    return clean, copies, items, leaking, bad, foreign


def test_stages(spark, tmp_path):
    clean, copies, items, leaking, bad, foreign = corpus()
    everything = clean + copies + leaking + bad + foreign
    df = docs(spark, everything)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i, *_ in clean if i % 2] + [(i, 0, 0) for i, *_ in bad], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "near_dedup", "decontamination", "best_fit_packing"]
    left, kept = df, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, left, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{k}"))
        left = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k < 4:
            assert left.columns == df.columns
            kept.append({r["doc_id"]: r["text"] for r in left.collect()})
    ids = lambda rows: {r[0] for r in rows}
    assert ids(clean + copies + leaking + bad) == set(kept[0])
    assert ids(clean + copies + leaking) == set(kept[1])
    gone, pairs = groups(list(kept[1].items()))
    assert {i for i, _ in gone} == ids(copies) == set(kept[1]) - set(kept[2]) and pairs
    assert {i for i, *_ in leaks(list(kept[2].items()), items)} == ids(leaking) == set(kept[2]) - set(kept[3])
    assert set(kept[3]) == ids(clean)
    pieces = [(d, s, n) for r in left.collect() for d, s, n in zip(r["doc_ids"], r["starts"], r["lengths"])]
    assert sum(n for *_, n in pieces) == sum(len(t.encode()) for t in kept[3].values()) and len(set(pieces)) == len(pieces)
    assert max(r["fill"] for r in left.collect()) <= packing.CAPACITY

    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda x: sorted(str(tuple(r)) for r in x.collect())
    assert key(whole) == key(left)


def test_empty_documents(spark, tmp_path):
    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
