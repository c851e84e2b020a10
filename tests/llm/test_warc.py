import gzip
import random

import pyarrow.fs
import pytest

from corpusloom.llm import warc

HTML = ["<p>one</p>", "", "x" * 200_000, "WARC/1.0\r\nWARC-Type: fake\r\n\r\n", "ünï", "a\r\n\r\nb"]


def rows(data, tmp_path):
    path = tmp_path / "f.warc"
    path.write_bytes(data)
    return list(warc.salvaged(warc.File(pyarrow.fs.LocalFileSystem(), str(path), len(data)), "f"))


def file(plain):
    parts = [warc.record_bytes(i, f"http://a/{i}", h) for i, h in enumerate(HTML)]
    return parts if plain else [gzip.compress(p) for p in parts]


def pages(found):
    return [int(r[6][10:-1]) for r in found if r[1] == "record"]


@pytest.mark.parametrize("plain", [True, False])
def test_whole_file(plain, tmp_path):
    found = rows(b"".join(file(plain)), tmp_path)
    assert [r[9].decode() for r in found] == HTML and all(r[1] == "record" for r in found)
    assert pages(found) == list(range(6)) and [r[7] for r in found] == [f"http://a/{i}" for i in range(6)]


@pytest.mark.parametrize("plain", [True, False])
@pytest.mark.parametrize("hurt", range(6))
def test_one_record_hurt(plain, hurt, tmp_path):
    for how in ("flip", "cut", "gone"):
        parts = file(plain)
        whole = parts[hurt]
        middle = len(whole) - (8 if plain else 6)
        parts[hurt] = {"flip": whole[:middle] + bytes([whole[middle] ^ 1]) + whole[middle + 1 :], "cut": whole[: len(whole) * 2 // 3], "gone": b"\x00" * len(whole)}[how]
        if how == "flip" and plain and not HTML[hurt]:
            continue  # the byte is in the header, whose values have no digest
        found = rows(b"".join(parts), tmp_path)
        assert pages(found) == [i for i in range(6) if i != hurt], (how, found)
        gaps = [r for r in found if r[1] == "gap"]
        before = sum(map(len, parts[:hurt]))
        assert [(g[2], g[3]) for g in gaps] == [(before, len(parts[hurt]))] and gaps[0][4]


def test_rows_cover_the_file(tmp_path):
    r = random.Random(2)
    for seed in range(30):
        parts = [p for p in (*file(True), *file(False))]
        r.shuffle(parts)
        data = bytearray(b"".join(parts))
        for _ in range(seed % 5):
            at = r.randrange(len(data))
            data[at : at + r.randrange(50)] = r.randbytes(r.randrange(50))
        found = rows(bytes(data), tmp_path)
        at = 0
        for row in found:
            assert row[2] == at
            at += row[3]
        assert at == len(data)
        assert not any(a[1] == b[1] == "gap" for a, b in zip(found, found[1:]))


def test_wrong_length_swallows_nothing(tmp_path):
    parts = file(True)
    parts[1] = parts[1].replace(b"Content-Length: 0", b"Content-Length: 300000")
    assert pages(rows(b"".join(parts), tmp_path)) == [0, 2, 3, 4, 5]


def test_blocks_do_not_matter(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 64)
    parts = file(True)
    data = b"".join(parts[:2]) + b"\xff" * 555 + b"".join(parts[2:])
    found = rows(data, tmp_path)
    assert pages(found) == list(range(6)) and [r[3] for r in found if r[1] == "gap"] == [555]


def test_empty_and_junk(tmp_path):
    assert rows(b"", tmp_path) == []
    assert rows(b"\r\n\r\n", tmp_path) == []
    assert [(r[1], r[2], r[3]) for r in rows(b"no record here", tmp_path)] == [("gap", 0, 14)]
    assert [(r[1], r[2], r[3]) for r in rows(b"\x1f\x8b\x08", tmp_path)] == [("gap", 0, 3)]


def test_round_trip(spark):
    known = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 50)) for i in range(300)] + [(None, None, None), (7000, "", ""), (7001, "http://x\r\ny", "é")]
    df = spark.createDataFrame(known, "page_id long, url string, html string").selectExpr("*", "'x' AS kind", "'x' AS block").repartition(5)
    found = warc.round_trip(df).collect()
    got = {r["page_id"]: r["html"] for r in found if r["kind"] == "record"}
    assert got == {i: h or "" for i, _, h in known if warc.harm(i) not in ("changed", "cut")}
    assert sum(r["kind"] == "gap" for r in found) >= 1
    assert warc.round_trip(df.limit(0)).collect() == []
