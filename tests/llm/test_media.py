import io
import struct
import time
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import media


def picture(h, w, c, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, c), np.uint8)


@pytest.mark.parametrize("kind", media.KINDS)
def test_round_trip(kind):
    for h, w in ((1, 1), (5, 9), (16, 31)):
        p = picture(h, w, media.KINDS[kind])
        if kind in ("P1", "P4"):
            p = (p >= 128).astype(np.uint8) * 255
        name, got = media.decoded(media.encoded(kind, p))
        assert name == kind[:3].rstrip("28") if kind.startswith("BMP") else name == kind
        assert (got == (np.repeat(p, 3, 2) if kind == "BMP8" else p)).all()


def bmp(depth, rows, width, height, palette=b""):
    return b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + len(palette)) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, depth, 0, 0, 0, 0, len(palette) // 4, 0) + palette + rows


def test_other_bitmaps():
    two = bytes([1, 2, 3, 0, 9, 8, 7, 0])
    assert media.decoded(bmp(1, bytes([0b01000000, 0, 0, 0]), 2, 1, two))[1].tolist() == [[[3, 2, 1], [7, 8, 9]]]
    assert media.decoded(bmp(4, bytes([0x10, 0, 0, 0]), 2, -1, two))[1].tolist() == [[[7, 8, 9], [3, 2, 1]]]
    assert media.decoded(bmp(32, bytes(range(8)), 1, -2))[1].tolist() == [[[2, 1, 0]], [[6, 5, 4]]]


def test_netpbm_headers_and_maxima():
    assert media.decoded(b"P2 # note\n2 # w\n1\n#\n10 # most\n5 # five\n20")[1].ravel().tolist() == [127, 255]
    assert media.decoded(b"P5 1 1 65535\n\x80\x00")[1].ravel().tolist() == [127]
    assert media.decoded(b"P1\n3 1\n1 01")[1].ravel().tolist() == [0, 255, 0]


@pytest.mark.parametrize("data", [None, b"", b"P", b"P5", b"P5 2 2 255\nabc", b"P5 0 1 255\n", b"P3 1 1 255\n1 x 2", b"P2 1 1 9\n-4", b"P7 junk", b"P7\nWIDTH 1\nHEIGHT 1\nDEPTH 5\nMAXVAL 255\nENDHDR\nabcde", b"P7\nWIDTH 9\nHEIGHT 9\nDEPTH 1\nMAXVAL 255\nENDHDR\nabcde", b"P2 1 1 255\n1x", b"P2 2 2 255\n1 2 3", b"BM", b"BM" + bytes(60), b"GIF89a", b"P5 99999999 99999999 255\n1", b"P5 12345678901 1 1\n", b"P1 1 1\n7"])
def test_unreadable(data):
    rows = media.tiles_of(data)
    assert len(rows) == 1 and rows[0][:9] == (None,) * 9 and rows[0][9]


def test_numbers_of_any_length():
    assert media.decoded(b"P2 3 1 255\n12345678901234567890123 000000000000000000000000000007 999")[1].ravel().tolist() == [255, 7, 255]
    assert media.decoded(b"P3 1 1 1000\n1000 500 0 and whatever")[1].ravel().tolist() == [255, 127, 0]


def test_arbitrary_map():
    head = b"P7\n# made\nWIDTH 2\nHEIGHT 1\nDEPTH %d\nMAXVAL 255\nTUPLTYPE X\nENDHDR\n"
    assert media.decoded(head % 4 + bytes(range(8)))[1].tolist() == [[[0, 1, 2], [4, 5, 6]]]
    assert media.decoded(head % 2 + bytes(range(4)))[1].tolist() == [[[0], [2]]]
    assert media.decoded(head % 1 + b"\x05\x06")[1].tolist() == [[[5], [6]]]


@settings(max_examples=400, deadline=None)
@given(st.data())
def test_damaged_bytes_end_in_rows(data):
    kind = data.draw(st.sampled_from(list(media.KINDS)))
    made = bytearray(media.encoded(kind, picture(5, 7, media.KINDS[kind])))
    for _ in range(data.draw(st.integers(0, 5))):
        made[data.draw(st.integers(0, min(60, len(made) - 1)))] = data.draw(st.integers(0, 255))
    rows = media.tiles_of(bytes(made[: data.draw(st.integers(0, len(made)))]))
    assert len(rows) in (1, 4) and (rows[0][-1] is None) == (len(rows) == 4)


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([b"P1", b"P2", b"P3", b"P4", b"P5", b"P6", b"P7", b"BM", b""]), st.text("0123456789 \n#-x", max_size=60), st.binary(max_size=60))
def test_random_bytes_end_in_rows(magic, text, rest):
    assert len(media.tiles_of(magic + text.encode() + rest)) in (1, 4)


def test_many_comment_lines_take_linear_time():
    start = time.perf_counter()
    assert len(media.tiles_of(b"P2\n" + b"#\n" * 400_000 + b"1 1 255 7")) == 4
    assert time.perf_counter() - start < 5


def exact_hash(p):
    """The difference hash by fractions and plain loops."""
    h, w, c = p.shape
    means = []
    for r in range(8):
        row = []
        for k in range(9):
            total = [Fraction(0)] * c
            for y in range(h):
                for x in range(w):
                    part = max(Fraction(0), min(Fraction(y + 1), Fraction((r + 1) * h, 8)) - max(Fraction(y), Fraction(r * h, 8))) * max(Fraction(0), min(Fraction(x + 1), Fraction((k + 1) * w, 9)) - max(Fraction(x), Fraction(k * w, 9)))
                    if part:
                        total = [t + part * int(v) for t, v in zip(total, p[y, x])]
            mean = [t * 72 / (h * w) for t in total]
            row.append(mean[0] if c == 1 else sum(m * g for m, g in zip(mean, (Fraction("0.299"), Fraction("0.587"), Fraction("0.114")))))
        means.append(row)
    bits = "".join("1" if row[k + 1] - row[k] > Fraction(1, 10**6) else "0" for row in means for k in range(8))
    n = int(bits, 2)
    return n - (1 << 64) if n >> 63 else n


def test_hashes_against_brute_force():
    for h, w, c in ((1, 1, 1), (5, 9, 3), (17, 4, 1), (12, 20, 3)):
        assert media.difference_hash(picture(h, w, c, h)) == exact_hash(picture(h, w, c, h))
    for kind in ("P6", "BMP8", "P5"):
        p = picture(11, 13, media.KINDS[kind], 3)
        data = media.encoded(kind, p)
        whole = media.decoded(data)[1]
        for row in media.tiles_of(data, 16, 8):
            tile = np.load(io.BytesIO(row[7]))
            assert row[8] == exact_hash(tile) and row[4] == exact_hash(whole)


def test_area_means_against_brute_force():
    for h, w, c in ((7, 5, 3), (64, 64, 1), (3, 100, 1), (1, 1, 3), (130, 70, 3)):
        p = picture(h, w, c, h)
        big = np.repeat(np.repeat(p.astype(float), 8, 0), 12, 1)  # a whole number of pixels in each box
        want = big.reshape(8, h, 12, w, c).mean((1, 3))
        assert np.allclose(media.resized(p, 8, 12), want)


def test_hash():
    rising = np.tile(np.arange(90, dtype=np.uint8), (16, 1))[:, :, None]
    assert media.difference_hash(rising) == -1
    assert media.difference_hash(rising[:, ::-1]) == 0
    assert media.difference_hash(np.full((9, 9, 3), 77, np.uint8)) == 0
    p = picture(120, 120, 3)
    close = np.clip(p.astype(int) + 1, 0, 255).astype(np.uint8)
    assert bin((media.difference_hash(p) ^ media.difference_hash(close)) & (2**64 - 1)).count("1") <= 6


def test_table(spark):
    p = picture(40, 50, 3)
    rows = [(1, media.encoded("P6", p), "x"), (2, None, "x"), (2, b"junk", "x"), (None, media.encoded("BMP24", p), "x"), (1, media.encoded("P6", p), "x")]
    df = spark.createDataFrame([(k, bytearray(m) if m is not None else None, x) for k, m, x in rows], "id long, media binary, npy string")
    got = media.tiled(df, "id", "media").collect()
    assert len(got) == 3 * 4 + 2
    whole = np.rint(media.resized(p, 64, 64)).astype(np.uint8)
    for r in got:
        if r["error"] is None:
            tile = np.load(io.BytesIO(r["npy"]))
            part = whole[r["tile_row"] * 32 :, r["tile_column"] * 32 :][:32, :32]
            assert (tile == part).all() and r["tile_hash"] == media.difference_hash(part)
    assert media.tiled(df.limit(0), "id", "media").collect() == []


def test_pictures_of_pages(spark):
    pages = spark.createDataFrame([(i, "<html>" + "x" * (i * 100)) for i in range(8)] + [(None, None), (9, "")], "page_id long, html string")
    got = media.tiled(media.pictures_of(pages), "page_id", "media").collect()
    assert {r["page_id"] for r in got if r["error"] is None} == set(range(8))
    assert {r["page_id"] for r in got if r["error"]} == {None, 9}


def test_written(spark, tmp_path):
    df = spark.createDataFrame([(1, bytearray(media.encoded("P5", picture(9, 9, 1))))], "id long, media binary")
    media.write_tiles(df, "id", "media", str(tmp_path / "tiles"))
    assert np.load(io.BytesIO(spark.read.parquet(str(tmp_path / "tiles")).first()["npy"])).shape == (32, 32, 1)
