"""Operator 7: media columns.  Netpbm and BMP pictures to NPY tiles with difference hashes.

A picture (P1 to P7, or BMP of 1, 4, 8, 24 or 32 bits, uncompressed, from either side) is decoded to a numpy array of
height x width x channels of 8 bits (opacity is left out), resized to ``SIDE`` x ``SIDE`` by exact area means, and cut into tiles of ``TILE``
x ``TILE``; each tile is an NPY file in a binary column with a 64-bit difference hash.

Area means come from the integral image: its value between pixels is linear in either direction, so four values give
the exact integral over a box with any edges, and a resize costs one pass over the picture, whatever the scale.

Plan.  One pass over the media column, batch by batch; nothing is shuffled, and a task holds one picture and its integral
image.

Defined results: a null, empty, truncated or otherwise unreadable picture gives one row with ``error`` and null tile
columns, whatever its bytes are.  Samples of 16 bits are scaled to 8.  A maximum that isn't 255 is scaled; samples over it are cut to it.  Bytes
after a picture's last sample are ignored.  Equal neighbours give a 0 bit.  Repeated rows give rows of their own.
"""

from __future__ import annotations

import functools
import io
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE, TILE = 64, 32
SCHEMA = "format string, height int, width int, channels int, picture_hash long, tile_row int, tile_column int, npy binary, tile_hash long, error string"
_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.string()]
_GREY = np.array([0.299, 0.587, 0.114])


class Unreadable(ValueError):
    pass


_SPACE = re.compile(rb"(?:\s+|#[^\n]*)*")
_NUMBER = re.compile(rb"[0-9]{1,9}(?![0-9])")


def _header(data: bytes, n: int) -> tuple[list[int], int]:
    """n numbers of a Netpbm header, and where the samples begin: after one white space."""
    out, at = [], 2
    while len(out) < n:
        at = _SPACE.match(data, at).end()
        number = _NUMBER.match(data, at)
        if not number:
            raise Unreadable("header")
        out.append(int(number[0]))
        at = number.end()
    if at >= len(data) or not data[at : at + 1].isspace():
        raise Unreadable("truncated")
    return out, at + 1


def _plain(data: bytes, at: int, n: int, most: int) -> np.ndarray:
    """n decimal numbers from ``at`` on, parted by white space and comments; what is over ``most`` is ``most``."""
    body = np.frombuffer(re.sub(rb"#[^\n]*", b" ", data[at:]) if b"#" in data[at:] else data[at:], np.uint8)
    ink = ~_BLANK[body]
    edge = np.diff(np.concatenate([[False], ink, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1)[:n], np.flatnonzero(edge == -1)[:n]
    if len(start) < n:
        raise Unreadable("truncated")
    digit = body - np.uint8(48)
    if (ink & (digit > 9))[: end[-1]].any():
        raise Unreadable("sample")
    size = end - start
    out = np.zeros(n, np.int64)
    for j in range(int(min(size.max(), 17))):
        some = size > j
        out[some] = out[some] * 10 + digit[start[some] + j]
    for i in np.flatnonzero(size > 17):
        long = body[start[i] : end[i]].tobytes().lstrip(b"0")
        out[i] = int(long or b"0") if len(long) < 18 else most
    return np.minimum(out, most)


_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def _taken(data: bytes, at: int, n: int, kind: str) -> np.ndarray:
    if n * np.dtype(kind).itemsize > len(data) - at:
        raise Unreadable("truncated")
    return np.frombuffer(data, kind, n, at)


def netpbm(data: bytes) -> np.ndarray:
    kind = data[1:2]
    bits = kind in b"14"
    if kind == b"7":
        width, height, channels, most, at = _arbitrary(data)
    else:
        (width, height, *limit), at = _header(data, 2 if bits else 3)
        most = limit[0] if limit else 1
        channels = 3 if kind in b"36" else 1
    if not width or not height or not 0 < most < 65536:
        raise Unreadable("size")
    n = width * height * channels
    if kind == b"4":
        row = (width + 7) // 8
        out = np.unpackbits(_taken(data, at, row * height, "u1").reshape(height, row), axis=1)[:, :width]
    elif kind in b"567":
        out = _taken(data, at, n, "u1" if most < 256 else ">u2")
    elif n > len(data):
        raise Unreadable("truncated")
    elif kind == b"1":
        body = re.sub(rb"#[^\n]*", b"", data[at:]) if b"#" in data[at:] else data[at:]
        out = np.frombuffer(body, np.uint8)
        out = out[~_BLANK[out]][:n] - np.uint8(48)
        if len(out) < n:
            raise Unreadable("truncated")
        if (out > 1).any():
            raise Unreadable("sample")
    else:
        out = _plain(data, at, n, most)
    out = out.reshape(height, width, channels)
    if bits:
        return ((1 - out) * 255).astype(np.uint8)
    if kind == b"7":
        out = out[:, :, : channels - (channels in (2, 4))]
    return np.ascontiguousarray(out) if most == 255 and out.dtype == np.uint8 else (np.minimum(out, most).astype(np.int64) * 255 // most).astype(np.uint8)


def _arbitrary(data: bytes) -> tuple[int, int, int, int, int]:
    """Width, height, channels, maximum of a P7 header, and where the samples begin."""
    end = re.compile(rb"^ENDHDR[ \t]*\n", re.M).search(data)
    if not end:
        raise Unreadable("header")
    said = dict(re.findall(rb"^[ \t]*(WIDTH|HEIGHT|DEPTH|MAXVAL)[ \t]+([0-9]{1,9})[ \t]*$", data[: end.start()], re.M))
    if len(said) < 4:
        raise Unreadable("header")
    width, height, depth, most = (int(said[x]) for x in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"))
    if not 1 <= depth <= 4:
        raise Unreadable("depth")
    return width, height, depth, most, end.end()


def bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise Unreadable("truncated")
    at = struct.unpack_from("<I", data, 10)[0]
    size, width, height, _, depth, packing = struct.unpack_from("<IiiHHI", data, 14)
    if size < 40 or packing != 0 or depth not in (1, 4, 8, 24, 32):
        raise Unreadable("kind of BMP")
    top_down, height = height < 0, abs(height)
    if width <= 0 or not height:
        raise Unreadable("size")
    row = (width * depth + 31) // 32 * 4
    rows = _taken(data, at, row * height, "u1").reshape(height, row)
    if not top_down:
        rows = rows[::-1]
    if depth >= 24:
        return np.ascontiguousarray(rows[:, : width * depth // 8].reshape(height, width, depth // 8)[:, :, 2::-1])
    used = struct.unpack_from("<I", data, 46)[0] or 1 << depth
    palette = _taken(data, 14 + size, min(used, 256) * 4, "u1").reshape(-1, 4)[:, 2::-1]
    if depth == 8:
        index = rows[:, :width]
    else:
        bit = np.unpackbits(rows, axis=1)[:, : width * depth]
        index = bit if depth == 1 else bit.reshape(height, width, 4) @ np.array([8, 4, 2, 1], np.uint8)
    if index.max() >= len(palette):
        raise Unreadable("colour outside the palette")
    return palette[index]


def decoded(data: bytes | None) -> tuple[str, np.ndarray]:
    """Format, and height x width x channels of 8 bits."""
    if not data:
        raise Unreadable("empty")
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6", b"7"):
        return data[:2].decode(), netpbm(data)
    if data[:2] == b"BM":
        return "BMP", bmp(data)
    raise Unreadable("unknown format")


def integral(picture: np.ndarray) -> np.ndarray:
    """Sums over all pixels above and to the left of each corner of the pixels' grid."""
    h, w = picture.shape[:2]
    out = np.zeros((h + 1, w + 1, picture.shape[2]))
    np.cumsum(picture, 0, dtype=np.float64, out=out[1:, 1:])
    np.cumsum(out[1:, 1:], 1, out=out[1:, 1:])
    return out


@functools.lru_cache(4096)
def _edges(n: int, into: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(into + 1) * (n / into)
    low = np.minimum(at.astype(np.int64), n - 1)
    return low, at - low


def means(sums: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean over each of height x width equal boxes of the picture with these sums, as fractions."""
    h, w = sums.shape[0] - 1, sums.shape[1] - 1
    low, part = _edges(h, height)
    rows = sums[low]
    rows += (sums[low + 1] - rows) * part[:, None, None]
    low, part = _edges(w, width)
    both = rows[:, low]
    both += (rows[:, low + 1] - both) * part[None, :, None]
    strips = both[1:] - both[:-1]
    return (strips[:, 1:] - strips[:, :-1]) * (height * width / (h * w))


def resized(picture: np.ndarray, height: int, width: int) -> np.ndarray:
    return means(integral(picture), height, width)


def _hashes(small: np.ndarray) -> np.ndarray:
    """Signed 64-bit numbers of pictures x 8 x 9 area means of grey: whether each is brighter than the one before, row by row."""
    return np.packbits((small[:, :, 1:] - small[:, :, :-1] > 1e-6).reshape(len(small), 64), axis=1).view(">i8")[:, 0].astype(np.int64)


def _grey(means: np.ndarray) -> np.ndarray:
    return means[..., 0] if means.shape[-1] == 1 else means @ _GREY


def difference_hash(picture: np.ndarray) -> int:
    """64 bits: in 8 rows of 9 area means of grey, whether each is brighter than the one before; row by row, as a signed number."""
    return int(_hashes(_grey(resized(picture, 8, 9))[None])[0])


_headers: dict[tuple, bytes] = {}


def npy(tile: np.ndarray) -> bytes:
    if tile.shape not in _headers:
        out = io.BytesIO()
        np.lib.format.write_array_header_1_0(out, {"descr": "|u1", "fortran_order": False, "shape": tile.shape})
        _headers[tile.shape] = out.getvalue()
    return _headers[tile.shape] + tile.tobytes()


def tiles_of(data: bytes | None, side: int = SIDE, tile: int = TILE) -> list[tuple]:
    """Rows of SCHEMA for one picture."""
    try:
        kind, picture = decoded(data)
    except (ValueError, ArithmeticError, IndexError, struct.error, MemoryError) as e:  # Unreadable, and what damage may cause besides
        return [(None,) * 9 + (str(e) or type(e).__name__,)]
    sums, channels = integral(picture), picture.shape[2]
    small = np.rint(means(sums, side, side)).astype(np.uint8)
    known = (kind, *picture.shape, int(_hashes(_grey(means(sums, 8, 9))[None])[0]))
    places = [(r, c) for r in range(0, side, tile) for c in range(0, side, tile)]
    parts = [small[r : r + tile, c : c + tile] for r, c in places]
    if side % tile:
        found = [difference_hash(x) for x in parts]
    else:
        # All tiles are one picture with as many channels, so one pass makes all their means.
        each = means(integral(np.concatenate(parts, 2)), 8, 9).reshape(8, 9, len(parts), channels)
        found = _hashes(np.ascontiguousarray(_grey(each).transpose(2, 0, 1))).tolist()
    return [(*known, r // tile, c // tile, npy(x), h, None) for (r, c), x, h in zip(places, parts, found, strict=True)]


def tiled(media: DataFrame, key: str, column: str, side: int = SIDE, tile: int = TILE) -> DataFrame:
    """(key, SCHEMA): the tiles of each picture in the binary ``column``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = [(k, *row) for k, data in zip(part.column(0), part.column(1), strict=True) for row in tiles_of(data.as_py(), side, tile)]
                columns = [pa.array([r[0].as_py() for r in rows], part.column(0).type), *(pa.array(x, t) for x, t in zip(list(zip(*rows, strict=True))[1:], _TYPES, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names)

    narrow = media.select(F.col(key), F.col(column).cast("binary"))
    kind = narrow.schema[0].dataType.simpleString()
    names = [key, *(x.split()[0] for x in SCHEMA.split(", "))]
    return narrow.mapInArrow(make, f"`{key}` {kind}, {SCHEMA}")


def write_tiles(media: DataFrame, key: str, column: str, path: str, **parameters) -> None:
    tiled(media, key, column, **parameters).write.parquet(path)


def encoded(kind: str, picture: np.ndarray) -> bytes:
    """A picture in one of the formats that are read, for pictures made of other bytes and for tests."""
    height, width, channels = picture.shape
    if kind.startswith("BMP"):
        depth = int(kind[3:])
        flat = {24: picture[:, :, ::-1].reshape(height, -1), 8: picture[:, :, 0]}[depth]
        padded = np.zeros((height, (width * depth + 31) // 32 * 4), np.uint8)
        padded[:, : flat.shape[1]] = flat
        palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1).tobytes() if depth == 8 else b""
        return b"BM" + struct.pack("<IHHI", 54 + len(palette) + padded.size, 0, 0, 54 + len(palette)) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, depth, 0, padded.size, 0, 0, 0, 0) + palette + padded[::-1].tobytes()
    head = f"{kind}\n# made\n{width} {height}\n".encode()
    if kind in ("P1", "P4"):
        bits = (picture[:, :, 0] < 128).astype(np.uint8)
        return head + (np.packbits(bits, axis=1).tobytes() if kind == "P4" else np.append(bits + np.uint8(48), np.full((height, 1), 10, np.uint8), 1).tobytes())
    if kind in ("P5", "P6"):
        return head + b"255\n" + picture.tobytes()
    # Three figures and a space for each sample; the last of a row is followed by a line's end.
    flat = picture.reshape(height, -1)
    figures = np.empty((*flat.shape, 4), np.uint8)
    for j, power in enumerate((100, 10, 1)):
        figures[:, :, j] = flat // power % 10 + 48
    figures[:, :, 3] = 32
    figures[:, -1, 3] = 10
    return head + b"255\n" + figures.tobytes()


KINDS = {"P1": 1, "P2": 1, "P3": 3, "P4": 1, "P5": 1, "P6": 3, "BMP8": 1, "BMP24": 3}


def pictures_of(pages: DataFrame, width: int = 48) -> DataFrame:
    """(page_id, media): the bytes of each page's html as the samples of a picture, as the tables have no media; formats take turns."""
    kinds = list(KINDS.items())

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                out = []
                for k, html in zip(part.column("page_id").to_pylist(), part.column("html"), strict=True):
                    kind, channels = kinds[(k or 0) % len(kinds)]
                    data = np.frombuffer(html.as_buffer(), np.uint8) if html.is_valid else np.zeros(0, np.uint8)
                    padded = np.zeros(-(-len(data) // (width * channels)) * width * channels, np.uint8)
                    padded[: len(data)] = data
                    out.append(encoded(kind, padded.reshape(-1, width, channels)) if len(data) else None)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(out, pa.binary())], ["page_id", "media"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(make, "page_id long, media binary")
