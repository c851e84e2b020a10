"""Binary files of vectors, for exchange with other programs; within the library vectors are Parquet.

Index, version 2: four bytes that name the format (``magic``, which the programs that exchange files agree on), u32 2, u32 and UTF-8 of the model's name, u32 count, u32 size, float32 numbers.  Version 1 has no
model.  Store: u32 1, u64 count, u32 size, then for each vector u32 and UTF-8 of its id and its numbers.  All little-endian.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def index_bytes(vectors: np.ndarray, model: str, magic: bytes) -> bytes:
    name = model.encode()
    return magic + struct.pack("<II", 2, len(name)) + name + struct.pack("<II", *(vectors.shape if len(vectors) else (0, 0))) + vectors.astype("<f4").tobytes()


def read_index(data: bytes, magic: bytes) -> tuple[str, np.ndarray]:
    """The model ('' in version 1) and the vectors; ValueError for anything else or a wrong length."""
    if len(data) < 8 or data[:4] != magic:
        raise ValueError("no vector index")
    version, at, model = struct.unpack_from("<I", data, 4)[0], 8, ""
    if version == 2:
        (n,) = struct.unpack_from("<I", data, at)
        model, at = data[at + 4 : at + 4 + n].decode(), at + 4 + n
    elif version != 1:
        raise ValueError(f"version {version}")
    count, size = struct.unpack_from("<II", data, at)
    if len(data) != at + 8 + count * size * 4:
        raise ValueError("length differs from the header")
    return model, np.frombuffer(data, "<f4", count * size, at + 8).reshape(count, size)


def store_bytes(vectors: dict[str, np.ndarray]) -> bytes:
    size = len(next(iter(vectors.values()))) if vectors else 0
    out = [struct.pack("<IQI", 1, len(vectors), size)]
    for key, v in vectors.items():
        if len(v) != size:
            raise ValueError(f"{key}: {len(v)} numbers, not {size}")
        out += [struct.pack("<I", len(key.encode())), key.encode(), np.asarray(v, "<f4").tobytes()]
    return b"".join(out)


def read_store(data: bytes) -> dict[str, np.ndarray]:
    version, count, size = struct.unpack_from("<IQI", data)
    if version != 1:
        raise ValueError(f"version {version}")
    out, at = {}, 16
    for _ in range(count):
        (n,) = struct.unpack_from("<I", data, at)
        key = data[at + 4 : at + 4 + n].decode()
        out[key] = np.frombuffer(data, "<f4", size, at + 4 + n)
        at += 4 + n + size * 4
    if at != len(data):
        raise ValueError("length differs from the header")
    return out


def read_indices(spark: SparkSession, path: str, magic: bytes) -> DataFrame:
    """(path, id, embedding, model) of all index files in ``path``; ids are places in the file."""

    def rows(name: str, content: bytes) -> pa.Table:
        model, vectors = read_index(content, magic)
        return _table(name, [f"embedding_{i}" for i in range(len(vectors))], vectors, model)

    return _read(spark, path, "*.bin", rows)


def read_stores(spark: SparkSession, path: str) -> DataFrame:
    """(path, id, embedding, model) of all store files in ``path``; a store names no model."""

    def rows(name: str, content: bytes) -> pa.Table:
        found = read_store(content)
        return _table(name, list(found), np.array(list(found.values()), np.float32).reshape(len(found), -1 if found else 0), "")

    return _read(spark, path, "*.bin", rows)


def _table(name: str, ids: list[str], vectors: np.ndarray, model: str) -> pa.Table:
    size = vectors.shape[1] if len(vectors) else 0
    lists = pa.ListArray.from_arrays(np.arange(len(ids) + 1, dtype=np.int32) * size, pa.array(vectors.astype(np.float32).ravel()))
    return pa.table({"path": pa.array([name] * len(ids), pa.string()), "id": pa.array(ids, pa.string()), "embedding": lists, "model": pa.array([model] * len(ids), pa.string())})


def _read(spark: SparkSession, path: str, pattern: str, rows) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                yield from rows(name, content.as_py()).to_batches(max_chunksize=4096)

    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content").mapInArrow(read, "path string, id string, embedding array<float>, model string")


def write_indices(vectors: DataFrame, path: str, model: str, magic: bytes) -> None:
    """The column ``embedding`` as index files, one for each partition of the table, in the order of its rows."""
    _write(vectors.select("embedding"), path, lambda ids, rows: index_bytes(rows, model, magic))


def write_stores(vectors: DataFrame, path: str, key: str = "id") -> None:
    """(key, embedding) as store files, one for each partition of the table."""
    _write(vectors.select("embedding", F.col(key).cast("string").alias("id")), path, lambda ids, rows: store_bytes(dict(zip(ids, rows, strict=True))))


def _write(vectors: DataFrame, path: str, made) -> None:
    """One file a task, put in place whole; a task that is run again replaces its file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        ids, parts = [], []
        for batch in batches:
            if "id" in batch.schema.names:
                ids += batch.column("id").to_pylist()
            parts += [np.array(x.values.to_numpy(zero_copy_only=False), np.float32) for x in batch.column("embedding")]
        if parts:
            fs, inner = pyarrow.fs.FileSystem.from_uri(path)
            fs.create_dir(inner, recursive=True)
            name = f"part-{task.partitionId():06d}.bin"
            with fs.open_output_stream(f"{inner}/_{task.taskAttemptId()}-{name}", compression=None) as out:
                out.write(made(ids, np.stack(parts)))
            fs.move(f"{inner}/_{task.taskAttemptId()}-{name}", f"{inner}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([len(parts)], pa.int64())], ["n"])

    vectors.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def rebuild(spark: SparkSession, source: str, indices: str, stores: str, magic: bytes) -> DataFrame:
    """Index and store files of an embeddings document, written anew; (id, embedding) of the document's rows that differ from what was written."""
    from .kb_json import read_embeddings

    rows = read_embeddings(spark, source)
    model = (rows.select("model").first() or [""])[0] or ""
    write_indices(rows, indices, model, magic)
    write_stores(rows, stores)
    again = read_stores(spark, stores).select("id", F.col("embedding").alias("_again"))
    return rows.select("id", "embedding").join(again, "id", "left").where("NOT (embedding <=> _again)").select("id", "embedding")
