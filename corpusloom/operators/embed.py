"""Texts to vectors: by a model in ONNX format, or without one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dummy_embedding

MOST_TOKENS, BATCH = 512, 64


def without_model(chunks: DataFrame, size: int = 384, content: str = "content") -> DataFrame:
    """chunks with ``embedding``, made of the text's hash in the JVM."""
    return chunks.withColumn("embedding", dummy_embedding(F.col(content), size))


def mean_pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Unit vectors: the mean of the last states of each text's own tokens; zero where it has none."""
    weight = mask[:, :, None].astype(np.float32)
    mean = (states * weight).sum(1) / np.maximum(weight.sum(1), 1e-9)
    length = np.linalg.norm(mean, axis=1, keepdims=True)
    return np.where(length > 1e-12, mean / np.maximum(length, 1e-12), mean).astype(np.float32)


def onnx_encoder(model: str, tokenizer: str) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A maker of encoders for workers; model and tokenizer are files that every worker reaches."""

    def make() -> Callable[[list[str]], np.ndarray]:
        import onnxruntime
        from tokenizers import Tokenizer

        tokens = Tokenizer.from_file(tokenizer)
        tokens.enable_truncation(MOST_TOKENS)
        tokens.enable_padding()
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1  # a task has one core
        session = onnxruntime.InferenceSession(model, options)
        names = {i.name for i in session.get_inputs()}

        def encode(texts: list[str]) -> np.ndarray:
            coded = tokens.encode_batch(texts)
            mask = np.array([c.attention_mask for c in coded], np.int64)
            given = {"input_ids": np.array([c.ids for c in coded], np.int64), "attention_mask": mask, "token_type_ids": np.array([c.type_ids for c in coded], np.int64)}
            return mean_pooled(session.run(None, {k: v for k, v in given.items() if k in names})[0], mask)

        return encode

    return make


def embedded(chunks: DataFrame, encoder: Callable[[], Callable[[list[str]], np.ndarray]], key: str = "id", content: str = "content") -> DataFrame:
    """(key, embedding): one encoder a task, batches of BATCH texts; join with the chunks by key for the rest."""
    kind = chunks.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                vectors = encode([t or "" for t in part.column(content).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(list(vectors), pa.list_(pa.float32()))], [key, "embedding"])

    return chunks.select(key, content).mapInArrow(run, f"`{key}` {kind}, embedding array<float>")


def embed_query(text: str, encoder: Callable[[], Callable[[list[str]], np.ndarray]]) -> list[float]:
    return encoder()([text])[0].tolist()
