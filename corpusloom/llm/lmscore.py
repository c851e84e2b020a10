"""Operator 10: language-model scoring by compression cross-entropy.

Two zstandard dictionaries are made of the corpus: one of in-domain text (documents labelled good), one of general text (all
others).  A text's compressed size under a dictionary is its cross-entropy under that dictionary's source, and

    score = (general size - in-domain size) / (general size + in-domain size)

is above 0 for a text that is more like the in-domain text than like the rest.

A dictionary is raw content: tokens (runs without white space; a longer run is split into pieces of ``PIECE`` characters, so
that no single text without white space can fill or block a dictionary).  What both sources have alike adds the same to
both sizes, so a token's gain for one of them is its bytes times what its share of that source's tokens is over its share of
the other's.  The tokens of greatest gain are taken, the best last, where zstandard refers to them by the shortest
distances.  Counts are over all documents, both sources in one grouped count, combined before its shuffle; what is gathered
grows with the corpus, and only the best DICTIONARY bytes of either go to the driver and to the tasks.

Defined results: a null text counts as empty; an empty text has score 0.0.  Without in-domain documents the in-domain
dictionary is empty and the general one has the tokens by count and bytes, and the other way round.  Labels: as all labels
of a document say quality 1.  Ties in gain go by token.  Repeated rows count and are scored each.  A text is compressed
whole, however long.  A doc_id that is null or no number is null.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, written

DICTIONARY, LEVEL = 110_000, 9
#: A token of fewer bytes than zstandard's least match gains nothing.
LEAST = 4
#: Characters of a token at most; a dictionary's last 4 * PIECE bytes at most stay free.
PIECE = 32


def token_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(token, n, inside): how often each token occurs in all documents, and in the in-domain ones."""
    good = labels.select(F.col("doc_id").try_cast("long").alias("doc_id"), "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select(F.col("doc_id").alias("_good"))
    good = written(good, "good")
    good = F.broadcast(good) if good.count() <= BROADCAST_ROWS else good
    texts = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = texts.join(good, F.col("doc_id") == F.col("_good"), "left").select(F.when(F.col("_good").isNotNull(), 1).otherwise(0).alias("inside"), F.explode(F.regexp_extract_all("text", F.lit(rf"\S{{1,{PIECE}}}"), F.lit(0))).alias("token"))
    return tokens.where(F.octet_length("token") >= LEAST).groupBy("token").agg(F.count("*").alias("n"), F.sum("inside").alias("inside"))


def dictionaries(counts: DataFrame, size: int = DICTIONARY) -> tuple[bytes, bytes]:
    """In-domain and general: the tokens of greatest gain, best last, up to ``size`` bytes each.

    The bytes of all tokens are first summed by eighths of a power of two of their gain.  Only tokens down to the step at
    which a dictionary is full are sorted, and no more than fit in it are sent to the driver, however many there are.
    """
    total = counts.agg(F.sum("inside").alias("inside"), F.sum(F.col("n") - F.col("inside")).alias("outside")).first()
    share = lambda c, n: (c / F.lit(float(n))) if n else F.lit(0.0)
    over = share(F.col("inside"), total["inside"]) - share(F.col("n") - F.col("inside"), total["outside"])
    known = counts.select("token", (F.octet_length("token") * over).alias("gain"))
    step = F.floor(F.log2(F.abs("gain")) * 8)
    found = known.where("gain <> 0").groupBy((F.col("gain") > 0).alias("inside"), step.alias("step")).agg(F.sum(F.octet_length("token") + 1).alias("bytes")).collect()
    out = []
    for inside in (True, False):
        least, used = None, 0
        for r in sorted((r for r in found if r["inside"] == inside), key=lambda r: -r["step"]):
            if used < size:
                least, used = r["step"], used + r["bytes"]
        made, used = [], 0
        if least is not None:
            mine = known.where((F.col("gain") > 0 if inside else F.col("gain") < 0) & (step >= least))
            for r in mine.orderBy(F.desc(F.abs("gain")), "token").limit(size // (LEAST + 1) + 1).collect():
                token = r["token"].encode() + b" "
                if used + len(token) > size:
                    break
                made.append(token)
                used += len(token)
        out.append(b"".join(reversed(made)))
    return out[0], out[1]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    parts = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if len(content) < 8:
        return zstandard.ZstdCompressor(**parts)
    made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=made, **parts)


def sizes_and_score(inside: zstandard.ZstdCompressor, general: zstandard.ZstdCompressor, text: bytes) -> tuple[int, int, float]:
    if not text:
        return 0, 0, 0.0
    i, g = len(inside.compress(text)), len(general.compress(text))
    return i, g, (g - i) / (g + i)


def scored(docs: DataFrame, labels: DataFrame, size: int = DICTIONARY) -> DataFrame:
    """(doc_id, bytes, inside, general, score) of each document."""
    counts = written(token_counts(docs, labels), "tokens")
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries(counts, size))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, general = map(compressor, sent.value)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                data = text.as_buffer() if text.is_valid else b""
                rows.append((len(data), *sizes_and_score(inside, general, data)))
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "bytes", "inside", "general", "score"])

    return docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, bytes long, inside long, general long, score double")
