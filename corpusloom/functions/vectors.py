"""Column functions on vectors (arrays of numbers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; 0 where the lengths differ."""
    both = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(both, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0 or the lengths differ."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def normalized(a: Column) -> Column:
    """The vector over its length; unchanged where that is 1e-12 or less."""
    # The norm is the one element of an array, so it is computed once and not for each number.
    scaled = F.transform(F.array(norm(a)), lambda n: F.when(n > 1e-12, F.transform(a, lambda x: x.cast("double") / n)).otherwise(a.cast("array<double>")))
    return F.get(scaled, F.lit(0))


def dummy_embedding(text: Column, size: int = 384) -> Column:
    """A unit vector that depends on the text alone, for runs without a model: digests of (the text's digest, place) in [-1, 1]."""
    # The text is hashed once, as the one element of an array, and not for each place.
    number = lambda h, i: F.conv(F.substring(F.md5(F.concat(h, F.lit(":"), i.cast("string"))), 1, 8), 16, 10).cast("double") / 2147483648.0 - 1
    raw = F.transform(F.array(F.md5(text)), lambda h: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: number(h, i)))
    return F.get(F.transform(raw, lambda v: normalized(v)), F.lit(0)).cast("array<float>")
