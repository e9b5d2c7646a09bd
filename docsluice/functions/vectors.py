"""Vector scalars over arrays of doubles, and the slots of hash embeddings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

DIMENSIONS = (384, 768)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; lengths that differ raise."""
    whole = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), whole).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return let(norm(v), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n)))


def cosine(a: Column, b: Column) -> Column:
    """In [-1, 1]; 0 if either vector is zero."""
    return let(norm(a) * norm(b), lambda n: F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n))))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def angle(a: Column, b: Column) -> Column:
    return F.degrees(F.acos(cosine(a, b)))


def flawed(v: Column) -> Column:
    """True if a component is null, NaN or infinite, or there is no vector."""
    return v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def checked(v: Column) -> Column:
    """The vector, or an error if it is flawed."""
    return F.when(flawed(v), F.raise_error(F.lit("vector holds null, NaN or infinite components")).cast("array<double>")).otherwise(v)


def hex_slot(digest: Column, digits: int, dim: int) -> Column:
    """A hex digest as one large number, modulo ``dim``, by Horner's rule over groups of 8 digits."""
    step = (1 << 32) % dim
    out = F.lit(0).cast("bigint")
    for at in range(1, digits, 8):
        out = (out * step + F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")) % dim
    return out.cast("int")


def hex_sign(digest: Column, digits: int) -> Column:
    """+1 if bit 8 of the number is set, else -1."""
    return F.when(F.conv(F.substring(digest, digits - 2, 1), 16, 10).cast("int") % 2 == 1, 1.0).otherwise(-1.0)
