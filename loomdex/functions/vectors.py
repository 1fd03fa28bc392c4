"""Expressions on vectors kept as arrays; arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BINARY_LEVELS = 127


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def bound(value: Column, made) -> Column:
    """made(value), with value computed once however often made reads it, inside lambdas too."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_double(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def normalised(v: Column) -> Column:
    """The vector at length 1; a zero vector as it is."""
    scaled = lambda d, n: F.when(n == 0, d).otherwise(F.transform(d, lambda x: x / n))
    return bound(_double(v), lambda d: bound(norm(d), lambda n: scaled(d, n)))


def fallback_embedding(text: Column) -> Column:
    """256 numbers from the text's hash alone: 32 bytes centred on zero, then zeros; at length 1."""
    byte = lambda digest, i: F.conv(F.substring(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 255 - 0.5
    head = bound(F.sha2(text, 256), lambda digest: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: byte(digest, i)))
    return normalised(F.concat(head, F.array_repeat(F.lit(0.0), 224)))


def scalar_code(v: Column, bound: Column) -> Column:
    """Each number as an integer from -127 to 127 of the bound, halves up."""
    return F.transform(_double(v), lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x / bound * BINARY_LEVELS + 0.5))).cast("int"))


def code_dot(a: Column, b: Column) -> Column:
    """Dot product of two codes."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y), F.lit(0).cast("long"), lambda s, x: s + x)


def sign_bits(v: Column) -> Column:
    """Signs as an array of 32-bit words, 1 for above zero, first number lowest."""
    words = F.floor((F.size(v) + 31) / 32).cast("int")
    bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    word = lambda w: F.aggregate(F.transform(F.slice(v, w * 32 + 1, F.lit(32)), bit), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(F.size(v) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), words - 1), word))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of sign words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
