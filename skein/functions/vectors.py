"""Hashed term-frequency vectors and their similarity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import terms

DIMENSIONS = 100


def bucket(term: Column, dimensions: int = DIMENSIONS) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint"), F.lit(dimensions)).cast("int")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def vectorize(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Unit vector of term frequencies by bucket; zeros for a text without terms."""

    def counts(buckets: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: (F.size(buckets) - F.size(F.array_remove(buckets, i))).cast("double"))

    def unit(c: Column) -> Column:
        norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
        return let(norm, lambda n: F.transform(c, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))))

    return let(F.transform(terms(text), lambda t: bucket(t, dimensions)), lambda b: let(counts(b), unit))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """For unit vectors, within 0 and 1; 0 for different lengths."""
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b))))
