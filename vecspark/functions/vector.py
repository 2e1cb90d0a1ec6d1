"""Vector functions as Catalyst expressions, in double precision."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this squared length a vector counts as zero and stays as it is.
EPSILON = 1.1920929e-07


def vector(v: Column | str | Sequence[float]) -> Column:
    """A column as doubles; a sequence as a literal."""
    if isinstance(v, Column):
        return v.cast("array<double>")
    if isinstance(v, str):
        return F.col(v).cast("array<double>")
    return F.array(*[F.lit(float(x)) for x in v])


def _fold(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def dot(a, b) -> Column:
    return _fold(F.zip_with(vector(a), vector(b), lambda x, y: x * y))


def norm(v) -> Column:
    return F.sqrt(_fold(F.transform(vector(v), lambda x: x * x)))


def l2_sq(a, b) -> Column:
    """Squared Euclidean distance, the order in which an index compares."""
    return _fold(F.zip_with(vector(a), vector(b), lambda x, y: (x - y) * (x - y)))


def l2_sq_few(a, b, dims: int) -> Column:
    """As ``l2_sq``, for a known, small number of dimensions: one sum without a loop."""
    a, b = vector(a), vector(b)
    terms = [(a[k] - b[k]) * (a[k] - b[k]) for k in range(dims)]
    return sum(terms[1:], terms[0]) if terms else F.lit(0.0)


def l2(a, b) -> Column:
    return F.sqrt(l2_sq(a, b))


def neg_inner_product(a, b) -> Column:
    """Negated, so that smaller is nearer."""
    return -dot(a, b)


def _length(v) -> Column:
    """The norm; of a given sequence it is computed here, once, and not for every row."""
    if isinstance(v, Column | str):
        return norm(v)
    return F.lit(math.sqrt(math.fsum(float(x) ** 2 for x in v)))


def cosine(a, b) -> Column:
    """1 - cosine similarity, from 0 to 2; NaN if either vector is zero."""
    size = _length(a) * _length(b)
    return F.when(size == 0, F.lit(float("nan"))).otherwise(F.greatest(F.lit(0.0), 1 - dot(a, b) / F.nullif(size, F.lit(0.0))))


def cosine_unit(a, b) -> Column:
    """Cosine distance of vectors that already have length 1."""
    return F.greatest(F.lit(0.0), 1 - dot(a, b))


def normalize(v) -> Column:
    """Length 1; a zero vector stays zero."""
    v = vector(v)
    n = norm(v)
    # the norm is an array of its own, as a function of each element would take it anew for each
    size = F.array_repeat(F.nullif(n, F.lit(0.0)), F.size(v))
    return F.when(n * n < EPSILON, v).otherwise(F.zip_with(v, size, lambda x, m: x / m))


def prefix(v, d: int) -> Column:
    """The first ``d`` dimensions; shorten before normalizing."""
    return F.slice(vector(v), 1, d)


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two arrays of longs differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def zero_vector(d: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), d)


DISTANCES = {0: cosine, 1: l2, 2: neg_inner_product}


def distance(metric: int, a, b) -> Column:
    """The distance that the metric's operator returns."""
    return DISTANCES[int(metric)](a, b)
