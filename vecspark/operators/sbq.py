"""Statistical binary quantization: each dimension becomes a few bits by where it lies against its mean and deviation.

With more than one bit a dimension's level is written in unary, so the number of differing bits of two codes is the sum of their levels' differences.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.functions.vector import distance, vector
from vecspark.options import Metric


def train(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """One row a dimension: pos, mean, std (population), n. Partial sums are made before the shuffle; null vectors are left out."""
    each = df.where(F.col(vec).isNotNull()).select(F.posexplode(F.col(vec).cast("array<double>")).alias("pos", "x"))
    return each.groupBy("pos").agg(F.avg("x").alias("mean"), F.sqrt(F.var_pop("x")).alias("std"), F.count("x").alias("n"))


def quantizer(trained: DataFrame) -> tuple[list[float], list[float]]:
    """Means and deviations by dimension: a row for each dimension, at most 16,000."""
    rows = trained.orderBy("pos").limit(16_000).collect()
    return [r["mean"] for r in rows], [r["std"] for r in rows]


def levels(v, mean: Sequence[float], std: Sequence[float], bits: int) -> Column:
    """Level of each dimension, 0 to ``bits``. One bit: is it above the mean? Without deviation only what is above the mean gets all bits.

    ``mean`` empty: no mean is taken off, one bit says whether a dimension is above zero. The quantizer is one literal, a text that is
    parsed once, rather than two expressions for each dimension.
    """
    if not len(mean):
        return F.transform(vector(v), lambda x: (x > 0).cast("int"))
    pairs = [{"m": float(m), "s": 0.0 if s is None or s != s else float(s)} for m, s in zip(mean, std, strict=True)]
    pair = F.from_json(F.lit(json.dumps(pairs)), "array<struct<m: double, s: double>>")
    if bits == 1:
        return F.zip_with(vector(v), pair, lambda x, p: (x > p["m"]).cast("int"))
    width = 4.0 / (bits + 1)

    def level(x: Column, p: Column) -> Column:
        z = (x - p["m"]) / F.nullif(p["s"], F.lit(0.0))
        return F.when(p["s"] == 0, F.when(x > p["m"], bits).otherwise(0)).otherwise(F.least(F.greatest(F.floor((z + 2) / width), F.lit(0)), F.lit(bits))).cast("int")

    return F.zip_with(vector(v), pair, level)


def code_words(dims: int, bits: int) -> int:
    """Longs of a code."""
    return -(-dims // (64 // bits))


def code(level_array: Column, bits: int) -> Column:
    """Packed longs of 64 bits; each dimension takes ``bits`` of them, the low ones set first."""
    per = 64 // bits

    def word(part: Column) -> Column:
        return F.aggregate(
            F.transform(part, lambda x, i: F.call_function("shiftleft", F.call_function("shiftleft", F.lit(1).cast("long"), x) - 1, (i * bits).cast("int"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)
        )

    n = F.ceil(F.size(level_array) / per).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda w: word(F.slice(level_array, w * per + 1, F.lit(per))))


def level_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)


def candidates(df: DataFrame, query: Sequence[float] | Column, mean, std, bits: int, n: int, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The ``n`` rows nearest by code; ties by key."""
    d = level_distance(levels(vec, mean, std, bits), levels(query, mean, std, bits))
    return df.withColumn("code_distance", d).orderBy("code_distance", key).limit(n)


def search(df: DataFrame, query, mean, std, bits: int, k: int = 10, rescore: int = 50, metric: Metric = Metric.COSINE, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Nearest by code, then the best of ``rescore`` by exact distance; 0: code order alone."""
    if rescore == 0:
        return candidates(df, query, mean, std, bits, k, vec, key)
    near = candidates(df, query, mean, std, bits, max(rescore, k), vec, key)
    return near.withColumn("distance", distance(metric, F.col(vec), query)).orderBy("distance", key).limit(k)
