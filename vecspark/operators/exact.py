"""Exact search: plain expressions, so filters and column pruning reach the scan and a limit becomes a distributed top-k."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark.functions import labels_overlap
from vecspark.functions.vector import distance
from vecspark.options import Metric


def with_distance(df: DataFrame, query: Sequence[float] | Column | None, vector: str = "embedding", metric: Metric = Metric.COSINE, name: str = "distance") -> DataFrame:
    """Adds the distance; null for a null query."""
    return df.withColumn(name, F.lit(None).cast("double") if query is None else distance(metric, F.col(vector), query))


def nearest(
    df: DataFrame, query: Sequence[float] | Column | None, k: int | None = 10, *, vector: str = "embedding", key: str = "vec_id", metric: Metric = Metric.COSINE,
    labels: Sequence[int] | None = None, labels_col: str = "labels", where: Column | str | None = None, then_by: Sequence[Column] = (),
) -> DataFrame:
    """Rows by distance from ``query``, ties by ``then_by`` and ``key``. ``k`` None: all of them.

    ``labels``: only rows with one of them; ``where``: any other condition. A null query gives rows in no particular order. Null vectors come last, as in a
    sequential scan.
    """
    if labels is not None:
        df = df.where(labels_overlap(labels_col, labels))
    if where is not None:
        df = df.where(where)
    out = with_distance(df, query, vector, metric)
    if query is not None:
        out = out.orderBy(F.col("distance").asc_nulls_last(), *then_by, F.col(key))
    return out if k is None else out.limit(k)


def nearest_to_row(df: DataFrame, one_row: DataFrame, query: str, k: int = 10, **options) -> DataFrame:
    """The query vector comes from a frame of one row, which is joined to every row."""
    one = one_row.select(F.col(query).alias("_query")).limit(1)
    return nearest(df.crossJoin(F.broadcast(one)), F.col("_query"), k, **options).drop("_query")


def within(df: DataFrame, query: Sequence[float] | Column, radius: float, *, vector: str = "embedding", metric: Metric = Metric.COSINE) -> DataFrame:
    """Rows nearer than ``radius``."""
    return with_distance(df, query, vector, metric).where(F.col("distance") < radius)


def nearest_per_group(df: DataFrame, query: Sequence[float] | Column, group: str, k: int, *, vector: str = "embedding", key: str = "vec_id", metric: Metric = Metric.COSINE) -> DataFrame:
    """The ``k`` nearest of each group; each task keeps no more than ``k`` rows a group before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.col("distance").asc_nulls_last(), key)
    return with_distance(df, query, vector, metric).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def block_distances(metric: int, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    if metric == Metric.L2:
        return np.sqrt(np.maximum((queries**2).sum(1)[:, None] - 2 * queries @ vectors.T + (vectors**2).sum(1)[None], 0))
    d = queries @ vectors.T
    if metric == Metric.INNER_PRODUCT:
        return -d
    size = np.sqrt((queries**2).sum(1))[:, None] * np.sqrt((vectors**2).sum(1))[None]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(size == 0, np.nan, np.maximum(1 - d / size, 0))


def knn_join(
    queries: DataFrame, vectors: DataFrame, k: int, *, vector: str = "embedding", key: str = "vec_id", metric: Metric = Metric.COSINE, exclude_self: bool = True, query_block: int = 1024, vector_block: int = 8192,
) -> DataFrame:
    """query_id, vec_id, distance, rank: the ``k`` nearest of each query, in blocks of both sides; ties by id.

    Each block of queries meets each block of vectors once, in memory bounded by the block sizes. Null vectors take no part. A block keeps ``k`` a query, so the merge
    reads no more than ``k`` rows a query and block.
    """
    def blocked(df: DataFrame, size: int) -> tuple[DataFrame, int]:
        kept = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        n = max(1, -(-kept.count() // size))
        return kept.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), n

    (left, n_q), (right, n_v) = blocked(queries, query_block), blocked(vectors, vector_block)
    left = left.withColumnRenamed("own", "q").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))))
    right = right.withColumnRenamed("own", "b").withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "distance": np.empty(0)})
        if not len(a) or not len(b):
            return empty
        b = b.sort_values("id")
        ids = b["id"].to_numpy()
        d = block_distances(metric, np.asarray(a["v"].tolist()), np.asarray(b["v"].tolist()))
        if exclude_self:
            d[a["id"].to_numpy()[:, None] == ids[None]] = np.inf
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        near = np.take_along_axis(d, order, 1)
        out = pd.DataFrame({"query_id": np.repeat(a["id"].to_numpy(), order.shape[1]), "vec_id": ids[order].ravel(), "distance": near.ravel()})
        return out[~np.isposinf(out["distance"])]

    found = left.groupBy("q", "b").cogroup(right.groupBy("q", "b")).applyInPandas(best, "query_id long, vec_id long, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
