"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are brought to length 1, so cosine order is Euclidean order. A table hashes a vector to ``floor((a_k . v + b_k) / width)`` for
k of K Gaussian directions. A query also visits neighbouring buckets, in the order of their estimated success: the squared distances
to the borders that must be crossed, summed. A task holds some buckets of all tables; it ranks each bucket's candidates by exact cosine
and merges what it found for a query before it passes on the query's best. Those of all tasks are merged at last.

Equal vectors are one, with the smallest ids that can count, so copies make neither buckets nor queries large. The number of tables,
K, the width and the number of probes are fitted on a bounded sample; every vector is indexed.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.runtime import discard, partitions_for, save

#: Neighbours; what the fit aims at; vectors and queries of the sample.
K, AIM, SAMPLE, SAMPLE_QUERIES = 5, 0.97, 4000, 200
#: Blocks of a bucket that meet at once; pairs whose scores are computed at once; values of a task.
VECTOR_BLOCK, QUERY_BLOCK, PAIRS, TASK = 8192, 2048, 65536, 1 << 22
GRID = [(k, w) for k in (2, 3, 4, 5, 6) for w in (0.5, 1.0, 1.5, 2.0, 3.0)]
TABLES = (1, 2, 3, 4, 6, 8)


class Hashes:
    """The random directions of all tables, the same for the same seed."""

    def __init__(self, dims: int, k: int, width: float, probes: int, tables: int, seed: int = 7):
        rng = np.random.default_rng([seed, dims, k])
        self.k, self.width, self.probes, self.tables = k, width, probes, tables
        self.a = rng.normal(size=(tables, dims, k))
        self.b = rng.random((tables, k)) * width
        self.moves = np.array(list(itertools.product((0, -1, 1), repeat=k)))

    def places(self, unit: np.ndarray, table: int) -> np.ndarray:
        return (unit @ self.a[table] + self.b[table]) / self.width

    def key(self, cells: np.ndarray) -> np.ndarray:
        """Cells as one number: 10 bits each, for |cell| < 512; unit vectors stay far below."""
        out = np.zeros(cells.shape[:-1], np.int64)
        for k in range(self.k):
            out = (out << 10) | (np.clip(cells[..., k], -511, 511).astype(np.int64) + 512)
        return out

    def ranked(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query all moves, likeliest first, and its home cells."""
        home = np.floor(places)
        down = (places - home) ** 2
        up = (1 - (places - home)) ** 2
        score = np.zeros((len(places), len(self.moves)))
        for k in range(self.k):
            m = self.moves[:, k]
            score += np.where(m == 0, 0.0, np.where(m < 0, down[:, k : k + 1], up[:, k : k + 1]))
        return np.argsort(score, axis=1, kind="stable"), home

    def probed(self, unit: np.ndarray, table: int) -> np.ndarray:
        order, home = self.ranked(self.places(unit, table))
        return self.key(home[:, None, :] + self.moves[order[:, : self.probes]])


def fit(sample: np.ndarray, aim: float = AIM, k: int = K) -> Hashes:
    """Of the grid, what finds ``aim`` of the sample queries' nearest in the sample with the fewest visits to vectors, all tables
    counted; comparing with all vectors is one visit to each."""
    sample = sample[:SAMPLE]
    queries = sample[:SAMPLE_QUERIES]
    sims = queries @ sample.T
    np.fill_diagonal(sims[:, : len(queries)], -9)
    true = np.argsort(-sims, axis=1)[:, : min(k, max(len(sample) - 1, 1))]
    best = None
    for n_dirs, width in GRID:
        h = Hashes(sample.shape[1], n_dirs, width, 1, max(TABLES))
        never = len(h.moves)
        rank, visits = np.full(true.shape, never), np.zeros(never + 1)
        for table in range(h.tables):
            places = h.places(sample, table)
            order, home = h.ranked(places[: len(queries)])
            at = np.argsort(order, axis=1)
            moved = np.floor(places)[None] - home[:, None]
            near = (np.abs(moved) <= 1).all(axis=2)
            code = np.zeros(near.shape, np.int64)
            for j in range(n_dirs):
                code = code * 3 + np.where(moved[..., j] == 0, 0, np.where(moved[..., j] < 0, 1, 2))
            found = np.where(near, np.take_along_axis(at, np.where(near, code, 0), axis=1), never)
            rank = np.minimum(rank, np.take_along_axis(found, true, axis=1))
            visits += np.bincount(found.ravel(), minlength=never + 1) / found.size
            if table + 1 not in TABLES:
                continue
            for probes in sorted({1, 2, 4, 8, 16, 32, 64, 128, 256, never}):
                if probes <= never and (rank < probes).mean() >= aim:
                    cost = visits[:probes].sum() + 2e-5 * probes * (table + 1)
                    if best is None or cost < best[0]:
                        best = (cost, n_dirs, width, probes, table + 1)
                    break
    if best is None:  # nothing reaches the aim: one bucket for all but a few
        best = (1.0, 1, 100.0, 3, 1)
    return Hashes(sample.shape[1], *best[1:])


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of rows that take part: no null id, vector or component, all finite, not all zero. Of several vectors
    with one id the least takes part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False)))
    # -0.0 and 0.0 are the same component
    return held.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: x + 0.0).alias("embedding")).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def search(vectors: DataFrame, every: int = 50, k: int = K, hashes: Hashes | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id ``every`` divides, its ``k`` nearest others found, by cosine.

    Equal scores go to the smaller vec_id. Vectors are compared with those of their own dimension. Repeated rows count once; see
    ``usable`` for what takes part. A query whose buckets hold too few others is compared with all vectors. Empty in, empty out. Other
    columns, whatever their names, take no part.
    """
    spark = vectors.sparkSession
    held = save(usable(vectors), "vectors")
    dims = [r[0] for r in held.groupBy(F.size("embedding")).count().orderBy(F.size("embedding")).collect()]
    found = [_search(held.where(F.size("embedding") == n), n, every, k, hashes) for n in dims]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _search(held: DataFrame, dims: int, every: int, k: int, hashes: Hashes | None) -> DataFrame:
    # of equal vectors only the k + 1 smallest ids can be among a query's nearest; one of them may be the query's own
    first = Window.partitionBy("embedding").orderBy("vec_id")
    few = held.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
    kinds = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    kinds = save(kinds.select(F.col("ids")[0].alias("kind"), "ids", "embedding"), "kinds")
    asked = held.where(F.col("vec_id") % every == 0)
    asked = save(asked.join(kinds.select("kind", "embedding"), "embedding").select(F.col("vec_id").alias("query_id"), "kind"), "asked")
    queries = save(kinds.join(asked.select("kind").distinct(), "kind").select("kind", "embedding"), "queries")
    if hashes is None:
        sample = kinds.orderBy(F.xxhash64("kind"), "kind").limit(SAMPLE).select("embedding").toArrow()
        hashes = fit(_unit(_matrix(sample["embedding"].combine_chunks(), dims)), k=k)
    near = _probed(kinds, queries, dims, k + 1, hashes)
    total = kinds.count()
    enough = near.groupBy("query").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k + 1, total))
    rest = save(queries.join(enough.select(F.col("query").alias("kind")), "kind", "left_anti"), "rest")
    if rest.limit(1).count():
        near = near.join(rest.select(F.col("kind").alias("query")), "query", "left_anti").unionByName(_all_pairs(kinds, rest, dims, k + 1))
    near = save(near.join(kinds.select(F.col("kind").alias("found"), "ids"), "found").groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("near")), "near")
    discard(rest, queries)
    each = asked.join(near, asked["kind"] == near["query"]).select("query_id", F.explode("near").alias("x"))
    pairs = each.select("query_id", F.explode("x.ids").alias("vec_id"), F.col("x.score").alias("score")).where("query_id <> vec_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


_PLACED = "t int, bucket long, id long, embedding array<double>"


def _probed(kinds: DataFrame, queries: DataFrame, dims: int, k: int, h: Hashes) -> DataFrame:
    """query, found, score: of each query the ``k`` nearest in the buckets it visits, itself included."""

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(_matrix(batch.column(1), dims))
            for table in range(h.tables):
                t = pa.array(np.full(batch.num_rows, table, np.int32))
                bucket = pa.array(h.key(np.floor(h.places(unit, table))))
                yield pa.RecordBatch.from_arrays([t, bucket, *batch.columns], names=["t", "bucket", "id", "embedding"])

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(_matrix(batch.column(1), dims))
            for table in range(h.tables):
                visited = h.probed(unit, table)
                rows = np.repeat(np.arange(batch.num_rows), visited.shape[1])
                for at in range(0, len(rows), 10_000):
                    some = batch.take(pa.array(rows[at : at + 10_000]))
                    t = pa.array(np.full(some.num_rows, table, np.int32))
                    yield pa.RecordBatch.from_arrays([t, pa.array(visited.ravel()[at : at + 10_000]), *some.columns], names=["t", "bucket", "id", "embedding"])

    index = kinds.select("kind", "embedding").mapInArrow(buckets, _PLACED)
    asked = queries.mapInArrow(probes, _PLACED)
    # a large bucket, or one that many queries visit, is cut into blocks; each block of vectors meets each block of queries
    keys = ["t", "bucket"]
    sizes = index.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    visits = asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))
    blocks = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    cuts = save(sizes.join(visits, keys).select(*keys, blocks("n", VECTOR_BLOCK).alias("vs"), blocks("m", QUERY_BLOCK).alias("qs")), "cuts")
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(cuts, keys).withColumn("v", mine("vs")).withColumn("q", others("qs"))
    right = asked.join(cuts, keys).withColumn("q", mine("qs")).withColumn("v", others("vs"))
    out = _ranked(left, right, [*keys, "v", "q"], dims, k)
    discard(cuts)
    return out


def _all_pairs(kinds: DataFrame, queries: DataFrame, dims: int, k: int) -> DataFrame:
    """As ``_probed``, with all vectors, in blocks of both."""
    n_v, n_q = max(1, -(-kinds.count() // VECTOR_BLOCK)), max(1, -(-queries.count() // QUERY_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("kind"), F.lit(n)).cast("int")
    left = kinds.select(F.col("kind").alias("id"), "embedding", block(n_v).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("q"))
    right = queries.select(F.col("kind").alias("id"), "embedding", block(n_q).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))).alias("v"))
    return _ranked(left, right, ["v", "q"], dims, k)


def _ranked(left: DataFrame, right: DataFrame, keys: list[str], dims: int, k: int) -> DataFrame:
    """query, found, score: the ``k`` nearest of each query (right) among vectors (left) of the same keys."""
    spark = left.sparkSession
    columns = [F.struct(*keys).alias("key"), "id", "embedding"]
    both = left.select(F.lit(0).alias("side"), *columns).unionByName(right.select(F.lit(1).alias("side"), *columns))
    both = both.select(F.xxhash64("key").alias("place"), "key", "side", "id", "embedding")
    parts = partitions_for(spark, 2 * left.count() * dims, TASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        held: list[list] = [[], []]
        last = None

        def done() -> None:
            if held[0] and held[1]:
                (ids, vecs), (query_ids, queries) = ([np.concatenate(x) for x in zip(*side, strict=True)] for side in held)
                best.add(*_top(query_ids, queries, ids, vecs, k))
            held[0], held[1] = [], []

        for batch in batches:
            key = np.stack([np.asarray(x.to_numpy(zero_copy_only=False), np.int64) for x in batch.column(0).flatten()])
            side, ids = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            vecs = _matrix(batch.column(3), dims)
            new = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0) | (side[1:] != side[:-1])) + 1
            for a, b in itertools.pairwise([0, *new.tolist(), batch.num_rows]):
                now = tuple(key[:, a].tolist())
                if now != last:
                    done()
                    last = now
                held[side[a]].append((ids[a:b], vecs[a:b]))
        done()
        yield from best.rows()

    dealt = both.repartition(parts, "key").sortWithinPartitions("key", "side").select("key", "side", "id", "embedding")
    found = save(dealt.mapInArrow(run, "query long, found long, score double"), "found")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "found")
    return found.distinct().withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n")


class _Best:
    """The ``k`` nearest of each query among all that a task has seen."""

    def __init__(self, k: int) -> None:
        self.k, self.held, self.amount, self.kept = k, [], 0, 0

    def add(self, query: np.ndarray, found: np.ndarray, score: np.ndarray) -> None:
        self.held.append((query, found, score))
        self.amount += len(query)
        if self.amount > max(1 << 18, 2 * self.kept):
            self.thin()

    def thin(self) -> None:
        if self.held:
            query, found, score = (np.concatenate(x) for x in zip(*self.held, strict=True))
            order = np.lexsort((found, -score, query))
            query, found, score = query[order], found[order], score[order]
            new = np.concatenate([[True], (query[1:] != query[:-1]) | (found[1:] != found[:-1])])
            query, found, score = query[new], found[new], score[new]
            keep = np.arange(len(query)) - np.searchsorted(query, query) < self.k
            self.held = [(query[keep], found[keep], score[keep])]
            self.amount = self.kept = int(keep.sum())

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.thin()
        for query, found, score in self.held:
            for at in range(0, len(query), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 10_000]) for x in (query, found, score)], names=["query", "found", "score"])


def _top(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vecs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's ``k`` nearest of a block. A matrix product preselects; scores are computed for each pair by itself."""
    order = np.argsort(ids, kind="stable")
    ids, vecs = ids[order], vecs[order]
    vn, qn = np.sqrt((vecs * vecs).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
    near = (queries / qn[:, None]) @ (vecs / vn[:, None]).T
    take = min(k, len(ids))
    floor = np.partition(near, len(ids) - take, axis=1)[:, len(ids) - take] - 1e-9
    q, v = np.nonzero(near >= floor[:, None])
    score = np.empty(len(q))
    for at in range(0, len(q), PAIRS):
        i, j = q[at : at + PAIRS], v[at : at + PAIRS]
        score[at : at + PAIRS] = (queries[i] * vecs[j]).sum(axis=1) / (qn[i] * vn[j])
    order = np.lexsort((ids[v], -score, q))
    q, v, score = q[order], v[order], score[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return query_ids[q[keep]], ids[v[keep]], score[keep]
