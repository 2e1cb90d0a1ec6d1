"""A persistent approximate index: one graph a shard, each shard one row of one Parquet file, named by a numbered list of files.

A change writes the shards that it touches and then a new list, so readers see one version or the other; files that neither this nor
the version before names are deleted. Creating the same version twice fails, so of two writers at once the second one starts over.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecspark.functions import labels_normalize, labels_overlap
from vecspark.functions.vector import normalize
from vecspark.operators import sbq
from vecspark.operators.graph import LINKED, ROWS
from vecspark.operators.shard import SHARD, Shard, batch, encode, shards
from vecspark.options import IndexOptions, Layout, Metric, SearchOptions
from vecspark.runtime import discard, save

#: Queries that one pass takes to all shards: so many, of so many values at most. More are taken in further passes.
QUERIES, VALUES = 4096, 1 << 23
#: Candidates that a task pulls from a shard before its queries are dealt to several tasks, and how many of these at most.
PULLED, TASKS = 1 << 17, 32
#: New rows of a shard that one task links; the work on more is dealt to several tasks.
TOGETHER = 8192
#: Rows of a shard that tell how many candidates a recall takes.
SAMPLE = 200
#: How often a writer that found its version taken starts over.
ATTEMPTS = 5
_FOUND = "query_id long, row_key long, distance double, graph_distance double, visits long, compared long, pulled long, rescored long"


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        newest = spark.read.text(f"{self.path}/meta").orderBy(F.desc("value")).first()["value"]
        self.meta = json.loads(newest.split("|", 1)[1])

    # building

    @classmethod
    def create(
        cls, df: DataFrame, path: str, vector: str = "embedding", key: str = "vec_id", labels: str | None = None, options: IndexOptions | None = None,
        dims: int | None = None, progress: Callable[[str, float], None] | None = None,
    ) -> VectorIndex:
        """Rows with a null vector are not indexed. ``dims`` is only needed for an empty frame. ``progress`` is told each phase as it
        ends, ``train``, ``build`` and ``publish``, and its seconds; ``meta["seconds"]`` keeps those of the first two."""
        options = options or IndexOptions()
        spark, path = df.sparkSession, path.rstrip("/")
        rows = cls._rows(df, vector, key, labels)
        first = rows.select(F.size("vector").alias("n")).limit(1).collect()
        dims = first[0]["n"] if first else dims
        if not dims:
            raise ValueError("the number of dimensions is unknown")
        options.validate(dims, labels is not None)
        if rows.where(F.size("vector") != dims).limit(1).count():
            raise ValueError("vectors differ in dimensions")
        meta = {
            "version": 0, "metric": int(options.metric), "layout": int(options.layout), "dims": dims, "indexed": options.indexed(dims),
            "bits": options.bits(dims), "neighbors": options.neighbors, "list_size": options.search_list_size, "max_alpha": options.max_alpha,
            "centred": options.centred, "labelled": labels is not None, "shards": options.shards(rows.count(), dims), "files": {},
            "options": asdict(options) | {"metric": int(options.metric)}, "seconds": {},
        }
        return cls._publish(spark, path, rows, meta, progress)

    @staticmethod
    def _rows(df: DataFrame, vector: str, key: str, labels: str | None) -> DataFrame:
        kept = labels_normalize(labels) if labels else F.array().cast("array<smallint>")
        row = [F.col(key).cast("long").alias("row_key"), F.col(vector).cast("array<float>").alias("vector"), kept.alias("labels")]
        return df.where(F.col(vector).isNotNull()).select(*row)

    @staticmethod
    def _trained(rows: DataFrame, meta: dict) -> dict:
        """Means and deviations of the rows; without rows, or without centring, zeros and nothing."""
        indexed = meta["indexed"]
        mean, std = [0.0] * indexed, [None] * indexed
        if meta["layout"] != Layout.PLAIN and (meta["centred"] or meta["bits"] > 1) and rows.limit(1).count():
            v = F.slice("vector", 1, indexed).cast("array<double>")
            v = normalize(v) if meta["metric"] == Metric.COSINE else v
            mean, std = sbq.quantizer(sbq.train(rows.select(v.alias("embedding"))))
        return meta | {"mean": mean, "std": std}

    @classmethod
    def _publish(cls, spark: SparkSession, path: str, rows: DataFrame, meta: dict, progress: Callable | None = None) -> VectorIndex:
        """A new version, trained and built from ``rows``."""
        seconds, began = {}, time.time()

        def over(phase: str) -> None:
            nonlocal began
            seconds[phase] = round(time.time() - began, 3)
            began = time.time()
            if progress:
                progress(phase, seconds[phase])

        meta = cls._trained(rows, meta)
        over("train")

        several = cls._several(rows, meta)

        def build(frame: pd.DataFrame) -> pd.DataFrame:
            return _added(Shard.empty(int(frame["shard"].iloc[0]), meta), frame, meta, several)

        dealt = rows.withColumn("shard", _shard_of(meta))
        built = dealt.groupBy("shard").applyInPandas(build, _BARE)
        made = cls._write(spark, path, cls._linked(built, meta) if several else built.drop("first"), meta["version"] + 1)
        over("build")
        files = {str(s): meta["version"] + 1 for s in made}
        out = cls._listed(spark, path, meta | {"files": files}, seconds)
        over("publish")
        return out

    @staticmethod
    def _several(rows: DataFrame, meta: dict) -> bool:
        """Whether these new rows are linked by several tasks a shard. Labels make each node's search depend on the nodes before."""
        return not meta["labelled"] and rows.count() > TOGETHER * meta["shards"]

    @staticmethod
    def _linked(joined: DataFrame, meta: dict) -> DataFrame:
        """Shards whose rows from ``first`` on have no links yet, with all links. What new nodes point to, and what nodes with too many links
        keep, depends on vectors alone and is found by several tasks a shard; one links back."""
        points = "vectors" if meta["layout"] == Layout.PLAIN else "codes"
        bare = save(joined, "joined")
        most = bare.agg(F.max(F.col("n") - F.col("first"))).first()[0] or 0
        parts = max(1, min(TASKS, most // LINKED))
        needed = ["shard", "n", "first", points]
        absent = {x.split()[0]: F.lit(None).cast("binary").alias(x.split()[0]) for x in SHARD.split(", ")[2:] if x.split()[0] != points}

        def dealt(rows: DataFrame) -> DataFrame:
            return reduce(DataFrame.unionByName, [rows.withColumn("part", F.lit(k)) for k in range(parts)])

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s, row in shards(batches, meta):
                g = s.graph()
                for at, end in g.steps(row["first"])[row["part"] :: parts]:
                    yield batch([{"shard": s.number, "at": at, "kept": g.chosen(at, end).tobytes()}], "shard int, at int, kept binary")

        def back(shard: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
            row = shard.iloc[0].to_dict()
            s, first = Shard(row, meta), int(row["first"])
            g = s.graph()
            chosen = {at: np.frombuffer(x, np.int32).reshape(-1, g.room) for at, x in zip(pieces["at"].tolist(), pieces["kept"], strict=True)}
            return pd.DataFrame([{"shard": s.number, "n": s.n, "first": first, points: row[points], "wide": g.linked(first, chosen).tobytes()}])

        def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s, row in shards(batches, meta):
                g, wide = s.graph(), np.frombuffer(row["wide"], np.int32).reshape(s.n, -1)
                for low in list(range(0, s.n, ROWS))[row["part"] :: parts]:
                    some, kept = g.overfull(wide, low)
                    yield batch([{"shard": s.number, "nodes": some.astype(np.int32).tobytes(), "kept": kept.astype(np.int32).tobytes()}], "shard int, nodes binary, kept binary")

        def whole(shard: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
            s = Shard(shard.iloc[0].to_dict(), meta)
            g = s.graph()
            wide = next(x for x, of in zip(pieces["kept"], pieces["nodes"], strict=True) if of is None)
            kept = [(np.frombuffer(of, np.int32), np.frombuffer(x, np.int32).reshape(-1, g.room)) for x, of in zip(pieces["kept"], pieces["nodes"], strict=True) if of is not None]
            s.put_links(g.thinned(np.frombuffer(wide, np.int32).reshape(s.n, -1), kept).neighbors)
            return pd.DataFrame([s.row()])

        chosen = save(dealt(bare.select(*needed, *absent.values())).mapInArrow(choose, "shard int, at int, kept binary"), "chosen")
        linking = bare.select(*needed, "links", "ends", *[c for x, c in absent.items() if x not in ("links", "ends")])
        wide = linking.groupBy("shard").cogroup(chosen.groupBy("shard")).applyInPandas(back, f"shard int, n int, first int, {points} binary, wide binary")
        wide = save(wide, "wide")
        thinned = save(dealt(wide.select(*needed, *absent.values(), "wide")).mapInArrow(thin, "shard int, nodes binary, kept binary"), "thinned")
        pieces = thinned.unionByName(wide.select("shard", F.lit(None).cast("binary").alias("nodes"), F.col("wide").alias("kept")))
        out = save(bare.groupBy("shard").cogroup(pieces.groupBy("shard")).applyInPandas(whole, SHARD), "linked")
        discard(bare, chosen, wide, thinned)
        return out

    @staticmethod
    def _write(spark: SparkSession, path: str, rows: DataFrame, version: int) -> list[int]:
        """Write shards; the numbers of those written."""
        folder = f"{path}/shards/{version:08d}"
        rows.select("*", F.col("shard").alias("at")).write.mode("error").partitionBy("at").parquet(folder)
        return [r["shard"] for r in spark.read.schema(SHARD).parquet(folder).select("shard").collect()]

    @classmethod
    def _listed(cls, spark: SparkSession, path: str, meta: dict, seconds: dict | None = None) -> VectorIndex:
        old = meta["version"]
        meta = meta | {"version": old + 1, "seconds": seconds or meta["seconds"]}
        line = f"{meta['version']:08d}|{json.dumps(meta)}"
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{path}/meta")
        index = cls(spark, path)
        index._sweep()
        return index

    def _sweep(self) -> None:
        """Delete files that neither of the last two versions names."""
        lists = self.spark.read.text(f"{self.path}/meta").orderBy(F.desc("value")).limit(2).collect()
        named = {(int(v), int(s)) for r in lists for s, v in json.loads(r["value"].split("|", 1)[1])["files"].items()}
        fs, hadoop = self._fs()
        for folder in fs.listStatus(hadoop(f"{self.path}/shards")) if fs.exists(hadoop(f"{self.path}/shards")) else []:
            version = int(folder.getPath().getName())
            parts = [p.getPath() for p in fs.listStatus(folder.getPath()) if p.getPath().getName().startswith("at=")]
            gone = [p for p in parts if (version, int(p.getName()[3:])) not in named]
            if version <= self.meta["version"]:
                for p in [folder.getPath()] if len(gone) == len(parts) else gone:
                    fs.delete(p, True)

    def _fs(self) -> tuple:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        return jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(conf), jvm.org.apache.hadoop.fs.Path

    # reading

    def rows(self) -> DataFrame:
        """The shards, a row each: only files of this version are read, and none is split or moved."""
        at = [f"{self.path}/shards/{v:08d}/at={s}" for s, v in self.meta["files"].items()]
        return self.spark.read.schema(SHARD).parquet(*at) if at else self.spark.createDataFrame([], SHARD)

    def nodes(self) -> DataFrame:
        """shard, node_id, row_key, labels, neighbors, deleted of every node."""
        meta = self.meta

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s, _ in shards(batches, meta):
                for at in range(0, s.n, 4096):
                    some = range(at, min(at + 4096, s.n))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([s.number] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array(s.keys[at : at + 4096]),
                            pa.array([s.labels[k].tolist() for k in some], pa.list_(pa.int16())), pa.array([s.links[k].tolist() for k in some], pa.list_(pa.int32())),
                            pa.array(s.deleted[at : at + 4096]),
                        ],
                        names=["shard", "node_id", "row_key", "labels", "neighbors", "deleted"],
                    )

        schema = "shard int, node_id int, row_key long, labels array<smallint>, neighbors array<int>, deleted boolean"
        return self.rows().mapInArrow(unpack, schema)

    def _allowed(self, base: DataFrame, key: str, where: Column | str | None) -> DataFrame:
        """Shards with the keys of theirs that ``base`` has, where the condition holds: no more than a shard has rows."""
        kept = base if where is None else base.where(where)
        keys = kept.select(F.col(key).cast("long").alias("row_key")).distinct().withColumn("of", _shard_of(self.meta))
        per = keys.groupBy("of").agg(F.collect_list("row_key").alias("allowed"))
        rows = self.rows()
        return rows.join(per, rows["shard"] == per["of"], "left").drop("of")

    def candidates_for(self, recall: float, k: int = 10) -> int:
        """How many candidates a shard has to give so that of the ``k`` nearest about that share is among them: each shard takes ``SAMPLE``
        of its live rows as queries and ranks the ``k`` nearest of each by code. It aims halfway from ``recall`` to 1, as a sample may err."""
        meta, share = self.meta, (1 + recall) / 2

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s, _ in shards(batches, meta):
                yield batch([{"n": s.rank_of_nearest(SAMPLE, k, share)}], "n long")

        return self.rows().mapInArrow(look, "n long").agg(F.max("n").alias("n")).first()["n"] or k

    def _pull(self, queries: pd.DataFrame, n: int, width: int, keep: int | None, rescore: bool, allowed: DataFrame | None = None, check: bool = False) -> DataFrame:
        """Of each shard and query up to ``n`` live rows in the order of its graph, with exact distances; the best ``keep`` of them.
        ``queries``: query_id, vector and, if labels matter, labels. ``check``: then rows that the graph ranked too low come in as well."""
        meta = self.meta
        asked = []
        for r in queries.itertuples():
            q = np.asarray(r.vector, float)
            if len(q) != meta["dims"]:
                raise ValueError(f"the query has {len(q)} dimensions, the index {meta['dims']}")
            given = getattr(r, "labels", None)
            asked.append((int(r.query_id), q, None if given is None else frozenset(int(x) for x in given if x is not None)))
        shared = self.spark.sparkContext.broadcast(asked)
        parts = max(1, min(TASKS, len(asked) * n // PULLED)) if len(asked) > 1 else 1

        def pull(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s, row in shards(batches, meta):
                g = s.graph()
                may = np.isin(s.keys, np.array(row["allowed"] or [], np.int64)) if "allowed" in row else None
                out = []
                for query_id, q, labels in shared.value[row["part"] :: parts]:
                    nodes, near, visits, compared, pulled = s.found(g, q, n, width, labels, may)
                    if check:
                        nodes, near = s.checked(q, nodes, near, keep, labels, may)
                    d = s.distances(q, nodes) if rescore else near
                    order = np.lexsort((s.keys[nodes], d))[:keep]
                    for k in order.tolist():
                        out.append((query_id, int(s.keys[nodes[k]]), float(d[k]), float(near[k]), visits, compared, pulled, len(nodes) if rescore else 0))
                    if not len(nodes):
                        out.append((query_id, None, None, None, visits, compared, pulled, 0))
                    if len(out) > 10_000:
                        yield batch([dict(zip(_NAMES, r, strict=True)) for r in out], _FOUND)
                        out = []
                yield batch([dict(zip(_NAMES, r, strict=True)) for r in out], _FOUND)

        rows = self.rows() if allowed is None else allowed
        dealt = [rows.withColumn("part", F.lit(part)) for part in range(parts)]
        return reduce(DataFrame.unionByName, dealt).mapInArrow(pull, _FOUND)

    def search_many(self, queries: DataFrame, k: int = 10, vector: str = "embedding", key: str = "vec_id", labels: str | None = None,
                    base: DataFrame | None = None, base_key: str = "vec_id", where: Column | str | None = None, recall: float | None = None, **options) -> DataFrame:
        """query_id, row_key, distance, rank: of every query the ``k`` nearest found. Each pass reads the shards once for as many queries
        as fit; what a shard passes on is ``k`` rows a query. Null queries take no part. ``base`` and ``where`` as in ``search``.
        ``recall``: at least as many candidates as a sample shows to be needed for it, see ``candidates_for``."""
        o = SearchOptions.of(self.spark, **options)
        n = max(o.query_rescore, k, self.candidates_for(recall, k) if recall and o.query_rescore else 0)
        fields = [F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("vector")]
        asked = queries.where(F.col(vector).isNotNull()).select(*fields, *([F.col(labels).alias("labels")] if labels else []))
        each = max(1, min(QUERIES, VALUES // self.meta["dims"]))
        passes = max(1, -(-asked.count() // each))
        block = F.pmod(F.xxhash64("query_id"), F.lit(passes))
        allowed = None if base is None and where is None else save(self._allowed(base, base_key, where), "allowed")
        out = None
        for p in range(passes):
            some = asked.where(block == p).toPandas()
            got = self._pull(some, n, max(o.query_search_list_size, 1), k, o.query_rescore > 0, allowed)
            out = got if out is None else out.unionByName(got)
        order = Window.partitionBy("query_id").orderBy("distance", "row_key")
        ranked = out.where("row_key IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.select("query_id", "row_key", "distance", "rank")

    def search(self, query: Sequence[float] | None, k: int = 10, labels: Sequence[int] | None = None, base: DataFrame | None = None,
               key: str = "vec_id", where: Column | str | None = None, check: bool = False, **options) -> DataFrame:
        """row_key, distance of the ``k`` nearest found, nearest first.

        Every shard gives ``query_rescore`` candidates or ``k``, whichever is more, and exact distances decide among them; with
        ``query_rescore`` 0 the graph's own distances do. With ``base`` only its rows come out, so rows that are gone there do not, and
        with ``where`` only those for which it holds: each shard goes on until enough of its rows pass or no more come. ``check``: each
        shard then looks through its other rows for any that is nearer than what it found, which makes the result exact.
        """
        o = SearchOptions.of(self.spark, **options)
        allowed = None
        if base is not None:
            allowed = self._allowed(base, key, where)
        if query is None:
            live = self.nodes().where("NOT deleted")
            live = live if labels is None else live.where(labels_overlap("labels", labels))
            if base is not None:
                kept = base if where is None else base.where(where)
                live = live.join(kept.select(F.col(key).cast("long").alias("row_key")), "row_key", "left_semi")
            return live.select("row_key", F.lit(None).cast("double").alias("distance")).limit(k)
        found = self._pull(_one(query, labels), max(o.query_rescore, k), max(o.query_search_list_size, 1), k, check or o.query_rescore > 0, allowed, check)
        return found.where("row_key IS NOT NULL").orderBy("distance", "row_key").limit(k).select("row_key", "distance")

    def pages(self, query: Sequence[float], page: int = 100, labels: Sequence[int] | None = None, **options) -> Iterator[DataFrame]:
        """The whole index in pages of ``page`` rows, near ones first, until every reachable live row has come. The graphs are walked
        once; each page continues where the last one ended."""
        found = save(self.scan(query, labels, **options), "scan")
        last = None
        while True:
            left = found if last is None else found.where((F.col("distance") > last[0]) | ((F.col("distance") == last[0]) & (F.col("row_key") > last[1])))
            out = left.orderBy("distance", "row_key").limit(page)
            end = out.agg(F.max(F.struct("distance", "row_key")).alias("m")).first()["m"]
            if end is None:
                return
            last = tuple(end)
            yield out

    def scan(self, query: Sequence[float], labels: Sequence[int] | None = None, **options) -> DataFrame:
        """Every live row that the graphs reach, in order."""
        o = SearchOptions.of(self.spark, **options)
        found = self._pull(_one(query, labels), 2**31, o.query_search_list_size, None, True)
        return found.where("row_key IS NOT NULL").orderBy("distance", "row_key").select("row_key", "distance")

    def statistics(self, query: Sequence[float], k: int = 10, labels: Sequence[int] | None = None, **options) -> DataFrame:
        """One row for a search: shards, nodes visited, distances compared, candidates pulled, exact distances, rows returned."""
        o = SearchOptions.of(self.spark, **options)
        # one row a shard is enough: its counts are in each
        found = self._pull(_one(query, labels), max(o.query_rescore, k), o.query_search_list_size, 1, True)
        sums = [F.sum(c).alias(n) for c, n in (("visits", "visits"), ("compared", "compared"), ("pulled", "candidates"), ("rescored", "exact"))]
        return found.agg(F.count(F.lit(1)).alias("shards"), *sums, F.least(F.sum("rescored"), F.lit(k)).alias("returned"))

    # changing

    def _changed(self, change: Callable[[VectorIndex], tuple[DataFrame, dict]]) -> VectorIndex:
        """Publish the shards that ``change`` gives; start over with the newest version if another writer came first."""
        now = self
        for attempt in range(ATTEMPTS):
            rows, stats, *more = change(now)
            meta = now.meta | (more[0] if more else {})
            version = meta["version"] + 1
            try:
                made = self._write(self.spark, self.path, rows, version)
            except AnalysisException as e:
                if "PATH_ALREADY_EXISTS" not in str(e) or attempt + 1 == ATTEMPTS:
                    raise
                time.sleep(0.2 * (attempt + 1))
                now = VectorIndex(self.spark, self.path)
                continue
            files = meta["files"] | {str(s): version for s in made}
            return self._listed(self.spark, self.path, meta | {"files": files, "last_change": stats | {"shards": len(made)}})
        raise RuntimeError("no version was free")

    def insert(self, df: DataFrame, vector: str = "embedding", key: str = "vec_id", labels: str | None = None) -> VectorIndex:
        """Adds rows to their shards' graphs, and writes those shards; the quantizer stays. A key that is there already is replaced: its
        old node becomes a tombstone. Rows with a null vector are left out. An index without any shard yet gets as many as the rows need."""
        fresh = self._rows(df, vector, key, labels if self.meta["labelled"] else None)
        if fresh.where(F.size("vector") != self.meta["dims"]).limit(1).count():
            raise ValueError("vectors differ in dimensions from the index")

        def change(index: VectorIndex) -> tuple[DataFrame, dict]:
            meta = index.meta
            if not meta["files"]:
                meta = meta | {"shards": index._options().shards(fresh.count(), meta["dims"])}
            several = self._several(fresh, meta)

            def add(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
                if not len(new):
                    return pd.DataFrame([], columns=[*old.columns, "first"])
                number = int(new["shard"].iloc[0])
                was = Shard(old.iloc[0].to_dict(), meta) if len(old) else Shard.empty(number, meta)
                return _added(was, new, meta, several)

            dealt = fresh.withColumn("shard", _shard_of(meta))
            touched = dealt.select("shard").distinct()
            old = index.rows().join(F.broadcast(touched) if meta["shards"] <= 10_000 else touched, "shard", "left_semi")
            built = old.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInPandas(add, _BARE)
            return self._linked(built, meta) if several else built.drop("first"), {"kind": "insert"}, {"shards": meta["shards"]}

        return self._changed(change)

    def _marked(self, gone_of: Callable[[VectorIndex], DataFrame], kind: str) -> VectorIndex:
        """``gone_of``: row_key of what goes. Their nodes stay in the graph but no longer come out; shards without any are not written."""

        def change(index: VectorIndex) -> tuple[DataFrame, dict]:
            meta = index.meta
            live = index.nodes().where("NOT deleted").select("row_key", "shard")
            gone = save(live.join(gone_of(index).select("row_key").distinct(), "row_key", "left_semi"), "gone")
            per = gone.groupBy(F.col("shard").alias("of")).agg(F.collect_list("row_key").alias("allowed"))
            rows = index.rows()

            def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for s, row in shards(batches, meta):
                    s.deleted = s.deleted | np.isin(s.keys, np.array(row["allowed"], np.int64))
                    yield batch([s.row()], SHARD)

            removed = gone.count()
            return rows.join(per, rows["shard"] == per["of"]).drop("of").mapInArrow(mark, SHARD), {"kind": kind, "removed": removed, "left": live.count() - removed}

        return self._changed(change)

    def delete(self, keys: DataFrame, key: str = "vec_id") -> VectorIndex:
        """``meta["last_change"]`` then tells how many nodes went and how many are left."""
        return self._marked(lambda _: keys.select(F.col(key).cast("long").alias("row_key")), "delete")

    def vacuum(self, live: DataFrame, key: str = "vec_id") -> VectorIndex:
        """Marks every node whose row is no longer in ``live``; ``meta["last_change"]`` has the counts."""
        kept = live.select(F.col(key).cast("long").alias("row_key"))
        return self._marked(lambda index: index.nodes().where("NOT deleted").select("row_key").join(kept, "row_key", "left_anti"), "vacuum")

    def rebuild(self) -> VectorIndex:
        """Trains the quantizer on the live rows and builds new graphs of them."""
        meta = self.meta

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s, _ in shards(batches, meta):
                for at in range(0, s.n, 4096):
                    some = [k for k in range(at, min(at + 4096, s.n)) if not s.deleted[k]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(s.keys[some]), pa.array(list(s.vectors[some]), pa.list_(pa.float32())), pa.array([s.labels[k].tolist() for k in some], pa.list_(pa.int16()))],
                        names=["row_key", "vector", "labels"],
                    )

        rows = save(self.rows().mapInArrow(unpack, "row_key long, vector array<float>, labels array<smallint>"), "live")
        return self._publish(self.spark, self.path, rows, meta | {"shards": self._options().shards(rows.count(), meta["dims"]), "files": {}})

    def _options(self) -> IndexOptions:
        return replace(IndexOptions(**self.meta["options"]), metric=Metric(self.meta["metric"]))

    # looking inside

    def start_nodes(self) -> DataFrame:
        """label (null: the default), shard, node_id."""
        nodes = self.nodes()
        default = nodes.groupBy("shard").agg(F.min("node_id").alias("node_id")).select(F.lit(None).cast("smallint").alias("label"), "shard", "node_id")
        return default.unionByName(nodes.select("shard", "node_id", F.explode("labels").alias("label")).groupBy("label", "shard").agg(F.min("node_id").alias("node_id")))

    def invariants(self) -> DataFrame:
        """One row a shard: nodes, reachable, most neighbours, self links, repeated links."""
        meta, names = self.meta, "shard int, nodes long, reachable long, most long, loops long, repeats long"

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s, _ in shards(batches, meta):
                near = s.links.lists()
                counts = (s.number, s.n, s.graph().reachable(), max(map(len, near)), sum(n in x for n, x in enumerate(near)), sum(len(set(x)) < len(x) for x in near))
                yield batch([dict(zip([x.split()[0] for x in names.split(", ")], counts, strict=True))], names)

        return self.rows().mapInArrow(look, names)

    def code_bytes(self) -> int:
        """Bytes of one stored code."""
        return encode(np.zeros((1, self.meta["dims"])), self.meta).nbytes if self.meta["layout"] != Layout.PLAIN else 0

    def to_dot(self, shard: int = 0, limit: int = 1000) -> str:
        """One shard's graph for Graphviz; its first ``limit`` nodes."""
        rows = self.rows().where(F.col("shard") == shard).collect()
        s = Shard(rows[0].asDict(), self.meta) if rows else Shard.empty(shard, self.meta)
        g, n = s.graph(lists=True), min(limit, s.n)
        g.neighbors = [[m for m in x if m < n] for x in g.neighbors[:n]]
        return g.to_dot()

    def explain(self) -> str:
        """What a search does, and on how much."""
        kind, metric = Layout(self.meta["layout"]).name.lower(), Metric(self.meta["metric"]).name.lower()
        each = f"{self.code_bytes()} bytes a code" if self.code_bytes() else "whole vectors"
        files = len(self.meta["files"])
        return f"approximate {metric} search: {files} of {self.meta['shards']} shards hold rows, each one file and one task; {kind}, {each}; version {self.meta['version']}"

    def register(self, name: str) -> None:
        """Makes the index known to SQL: ``SELECT * FROM ann_search(TABLE(name), array(...), k) ORDER BY distance LIMIT k``."""
        from vecspark.sql import register_search

        register_search(self.spark)
        self.rows().withColumn("meta", F.lit(json.dumps(self.meta))).createOrReplaceTempView(name)

    def drop(self) -> None:
        fs, hadoop = self._fs()
        fs.delete(hadoop(self.path), True)


_BARE = f"{SHARD}, first int"
_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def _shard_of(meta: dict) -> Column:
    return F.pmod(F.xxhash64("row_key"), F.lit(meta["shards"])).cast("int")


def _one(query: Sequence[float], labels: Sequence[int] | None) -> pd.DataFrame:
    return pd.DataFrame({"query_id": [0], "vector": [list(map(float, query))], "labels": [None if labels is None else list(labels)]})


def _added(was: Shard, frame: pd.DataFrame, meta: dict, bare: bool) -> pd.DataFrame:
    """The shard with these rows, linked or still ``bare``, and where they begin."""
    made, _ = (was.joined if bare else was.grown)(*_columns(frame, meta))
    return pd.DataFrame([made.row() | {"first": was.n}])


def _columns(frame: pd.DataFrame, meta: dict) -> tuple[np.ndarray, np.ndarray, list[frozenset]]:
    vectors = np.asarray(frame["vector"].tolist(), np.float32).reshape(len(frame), meta["dims"])
    return frame["row_key"].to_numpy(np.int64), vectors, [frozenset(int(y) for y in x) for x in frame["labels"]]
