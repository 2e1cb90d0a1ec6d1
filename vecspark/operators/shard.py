"""One shard of an index: its arrays as a row of binary columns, and searches over them without rebuilding anything."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from vecspark.operators.graph import Graph, Search, distances, kind_of
from vecspark.options import Layout, Metric

#: keys long, vectors float, codes 64-bit words, links int and where each node's begin, labels short and where they begin, deleted byte.
SHARD = "shard int, n int, keys binary, vectors binary, codes binary, links binary, ends binary, labels binary, label_ends binary, deleted binary"
_ZERO = 1.1920929e-07


def prepared(vectors: np.ndarray, meta: dict) -> np.ndarray:
    """What is indexed of each vector: the first dimensions, brought to length 1 for cosine."""
    v = vectors[:, : meta["indexed"]].astype(float)
    if Metric(meta["metric"]) == Metric.COSINE:
        n = np.sqrt((v * v).sum(axis=1, keepdims=True))
        v = np.where(n * n < _ZERO, v, v / np.maximum(n, 1e-30))
    return v


def encode(vectors: np.ndarray, meta: dict) -> np.ndarray:
    """Packed codes: each dimension's level in unary, so that differing bits are the sum of the levels' differences."""
    v, mean, bits = prepared(vectors, meta), np.asarray(meta["mean"], float), meta["bits"]
    if bits == 1:
        unary = v > mean
    else:
        std = np.asarray([np.nan if s is None else s for s in meta["std"]], float)
        with np.errstate(divide="ignore", invalid="ignore"):
            z = np.where(std > 0, (v - mean) / std, np.where(v > mean, np.inf, -np.inf))
        level = np.clip(np.floor((z + 2) / (4.0 / (bits + 1))), 0, bits)
        unary = (level[:, :, None] > np.arange(bits)).reshape(len(v), -1)
    width = -(-unary.shape[1] // 64) * 64
    padded = np.zeros((len(v), width), bool)
    padded[:, : unary.shape[1]] = unary
    return np.packbits(padded, axis=1).view(np.uint64).reshape(len(v), width // 64)


class _Links:
    """Neighbours of each node, as slices of one array."""

    def __init__(self, links: np.ndarray, ends: np.ndarray) -> None:
        self.links, self.ends = links, ends

    def __getitem__(self, n: int) -> np.ndarray:
        return self.links[self.ends[n - 1] if n else 0 : self.ends[n]]

    def __len__(self) -> int:
        return len(self.ends)

    def lists(self) -> list[list[int]]:
        return [self[n].tolist() for n in range(len(self))]


class Shard:
    def __init__(self, row: dict, meta: dict) -> None:
        self.meta, self.number, self.n = meta, row["shard"], row["n"]
        read = lambda name, kind: np.frombuffer(row[name] or b"", kind)
        self.keys, self.deleted = read("keys", np.int64), read("deleted", bool)
        self.vectors = read("vectors", np.float32).reshape(self.n, -1) if self.n else np.empty((0, meta["dims"]), np.float32)
        self.codes = read("codes", np.uint64).reshape(self.n, -1) if self.n else np.empty((0, 1), np.uint64)
        self.links = _Links(read("links", np.int32), read("ends", np.int32))
        self.labels = _Links(read("labels", np.int16), read("label_ends", np.int32))

    @classmethod
    def empty(cls, number: int, meta: dict) -> Shard:
        return cls({"shard": number, "n": 0, **dict.fromkeys(x.split()[0] for x in SHARD.split(", ")[2:])}, meta)

    def graph(self, lists: bool = False) -> Graph:
        meta = self.meta
        plain = meta["layout"] == Layout.PLAIN
        labels = [frozenset(self.labels[k].tolist()) for k in range(self.n)] if meta["labelled"] else None
        points = prepared(self.vectors, meta) if plain else self.codes
        kind = kind_of(Metric(meta["metric"])) if plain else "code"
        g = Graph(points, kind, meta["neighbors"], meta["list_size"], meta["max_alpha"], labels)
        g.neighbors = self.links.lists() if lists else self.links
        g.start = 0 if self.n else None
        if labels:
            for k, of in enumerate(labels):
                for x in of:
                    g.label_starts.setdefault(x, k)
        return g

    def query(self, q: np.ndarray) -> np.ndarray:
        return prepared(q[None], self.meta)[0] if self.meta["layout"] == Layout.PLAIN else encode(q[None], self.meta)[0]

    def distances(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Exact distances of the stored vectors, whole."""
        v, metric = self.vectors[nodes].astype(float), Metric(self.meta["metric"])
        if metric == Metric.L2:
            return np.sqrt(((v - q) ** 2).sum(axis=1))
        dot = (v * q).sum(axis=1)
        if metric == Metric.INNER_PRODUCT:
            return -dot
        size = np.sqrt((v * v).sum(axis=1)) * np.sqrt((q * q).sum())
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(size == 0, np.nan, np.maximum(0.0, 1 - dot / size))

    def found(self, graph: Graph, q: np.ndarray, n: int, width: int, labels: frozenset | None, allowed: np.ndarray | None) -> tuple:
        """(nodes, graph distances, visits, compared, pulled) of up to ``n`` live, allowed nodes in the order of the graph."""
        search = Search(graph, self.query(q), width, labels)
        nodes, near, pulled = [], [], 0
        for d, node in search:
            pulled += 1
            if not self.deleted[node] and (allowed is None or allowed[node]):
                nodes.append(node)
                near.append(d)
                if len(nodes) >= n:
                    break
        return np.array(nodes, np.int64), np.array(near), search.visits, search.compared, pulled

    def rank_of_nearest(self, sample: int, k: int, share: float) -> int:
        """The rank in the graph's order within which that share of the ``k`` nearest of each of ``sample`` live rows lies."""
        live = np.flatnonzero(~self.deleted)
        g, ranks = self.graph(), []
        for node in live[:: max(1, -(-len(live) // sample))]:
            q = self.vectors[node].astype(float)
            near = distances(g.kind, g.points[live], self.query(q))
            nearest = np.argsort(self.distances(q, live), kind="stable")[:k]
            ranks += np.searchsorted(np.sort(near), near[nearest], side="right").tolist()
        return sorted(ranks)[math.ceil(share * len(ranks)) - 1] if ranks else 0

    def checked(self, q: np.ndarray, nodes: np.ndarray, near: np.ndarray, k: int, labels: frozenset | None, allowed: np.ndarray | None) -> tuple:
        """The nodes found, and all other live, allowed ones that are no farther than the ``k``-th of these; graph distances of those are
        not known."""
        d = self.distances(q, nodes)
        bound = np.partition(d, k - 1)[k - 1] if len(d) >= k else np.inf
        more = []
        for at in range(0, self.n, 4096):
            some = np.arange(at, min(at + 4096, self.n))
            far = self.distances(q, some) > bound
            more.append(some[~far])
        more = np.setdiff1d(np.concatenate([np.empty(0, np.int64), *more]), nodes)
        more = more[~self.deleted[more] & (True if allowed is None else allowed[more])]
        if labels is not None:
            more = more[[not labels.isdisjoint(self.labels[m].tolist()) for m in more]]
        return np.concatenate([nodes, more]), np.concatenate([near, np.full(len(more), np.nan)])

    def joined(self, keys: np.ndarray, vectors: np.ndarray, labels: list[frozenset]) -> tuple[Shard, int]:
        """With rows added, in order of their keys, without links; the last of a key counts, and one that was there already becomes a
        tombstone. And how many of those there were."""
        last = {k: i for i, k in enumerate(keys.tolist())}
        order = [last[k] for k in sorted(last)]
        keys, vectors, labels = keys[order], vectors[order].reshape(-1, self.meta["dims"]), [labels[i] for i in order]
        old = [frozenset(self.labels[k].tolist()) for k in range(self.n)]
        gone = np.isin(self.keys, keys) & ~self.deleted
        out = Shard.empty(self.number, self.meta)
        out.n = self.n + len(keys)
        out.keys, out.vectors = np.concatenate([self.keys, keys]), np.concatenate([self.vectors, vectors.astype(np.float32)])
        out.deleted = np.concatenate([self.deleted | gone, np.zeros(len(keys), bool)])
        out.codes = np.empty((out.n, 1), np.uint64)
        if self.meta["layout"] != Layout.PLAIN:
            fresh = encode(vectors, self.meta)
            out.codes = np.concatenate([self.codes, fresh]) if self.n else fresh
        out.put_labels([*old, *labels])
        end = self.links.ends[-1:] if self.n else np.zeros(1, np.int32)
        out.links = _Links(self.links.links, np.concatenate([self.links.ends, np.repeat(end, len(keys))]))
        return out, int(gone.sum())

    def grown(self, keys: np.ndarray, vectors: np.ndarray, labels: list[frozenset]) -> tuple[Shard, int]:
        """``joined``, and the added rows linked."""
        out, gone = self.joined(keys, vectors, labels)
        g = out.graph_for_building(self.links.lists())
        if g.labelled:
            for node in range(self.n, out.n):
                g.insert(node)
            g.finish()
        else:
            g.extend(self.n)
        out.put_links(g.neighbors)
        return out, gone

    def graph_for_building(self, lists: list[list[int]]) -> Graph:
        """The graph as it was before the nodes beyond ``lists`` came."""
        self.put_links([*lists, *[[] for _ in range(self.n - len(lists))]])
        g = self.graph(lists=True)
        g.label_starts = {x: k for x, k in g.label_starts.items() if k < len(lists)}
        if not lists:
            g.start = None
        return g

    def put_links(self, lists: list[list[int]]) -> None:
        self.links = _packed(lists, np.int32)

    def put_labels(self, lists: Iterable[frozenset]) -> None:
        self.labels = _packed([sorted(x) for x in lists], np.int16)

    def row(self) -> dict:
        arrays = {
            "keys": self.keys, "vectors": self.vectors, "codes": self.codes if self.meta["layout"] != Layout.PLAIN else np.empty(0), "links": self.links.links,
            "ends": self.links.ends, "labels": self.labels.links, "label_ends": self.labels.ends, "deleted": self.deleted,
        }
        return {"shard": self.number, "n": self.n, **{k: np.ascontiguousarray(x).tobytes() for k, x in arrays.items()}}


def _packed(lists: list[list[int]], kind) -> _Links:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((x for near in lists for x in near), kind, int(sizes.sum()))
    return _Links(flat, np.cumsum(sizes).astype(np.int32))


def batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[k]) for n, k in fields], names=[n for n, _ in fields])


def shards(batches: Iterator[pa.RecordBatch], meta: dict) -> Iterator[tuple[Shard, dict]]:
    """Shards of rows, one at a time, with the row's other columns."""
    for b in batches:
        for k in range(b.num_rows):
            row = b.slice(k, 1).to_pylist()[0]
            yield Shard(row, meta), row
