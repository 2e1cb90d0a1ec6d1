"""A navigable proximity graph of one shard, in numpy: search, pruning, insertion.

Points are either vectors or packed codes; the distance is chosen with them. Nodes are numbered by insertion.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections import deque
from collections.abc import Iterator

import numpy as np

from vecspark.options import BUILD_SLACK, Metric

TINY = float(np.finfo(np.float32).eps)

#: Nodes that are linked at once, those whose distances are taken at once, and how many to; links that a node may gather before it is pruned.
LINKED, ROWS, COLUMNS, GATHERED = 2048, 512, 8192, 100
#: Values that one step of a pruning of many nodes takes, so that they stay in a processor's cache.
VALUES = 1 << 16


def distances(kind: str, points: np.ndarray, q: np.ndarray) -> np.ndarray:
    """cosine (of unit vectors), l2 (squared), ip (negated) or code (differing bits of packed words)."""
    if kind == "code":
        return np.bitwise_count(points ^ q).sum(axis=1, dtype=np.int64).astype(float)
    if kind == "l2":
        return ((points - q) ** 2).sum(axis=1)
    d = points @ q
    return -d if kind == "ip" else np.maximum(1 - d, 0)


def _matrix(kind: str, points: np.ndarray) -> np.ndarray:
    """What a product of matrices compares: the points, or the bits of codes as -1 and 1."""
    if kind != "code":
        return points
    bits = np.unpackbits(np.ascontiguousarray(points).view(np.uint8), axis=1)
    return bits.astype(np.float32) * 2 - 1


def _between(kind: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As ``distances``, of two arrays that broadcast, over their last axis."""
    if kind == "code":
        return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64).astype(float)
    if kind == "l2":
        return ((a - b) ** 2).sum(axis=-1)
    d = (a * b).sum(axis=-1)
    return -d if kind == "ip" else np.maximum(1 - d, 0)


def kind_of(metric: Metric) -> str:
    return {Metric.COSINE: "cosine", Metric.L2: "l2", Metric.INNER_PRODUCT: "ip"}[metric]


class Search:
    """One search that can be pulled node by node, until everything reachable has come."""

    def __init__(self, graph: Graph, q: np.ndarray, width: int, labels: frozenset[int] | None = None):
        self.graph, self.q, self.width, self.labels = graph, q, width, labels
        self.heap: list[tuple[float, int]] = []
        self.visited: list[tuple[float, int]] = []
        self.seen: set[int] = set()
        self.visits = self.compared = 0
        self._offer(np.array(graph.starts_for(labels), np.int64), check=False)

    def _offer(self, nodes: np.ndarray, check: bool = True) -> None:
        fresh = [n for n in nodes.tolist() if n not in self.seen]
        self.seen.update(fresh)
        if check and self.labels is not None:
            fresh = [n for n in fresh if not self.labels.isdisjoint(self.graph.labels[n])]
        if fresh:
            d = distances(self.graph.kind, self.graph.points[fresh], self.q)
            self.compared += len(fresh)
            for item in zip(d.tolist(), fresh, strict=True):
                heapq.heappush(self.heap, item)

    def settle(self) -> None:
        """Visits until ``width`` nodes are nearer than whatever is still to visit."""
        while self.heap and not (len(self.visited) > self.width and self.heap[0][0] >= self.visited[self.width - 1][0]):
            item = heapq.heappop(self.heap)
            insort(self.visited, item)
            self.visits += 1
            self._offer(np.asarray(self.graph.neighbors[item[1]], np.int64))

    def __iter__(self) -> Iterator[tuple[float, int]]:
        while True:
            self.settle()
            if not self.visited:
                return
            yield self.visited.pop(0)


class Graph:
    def __init__(self, points: np.ndarray, kind: str, neighbors: int = 50, list_size: int = 100, max_alpha: float = 1.2, labels: list[frozenset[int]] | None = None):
        self.points, self.kind, self.room, self.list_size, self.max_alpha = points, kind, neighbors, list_size, max_alpha
        self.labels = labels or [frozenset()] * len(points)
        self.labelled = labels is not None
        self.neighbors: list[list[int]] = [[] for _ in range(len(points))]
        self.start: int | None = None
        self.label_starts: dict[int, int] = {}
        self.present = 0

    def starts_for(self, labels: frozenset[int] | None) -> list[int]:
        if labels is None:
            return [] if self.start is None else [self.start]
        return sorted({self.label_starts[x] for x in labels if x in self.label_starts})

    def build(self) -> Graph:
        for n in range(len(self.points)):
            self.insert(n)
        return self.finish()

    def finish(self) -> Graph:
        for n, near in enumerate(self.neighbors):
            if len(near) > self.room:
                self.neighbors[n] = self.prune(n, near)
        self._attach()
        return self

    def _attach(self) -> None:
        """Links each node that the start cannot reach from the nearest one that it can reach and that has room."""
        seen = self._from(set(self.starts_for(None)))
        lost = [n for n in range(len(self.points)) if n not in seen]
        if not lost:
            return
        free = np.zeros(len(self.points), bool)
        free[[m for m in seen if len(self.neighbors[m]) < self.room]] = True
        reached = np.zeros(len(self.points), bool)
        reached[list(seen)] = True
        for n in lost:
            if reached[n]:
                continue
            at = np.flatnonzero(free)
            if not len(at):
                return
            m = int(at[np.argmin(distances(self.kind, self.points[at], self.points[n]))])
            self.neighbors[m].append(n)
            free[m] = len(self.neighbors[m]) < self.room
            for x in self._from({n}, reached):
                reached[x] = True
                free[x] = len(self.neighbors[x]) < self.room

    def _from(self, seen: set[int], known: np.ndarray | None = None) -> set[int]:
        """Nodes that can be reached from ``seen``, and these; nothing beyond what is ``known`` already."""
        todo = deque(seen)
        while todo:
            for m in map(int, self.neighbors[todo.popleft()]):
                if m not in seen and (known is None or not known[m]):
                    seen.add(m)
                    todo.append(m)
        return seen

    def insert(self, n: int) -> None:
        """Registers start nodes, then links the node with what a filtered and an unfiltered search visit."""
        starts = self.starts_for(self.labels[n]) if self.labelled and self.labels[n] else []
        default = self.starts_for(None)
        if self.start is None:
            self.start = n
        for x in self.labels[n]:
            self.label_starts.setdefault(x, n)
        if starts:
            self._connect(n, self.labels[n])
        if default:
            self._connect(n, None)
        self.present += 1

    def _connect(self, n: int, labels: frozenset[int] | None) -> None:
        found = Search(self, self.points[n], self.list_size, labels)
        found.settle()
        self._merge(n, [v for _, v in found.visited if v != n])
        for v in self.neighbors[n]:
            self._merge(v, [n])

    def _merge(self, n: int, more: list[int]) -> None:
        near = list(dict.fromkeys([*self.neighbors[n], *(m for m in more if m != n)]))
        self.neighbors[n] = self.prune(n, near) if len(near) > math.ceil(BUILD_SLACK * self.room) else near

    def prune(self, n: int, near: list[int]) -> list[int]:
        """Keeps candidates that no kept one hides: near ones first, with ever more tolerance while there is room.

        A kept neighbour hides a candidate by how much nearer the candidate is to it than to the node, but only if it carries all labels that the candidate
        shares with the node. Points at no distance from both are told apart by how far their numbers lie apart, so that equal points form chains and leave
        room for others.
        """
        ids = np.asarray(near, np.int64)
        d = distances(self.kind, self.points[ids], self.points[n])
        order = np.lexsort((np.abs(ids - n), d))
        ids, d = ids[order], d[order]
        factor = np.zeros(len(ids))
        kept: list[int] = []
        taken = np.zeros(len(ids), bool)
        alpha = 1.0
        while alpha <= self.max_alpha + 1e-9 and len(kept) < self.room:
            for i in range(len(ids)):
                if len(kept) >= self.room:
                    break
                if taken[i] or factor[i] > alpha:
                    continue
                taken[i] = True
                kept.append(int(ids[i]))
                rest = np.flatnonzero(~taken & (factor <= self.max_alpha) & (np.arange(len(ids)) > i))
                if self.labelled and len(rest):
                    rest = rest[[(self.labels[ids[j]] & self.labels[n]) <= self.labels[ids[i]] for j in rest]]
                if len(rest):
                    between = distances(self.kind, self.points[ids[rest]], self.points[ids[i]])
                    ratio = np.where(between < TINY, np.where(d[rest] < TINY, np.abs(ids[rest] - n) / np.maximum(np.abs(ids[rest] - ids[i]), 1), np.inf), d[rest] / np.maximum(between, TINY))
                    factor[rest] = np.maximum(factor[rest], ratio)
            alpha *= 1.2
        return kept

    def extend(self, first: int) -> Graph:
        """Inserts all nodes from ``first`` on, of a graph without labels, many at once, which doubles the graph until ``LINKED`` are.

        What a search would visit is found by products of matrices: the nodes nearest to a new one among all that are there by then, and,
        in place of a search's way to them, the nearest of the first node, the next one, the next two, four and so on.
        """
        links = self.linked(first, {at: self.chosen(at, end) for at, end in self.steps(first)})
        return self.thinned(links, [self.overfull(links, low) for low in range(0, len(links), ROWS)])

    def steps(self, first: int) -> list[tuple[int, int]]:
        """The nodes that are linked at once, from and to; what is ``chosen`` for one step depends on no other."""
        n, at, out = len(self.points), max(first, 1), []
        while at < n:
            out.append((at, min(n, at + min(at, LINKED))))
            at = out[-1][1]
        return out

    def chosen(self, at: int, end: int) -> np.ndarray:
        """What the nodes of a step point to, a row each."""
        lows = [np.arange(low, min(low + ROWS, end)) for low in range(at, end, ROWS)]
        return np.concatenate([self.prune_many(new, self._nearest(new, end)) for new in lows]).astype(np.int32)

    def linked(self, first: int, chosen: dict[int, np.ndarray]) -> np.ndarray:
        """Links with those back, a row for each node, filled up with -1; some nodes have more than there is room for."""
        n = len(self.points)
        width = math.ceil(BUILD_SLACK * self.room) + GATHERED
        links, counts = np.full((n, width), -1, np.int32), np.zeros(n, np.int64)
        for v in range(first):
            near = self.neighbors[v]
            counts[v] = len(near)
            links[v, : len(near)] = near
        for at, end in self.steps(first):
            self._put(links, counts, np.arange(at, end), chosen[at])
            self._link_back(links, counts, at, end)
        return links

    def overfull(self, links: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
        """Of ``ROWS`` nodes from ``low`` on those with more links than there is room for, and what they keep."""
        some = low + np.flatnonzero((links[low : low + ROWS] >= 0).sum(1) > self.room)
        return some, self.prune_many(some, links[some]) if len(some) else np.empty((0, self.room), np.int64)

    def thinned(self, links: np.ndarray, kept: list[tuple[np.ndarray, np.ndarray]]) -> Graph:
        """The graph of these links, where overfull nodes keep what they are to keep."""
        links, counts = links.copy(), (links >= 0).sum(1)
        for some, near in kept:
            self._put(links, counts, some, near)
        self.start = 0 if len(links) else None
        self.neighbors = [links[v, : counts[v]].tolist() for v in range(len(links))]
        self.present = len(links)
        self._attach()
        return self

    def _nearest(self, new: np.ndarray, end: int) -> np.ndarray:
        """Of each new node the ``list_size`` nearest before ``end``, and nearest ones of ever larger stretches; -1 where there is none."""
        mine = _matrix(self.kind, self.points[new])
        size = (mine.astype(float) ** 2).sum(1)[:, None] if self.kind == "l2" else None
        best_d, best, way = np.empty((len(new), 0)), np.empty((len(new), 0), np.int64), []
        for low in range(0, end, COLUMNS):
            high = min(low + COLUMNS, end)
            other = _matrix(self.kind, self.points[low:high])
            d = -(mine @ other.T)
            if self.kind == "l2":
                d = size + 2 * d + (other**2).sum(1)[None]
            own = np.flatnonzero((new >= low) & (new < high))
            d[own, new[own] - low] = np.inf
            cuts = [0, *(1 << k for k in range(64) if 1 << k < high)] if low == 0 else [0]
            way += [low + a + d[:, a:b].argmin(1) for a, b in zip(cuts, [*cuts[1:], high - low], strict=True)]
            k = min(self.list_size, high - low)
            got = np.argpartition(d, k - 1, axis=1)[:, :k]
            best_d = np.concatenate([best_d, np.take_along_axis(d, got, 1)], 1)
            best = np.concatenate([best, got + low], 1)
            if best.shape[1] > self.list_size:
                got = np.argpartition(best_d, self.list_size - 1, axis=1)[:, : self.list_size]
                best_d, best = np.take_along_axis(best_d, got, 1), np.take_along_axis(best, got, 1)
        out = np.concatenate([best, np.stack(way, 1)], 1)
        out[out == new[:, None]] = -1
        return out

    def _link_back(self, links: np.ndarray, counts: np.ndarray, at: int, end: int) -> None:
        """Links from what the nodes from ``at`` to ``end`` point to; nodes that gathered as many as they can hold are pruned on the way."""
        rows, places = np.nonzero(links[at:end] >= 0)
        source, target = rows + at, links[at:end][rows, places].astype(np.int64)
        known = np.zeros(len(target), bool)
        both = np.flatnonzero(target >= at)
        for low in range(0, len(both), 65_536):
            some = both[low : low + 65_536]
            known[some] = (links[target[some]] == source[some, None]).any(1)
        source, target = source[~known], target[~known]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        while len(target):
            begins = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
            nth = np.arange(len(target)) - np.repeat(begins, np.diff(np.r_[begins, len(target)]))
            place = counts[target] + nth
            fits = place < links.shape[1]
            links[target[fits], place[fits]] = source[fits]
            np.add.at(counts, target[fits], 1)
            source, target = source[~fits], target[~fits]
            full = np.unique(target)
            for low in range(0, len(full), ROWS):
                some = full[low : low + ROWS]
                self._put(links, counts, some, self.prune_many(some, links[some]))

    @staticmethod
    def _put(links: np.ndarray, counts: np.ndarray, nodes: np.ndarray, kept: np.ndarray) -> None:
        links[nodes] = -1
        links[nodes, : kept.shape[1]] = kept
        counts[nodes] = (kept >= 0).sum(1)

    def prune_many(self, nodes: np.ndarray, near: np.ndarray) -> np.ndarray:
        """``prune`` of many nodes of a graph without labels; rows of candidates and of what is kept are filled up with -1."""
        each = max(1, VALUES // (near.shape[1] * self.points.shape[1]))
        if len(nodes) > each:
            return np.concatenate([self.prune_many(nodes[k : k + each], near[k : k + each]) for k in range(0, len(nodes), each)])
        ids = np.sort(near.astype(np.int64), axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        d = _between(self.kind, self.points[ids], self.points[nodes][:, None])
        d[ids < 0] = np.inf
        order = np.lexsort((np.abs(ids - nodes[:, None]), d), axis=1)
        ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
        here, every, ties = np.arange(ids.shape[1]), np.arange(len(nodes)), bool((d < TINY).any())
        points = self.points[ids]
        words = [np.ascontiguousarray(points[:, :, w]) for w in range(points.shape[2])] if self.kind == "code" else []
        # what is taken, and what is not to be taken any more, is hidden for good
        factor = np.where(ids < 0, np.inf, 0.0)
        kept, n_kept = np.full((len(nodes), self.room), -1, np.int64), np.zeros(len(nodes), np.int64)
        alpha = 1.0
        while alpha <= self.max_alpha + 1e-9:
            while True:
                shown = factor <= alpha
                i = shown.argmax(1)
                some = np.flatnonzero(shown[every, i])
                if not len(some):
                    break
                kept[some, n_kept[some]] = ids[some, i[some]]
                n_kept[some] += 1
                factor[some, i[some]] = np.inf
                if words:
                    between = np.bitwise_count(words[0] ^ words[0][every, i][:, None]).astype(float)
                    for w in words[1:]:
                        between += np.bitwise_count(w ^ w[every, i][:, None])
                else:
                    between = _between(self.kind, points, points[every, i][:, None])
                ratio = d / np.maximum(between, TINY)
                if ties:
                    apart = np.abs(ids - nodes[:, None]) / np.maximum(np.abs(ids - ids[every, i][:, None]), 1)
                    ratio = np.where((between < TINY) & (d < TINY), apart, ratio)
                later = here > i[:, None]
                if len(some) < len(every):
                    later &= shown[every, i][:, None]
                np.maximum(factor, ratio, out=factor, where=later)
                factor[n_kept == self.room] = np.inf
            alpha *= 1.2
        return kept

    def reachable(self) -> int:
        """Nodes that can be reached from all starts."""
        return len(self._from(set(self.starts_for(None)) | set(self.label_starts.values())))

    def to_dot(self) -> str:
        lines = ["digraph g {"]
        for n, near in enumerate(self.neighbors):
            lines.append(f'  n{n} [label="{n} {sorted(self.labels[n])}"];')
            if len(near):
                d = distances(self.kind, self.points[near], self.points[n])
                lines += [f'  n{n} -> n{m} [label="{x:.4g}"];' for m, x in zip(near, d.tolist(), strict=True)]
        return "\n".join([*lines, "}"])
