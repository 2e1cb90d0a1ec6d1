"""Options of indexes and searches, with their ranges."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum


class Metric(IntEnum):
    COSINE = 0
    L2 = 1
    INNER_PRODUCT = 2


class Layout(IntEnum):
    PLAIN = 0
    MEMORY_OPTIMIZED = 2

    @classmethod
    def named(cls, name: str) -> Layout:
        found = {"plain": cls.PLAIN, "memory_optimized": cls.MEMORY_OPTIMIZED, "bq_compression": cls.MEMORY_OPTIMIZED}
        if name.lower() not in found:
            raise ValueError(f"invalid storage layout {name!r}; one of {', '.join(found)}")
        return found[name.lower()]


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie between {low} and {high}, not {value}")


# Limits that the options' results depend on.
MAX_DIMENSIONS = 16_000
MAX_DIMENSIONS_PLAIN = 2_000
MAX_DIMENSIONS_MULTIBIT = 930
AUTO_TWO_BITS_BELOW = 900
DEFAULT_NEIGHBORS = 50
BUILD_SLACK = 1.3

#: Bytes of the vectors of a shard, which is one row of a file.
SHARD_BYTES = 256 << 20


@dataclass(frozen=True)
class IndexOptions:
    metric: Metric = Metric.COSINE
    storage_layout: str = "memory_optimized"
    num_neighbors: int = -1
    search_list_size: int = 100
    max_alpha: float = 1.2
    num_dimensions: int = 0
    num_bits_per_dimension: int = 0
    #: Rows a shard holds on average; below it there is one shard. Shards of long vectors hold fewer, see SHARD_BYTES.
    shard_rows: int = 65_536
    #: One bit a dimension: above the mean, or without centring above zero.
    centred: bool = True

    @property
    def layout(self) -> Layout:
        return Layout.named(self.storage_layout)

    @property
    def neighbors(self) -> int:
        return DEFAULT_NEIGHBORS if self.num_neighbors == -1 else self.num_neighbors

    def indexed(self, dims: int) -> int:
        return self.num_dimensions or dims

    def bits(self, dims: int) -> int:
        if self.layout == Layout.PLAIN:
            return 1
        return self.num_bits_per_dimension or (2 if self.indexed(dims) < AUTO_TWO_BITS_BELOW else 1)

    def shards(self, rows: int, dims: int) -> int:
        return max(1, -(-rows // max(1, min(self.shard_rows, SHARD_BYTES // (4 * dims)))))

    def validate(self, dims: int, labelled: bool = False) -> IndexOptions:
        if self.num_neighbors != -1:
            _within("num_neighbors", self.num_neighbors, 10, 1000)
        _within("search_list_size", self.search_list_size, 10, 1000)
        _within("max_alpha", self.max_alpha, 1.0, 5.0)
        _within("num_dimensions", self.num_dimensions, 0, 5000)
        _within("num_bits_per_dimension", self.num_bits_per_dimension, 0, 32)
        _within("number of dimensions", dims, 1, MAX_DIMENSIONS)
        if self.num_dimensions and dims < self.num_dimensions:
            raise ValueError("num_dimensions exceeds the vectors' dimensions")
        if self.layout == Layout.PLAIN:
            _within("number of dimensions of the plain layout", dims, 1, MAX_DIMENSIONS_PLAIN)
            if self.metric == Metric.INNER_PRODUCT:
                raise ValueError("inner product needs the memory_optimized layout")
            if self.num_bits_per_dimension > 1:
                raise ValueError("num_bits_per_dimension needs the memory_optimized layout")
            if labelled:
                raise ValueError("labels need the memory_optimized layout")
        elif self.num_bits_per_dimension > 1 and self.indexed(dims) > MAX_DIMENSIONS_MULTIBIT:
            raise ValueError(f"more than one bit needs at most {MAX_DIMENSIONS_MULTIBIT} dimensions")
        return self


@dataclass(frozen=True)
class SearchOptions:
    query_search_list_size: int = 100
    query_rescore: int = 50

    def __post_init__(self) -> None:
        _within("query_search_list_size", self.query_search_list_size, 1, 10_000)
        _within("query_rescore", self.query_rescore, 0, 1000)

    @classmethod
    def of(cls, spark, **given) -> SearchOptions:
        """Arguments first, then the session's ``vecspark.query_*`` settings, then defaults."""
        names = {"query_search_list_size", "query_rescore"}
        conf = {n: int(v) for n in names if (v := spark.conf.get(f"vecspark.{n}", None)) is not None}
        return cls(**(conf | {k: v for k, v in given.items() if v is not None}))
