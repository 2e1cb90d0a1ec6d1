"""Search operators."""

from vecspark.operators.exact import knn_join, nearest, nearest_per_group, within
from vecspark.operators.index import VectorIndex

__all__ = ["VectorIndex", "knn_join", "nearest", "nearest_per_group", "within"]
