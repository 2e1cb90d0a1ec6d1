"""Column functions."""

from vecspark.functions.labels import labels_contain_intersection, labels_is_empty, labels_normalize, labels_overlap
from vecspark.functions.vector import cosine, cosine_unit, dot, hamming, l2, l2_sq, l2_sq_few, neg_inner_product, norm, normalize, prefix, zero_vector

__all__ = [
    "cosine", "cosine_unit", "dot", "hamming", "l2", "l2_sq", "l2_sq_few", "labels_contain_intersection", "labels_is_empty", "labels_normalize",
    "labels_overlap", "neg_inner_product", "norm", "normalize", "prefix", "zero_vector",
]
