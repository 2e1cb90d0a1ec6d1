"""Label sets: arrays of small integers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_set(labels: Column | str | Sequence[int]) -> Column:
    if isinstance(labels, Column):
        return labels
    if isinstance(labels, str):
        return F.col(labels)
    return F.array(*[F.lit(int(x)).cast("smallint") for x in labels]).cast("array<smallint>")


def labels_normalize(labels) -> Column:
    """Sorted, without repeats and nulls; a null array is empty."""
    return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(label_set(labels), F.array().cast("array<smallint>")))))


def labels_overlap(a, b) -> Column:
    """Is any label in both? Null elements match nothing; a null array gives null."""
    return F.arrays_overlap(F.array_compact(label_set(a)), F.array_compact(label_set(b)))


def labels_contain_intersection(whole, a, b) -> Column:
    """Does ``whole`` hold every label that ``a`` and ``b`` share?"""
    return F.size(F.array_except(F.array_intersect(label_set(a), label_set(b)), label_set(whole))) == 0


def labels_is_empty(labels) -> Column:
    """Is no label left? Null arrays and arrays of nulls are empty."""
    return F.size(labels_normalize(labels)) == 0
