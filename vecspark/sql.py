"""SQL names for the vector functions."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: SQL function -> its parameters and body. Temporary SQL functions are inlined into plans; no Python runs.
FUNCTIONS = {
    "vec_l2": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))"),
    "vec_neg_inner_product": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "-aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "vec_norm": ("a ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))"),
    "vec_cosine": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
        "greatest(0D, 1 - try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))))",
    ),
    "smallint_array_overlap": ("l ARRAY<SMALLINT>, r ARRAY<SMALLINT>", "BOOLEAN", "arrays_overlap(array_compact(l), array_compact(r))"),
    "distance_type_cosine": ("", "SMALLINT", "0S"),
    "distance_type_l2": ("", "SMALLINT", "1S"),
    "distance_type_inner_product": ("", "SMALLINT", "2S"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL; may be called again."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)


def register_search(spark: SparkSession) -> None:
    """Makes the table function ``ann_search(TABLE(index), query, k)`` known: row_key, distance of the ``k`` nearest of each shard."""

    class Searching:
        def eval(self, row, query, k):
            from vecspark.operators.shard import Shard

            shard = Shard(row.asDict(), json.loads(row["meta"]))
            q = np.asarray(query, float)
            n = max(int(k), 50)
            nodes, *_ = shard.found(shard.graph(), q, n, 100, None, None)
            d = shard.distances(q, nodes)
            for i in np.lexsort((shard.keys[nodes], d))[: int(k)]:
                yield int(shard.keys[nodes[i]]), float(d[i])

    spark.udtf.register("ann_search", udtf(Searching, returnType="row_key: long, distance: double"))
