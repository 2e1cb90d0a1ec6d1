import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark import sql as vector_sql
from vecspark.functions import cosine, hamming, l2, labels_contain_intersection, labels_normalize, labels_overlap, neg_inner_product, normalize
from vecspark.operators import VectorIndex, exact, graph, sbq
from vecspark.operators.shard import Shard
from vecspark.options import IndexOptions, Metric, SearchOptions


def rows(spark, data, labels=False):
    data = [(k, v and [float(x) for x in v], *more) for k, v, *more in data]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>" + (", labels array<smallint>" if labels else ""))


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_distances(spark):
    assert value(spark, l2([1, 2], [4, 6])) == 5
    assert value(spark, neg_inner_product([1, 2], [3, 4])) == -11
    assert value(spark, cosine([1, 0], [1, 0])) == 0
    assert math.isnan(value(spark, cosine([0, 0], [1, 0])))
    assert value(spark, normalize([3, 4])) == [0.6, 0.8]
    assert value(spark, normalize([0, 0])) == [0, 0]
    assert value(spark, hamming(F.array(F.lit(5).cast("long")), F.array(F.lit(6).cast("long")))) == 2


def test_labels(spark):
    df = spark.createDataFrame([(1, [1, 2], [2, 3]), (2, [1, None], [2, None]), (3, [], [1]), (4, None, [1]), (5, [7, 7], [7])], "id int, a array<smallint>, b array<smallint>")
    assert [r[0] for r in df.orderBy("id").select(labels_overlap("a", F.col("b"))).collect()] == [True, False, False, None, True]
    assert [r[0] for r in df.orderBy("id").select(labels_normalize("a")).collect()] == [[1, 2], [1], [], [], [7]]
    assert value(spark, labels_contain_intersection([1], [1, 2], [1, 3])) and not value(spark, labels_contain_intersection([1], [1, 2], [2]))


def test_exact_tiny(spark):
    df = rows(spark, [(1, [1.0, 1, 1]), (2, [2.0, 2, 2]), (3, [3.0, 3, 3]), (4, None)])
    assert [r["vec_id"] for r in exact.nearest(df, [1, 1, 1], 10, metric=Metric.L2).collect()] == [1, 2, 3, 4]
    assert exact.nearest(df, [1, 1, 1], 1, metric=Metric.INNER_PRODUCT).first()["vec_id"] == 3
    assert exact.nearest(df, None, None).count() == 4


LABELLED = [(1, [1.0, 0, 0], [1, 2]), (2, [0.0, 1, 0], None), (3, [0.0, 0, 1], []), (4, [1.0, 1, 0], [1, None, 3])]


def test_index_labels_and_maintenance(spark, tmp_path):
    df = rows(spark, LABELLED, True)
    index = VectorIndex.create(df, f"{tmp_path}/i", labels="labels")
    q = [1.0, 0.5, 0.2]
    assert [index.search(q, 10, labels=x).count() for x in ([1], [], [3], None, [99])] == [2, 0, 1, 4, 0]
    assert index.search(None, 10, labels=[1]).count() == 2
    index = index.delete(df.where("vec_id = 1"))
    assert index.search(q, 10).count() == 3 and index.search(q, 10, labels=[1]).count() == 1
    index = index.insert(rows(spark, [(4, [0.0, 1, 1], [5]), (9, [1.0, 1, 1], [1]), (10, None, [1])], True), labels="labels")
    assert index.search(q, 10).count() == 4 and index.search(q, 10, labels=[5]).first()["row_key"] == 4
    assert sum(p.count() for p in index.pages(q, 2)) == 4
    assert index.rebuild().scan(q).count() == 4
    assert index.statistics(q).first()["visits"] >= 4 and "digraph" in index.to_dot() and index.explain()


def test_empty_index_then_insert(spark, tmp_path):
    index = VectorIndex.create(rows(spark, []), f"{tmp_path}/i", dims=3)
    assert index.scan([0.0, 0, 0]).count() == 0
    index = index.insert(rows(spark, [(1, [1.0, 2, 3]), (2, [4.0, 5, 6]), (3, [7.0, 8, 10])]))
    assert index.scan([0.0, 0, 0]).count() == 3


def test_connected_when_small_lists(spark, tmp_path):
    df = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.rand(1).cast("float"), F.rand(2).cast("float")).alias("embedding"))
    df = spark.createDataFrame(df.collect(), df.schema)
    index = VectorIndex.create(df, f"{tmp_path}/i", options=IndexOptions(num_neighbors=10, search_list_size=10, metric=Metric.L2, shard_rows=120))
    assert index.meta["shards"] == 3 and index.scan([0.5, 0.5]).count() == 300
    got = index.invariants().agg(F.sum("nodes"), F.sum("reachable"), F.max("most"), F.sum("loops"), F.sum("repeats")).first()
    assert got[0] == got[1] == 300 and got[2] <= 10 and got[3] == got[4] == 0


def test_stream(spark, tmp_path):
    from vecspark.streaming import insert_stream

    VectorIndex.create(rows(spark, [(1, [1.0, 2])]), f"{tmp_path}/i")
    rows(spark, [(2, [3.0, 4]), (3, [5.0, 1])]).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("vec_id long, embedding array<float>").parquet(f"{tmp_path}/in")
    insert_stream(stream, f"{tmp_path}/i", f"{tmp_path}/c").awaitTermination()
    assert VectorIndex(spark, f"{tmp_path}/i").scan([1.0, 1.0]).count() == 3


def test_sbq(spark):
    df = rows(spark, [(k, [float(k), 1.0]) for k in range(10)])
    mean, std = sbq.quantizer(sbq.train(df))
    assert mean == [4.5, 1.0] and std[1] == 0
    got = {r["vec_id"]: r["l"] for r in df.select("vec_id", sbq.levels("embedding", mean, std, 2).alias("l")).collect()}
    assert got[0] == [0, 0] and got[4] == [1, 0] and got[9] == [2, 0]
    assert sbq.search(df, [9.0, 1.0], mean, std, 2, 1, metric=Metric.L2).first()["vec_id"] == 9


@pytest.mark.parametrize("bad", [{"num_neighbors": 9}, {"search_list_size": 9}, {"max_alpha": 0.5}, {"num_dimensions": 5001}, {"storage_layout": "plain", "metric": Metric.INNER_PRODUCT}, {"storage_layout": "zip"}, {"num_bits_per_dimension": 2, "num_dimensions": 950}])
def test_options(bad):
    with pytest.raises(ValueError):
        IndexOptions(**bad).validate(1000)


def test_more_options(spark):
    assert IndexOptions(storage_layout="BQ_Compression").bits(899) == 2 and IndexOptions().bits(900) == 1
    with pytest.raises(ValueError):
        SearchOptions(query_rescore=1001)
    assert SearchOptions.of(spark, query_rescore=3).query_rescore == 3
    assert set(vector_sql.register(spark)) == set(vector_sql.FUNCTIONS)
    assert spark.sql("SELECT smallint_array_overlap(array(1S, NULL), array(2S, NULL))").first()[0] is False


def test_rebuild_trains_the_quantizer(spark, tmp_path):
    import numpy as np

    v = np.random.default_rng(1).normal(3, 1, size=(300, 16))
    df = rows(spark, [(k, x.tolist()) for k, x in enumerate(v)])
    index = VectorIndex.create(df.limit(0), f"{tmp_path}/i", dims=16).insert(df)
    assert not any(index.meta["mean"])
    index = index.rebuild()
    assert min(index.meta["mean"]) > 0.1
    found = index.search_many(df.where("vec_id < 40"), 10).groupBy("query_id").count().collect()
    truth = exact.knn_join(df.where("vec_id < 40"), df, 10, exclude_self=False).select("query_id", F.col("vec_id").alias("row_key"))
    # 16 dimensions make coarse codes, so more candidates than usual are compared exactly
    hits = index.search_many(df.where("vec_id < 40"), 10, query_rescore=120).join(truth, ["query_id", "row_key"]).count()
    assert len(found) == 40 and hits >= 0.9 * 400


@pytest.mark.parametrize("wanted", [0, 1, 2])
def test_recall_with_labels(spark, tmp_path, wanted):
    import numpy as np

    rng = np.random.default_rng(wanted)
    v = rng.normal(size=(600, 48))
    labels = [sorted(set(rng.integers(0, 32, 3).tolist())) for _ in range(600)]
    df = rows(spark, [(k, x.tolist(), l) for k, (x, l) in enumerate(zip(v, labels, strict=True))], True)
    index = VectorIndex.create(df, f"{tmp_path}/i", labels="labels")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    asked = [(k, (v[k] + rng.normal(size=48)).tolist(), rng.integers(0, 32, wanted).tolist() if wanted else None) for k in range(100)]
    # random directions have no near neighbours to speak of, so codes tell little
    got = index.search_many(rows(spark, asked, True), 10, labels="labels" if wanted else None, query_rescore=120).collect()
    hits = total = 0
    for k, q, l in asked:
        fits = [i for i in range(600) if not wanted or set(l) & set(labels[i])]
        best = sorted(fits, key=lambda i: -float(unit[i] @ np.array(q)))[:10]
        hits, total = hits + len(set(best) & {r["row_key"] for r in got if r["query_id"] == k}), total + len(best)
    assert hits >= 0.9 * total


def test_only_touched_shards_are_written_and_old_ones_go(spark, tmp_path):
    df = rows(spark, [(k, [float(k), 1.0, 2.0]) for k in range(200)])
    index = VectorIndex.create(df, f"{tmp_path}/i", options=IndexOptions(shard_rows=20))
    assert index.meta["shards"] == 10 and set(index.meta["files"].values()) == {1}
    index = index.insert(rows(spark, [(1000, [1.0, 2.0, 3.0])]))
    assert sorted(index.meta["files"].values()).count(2) == 1 and index.meta["last_change"]["shards"] == 1
    index = index.delete(df.where("vec_id = 5"))
    assert index.meta["last_change"] == {"kind": "delete", "removed": 1, "left": 200, "shards": 1}
    for _ in range(2):
        index = index.rebuild()
    assert {p.name for p in (tmp_path / "i" / "shards").iterdir()} == {f"{v:08d}" for v in (4, 5)}
    assert index.scan([0.0, 1.0, 2.0]).count() == 200 and set(index.meta["seconds"]) == {"train", "build"}


def test_progress_is_told(spark, tmp_path):
    told = []
    VectorIndex.create(rows(spark, [(1, [1.0, 2.0])]), f"{tmp_path}/i", progress=lambda phase, seconds: told.append((phase, seconds >= 0)))
    assert told == [("train", True), ("build", True), ("publish", True)]


def test_second_writer_starts_over(spark, tmp_path):
    index = VectorIndex.create(rows(spark, [(1, [1.0, 2.0])]), f"{tmp_path}/i")
    index.insert(rows(spark, [(2, [2.0, 1.0])]))
    later = index.insert(rows(spark, [(3, [2.0, 2.0])]))  # still at the first version
    assert later.scan([1.0, 1.0]).count() == 3


def test_wrong_dimensions(spark, tmp_path):
    index = VectorIndex.create(rows(spark, [(1, [1.0, 2.0])]), f"{tmp_path}/i")
    with pytest.raises(ValueError):
        index.search([1.0, 2.0, 3.0])
    with pytest.raises(ValueError):
        index.insert(rows(spark, [(2, [1.0])]))
    index.drop()
    assert not (tmp_path / "i").exists()


def test_statistics_and_pages(spark, tmp_path):
    df = rows(spark, [(k, [float(k % 17), float(k)]) for k in range(120)])
    index = VectorIndex.create(df, f"{tmp_path}/i", options=IndexOptions(metric=Metric.L2, shard_rows=50))
    told = index.statistics([3.0, 3.0], 10).first()
    assert told["shards"] == 3 and told["returned"] == 10 and told["exact"] == 3 * 40 and told["candidates"] >= told["exact"]
    keys = [[r["row_key"] for r in p.orderBy("distance", "row_key").collect()] for p in index.pages([3.0, 3.0], 50)]
    assert [len(x) for x in keys] == [50, 50, 20] and sum(keys, []) == [r["row_key"] for r in index.scan([3.0, 3.0]).collect()]


def test_label_helpers(spark):
    from vecspark.functions import labels_is_empty

    df = spark.createDataFrame([(1, [1]), (2, []), (3, None), (4, [None])], "id int, a array<smallint>")
    assert [r[0] for r in df.orderBy("id").select(labels_is_empty("a")).collect()] == [False, True, True, True]


@pytest.mark.parametrize("how", [{"num_dimensions": 1}, {"num_bits_per_dimension": 1, "centred": False}])
def test_checked_search_finds_what_codes_rank_too_low(spark, tmp_path, how):
    df = rows(spark, [(k, [1.0, 1 + k % 97, k % 7]) for k in range(400)])
    index = VectorIndex.create(df, f"{tmp_path}/i", options=IndexOptions(**how)).delete(df.where("vec_id % 5 = 1"))
    q, kept = [1.0, 50.0, 3.0], df.where("vec_id % 5 <> 1 AND vec_id % 2 = 0")
    found = index.search(q, 10, base=df, where="vec_id % 2 = 0", check=True, query_rescore=10)
    want = exact.nearest(kept, q, 10).collect()
    assert [r["row_key"] for r in found.collect()] == [r["vec_id"] for r in want]
    assert [round(r["distance"], 12) for r in found.collect()] == [round(r["distance"], 12) for r in want]
    assert [r["row_key"] for r in index.search(q, 10, base=df, where="vec_id % 2 = 0", query_rescore=10).collect()] != [r["vec_id"] for r in want]


@pytest.mark.parametrize("kind", ["code", "cosine", "l2", "ip"])
def test_graph_of_many_nodes_at_once(kind, monkeypatch):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(700, 8))
    points /= np.sqrt((points**2).sum(1, keepdims=True))
    points[100:260] = points[100]
    if kind == "code":
        points = np.packbits(points[:, :, None] > np.linspace(-0.7, 0.7, 8), axis=-1).reshape(700, 8).view(np.uint64)
    monkeypatch.setattr(graph, "COLUMNS", 128)
    monkeypatch.setattr(graph, "LINKED", 256)
    monkeypatch.setattr(graph.Search, "settle", None)  # no search for each node
    g = graph.Graph(points, kind, neighbors=10).extend(0)
    monkeypatch.undo()
    assert g.reachable() == 700 and max(map(len, g.neighbors)) <= 10
    assert not any(n in x or len(set(x)) < len(x) for n, x in enumerate(g.neighbors))
    found = total = 0
    for n in range(300, 700, 20):
        d = graph.distances(kind, points, points[n])
        got = [x for x, _ in zip((x for x, _ in graph.Search(g, points[n], 100)), range(10), strict=False)]
        found, total = found + sum(x <= np.sort(d)[9] for x in got), total + 10
    assert found >= 0.9 * total
    more = graph.Graph(points, kind, neighbors=10)
    more.neighbors, more.start = [*graph.Graph(points[:600], kind, neighbors=10).extend(0).neighbors, *[[] for _ in range(100)]], 0
    assert more.extend(600).reachable() == 700


def test_pruning_many_nodes_equals_pruning_each():
    rng = np.random.default_rng(4)
    points = rng.integers(0, 1 << 63, (300, 2)).astype(np.uint64)
    points[50:90] = points[50]
    g = graph.Graph(points, "code", neighbors=20)
    nodes, near = rng.choice(300, 40, replace=False), np.stack([rng.choice(300, 90, replace=False) for _ in range(40)])
    near[:10, :60] = np.arange(35, 95)
    near[near == nodes[:, None]] = -1
    for n, some, kept in zip(nodes, near, g.prune_many(nodes, near), strict=True):
        assert g.prune(int(n), sorted({int(x) for x in some if x >= 0})) == [x for x in kept.tolist() if x >= 0]


def test_search_takes_the_candidates_that_a_recall_needs(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    df = rows(spark, [(k, v) for k, v in enumerate(rng.normal(size=(2000, 32)).tolist())])
    index = VectorIndex.create(df, f"{tmp_path}/i", options=IndexOptions(shard_rows=1200))
    asked = df.where("vec_id % 50 = 0")
    truth = {(r["query_id"], r["vec_id"]) for r in exact.knn_join(asked, df, 10, exclude_self=False).collect()}
    monkeypatch.setattr("vecspark.operators.index.PULLED", 1000)  # several tasks a shard

    def recall(**how):
        return len(truth & {(r["query_id"], r["row_key"]) for r in index.search_many(asked, 10, query_rescore=20, **how).collect()}) / len(truth)

    assert recall() < 0.9 <= recall(recall=0.9)
    assert index.candidates_for(0.5) < index.candidates_for(0.9)


@pytest.mark.parametrize("trained", [True, False])
def test_shards_grow_many_rows_at_once(trained, monkeypatch):
    v = np.random.default_rng(6).normal(size=(900, 16)).astype(np.float32)
    meta = {"metric": 0, "layout": 2, "dims": 16, "indexed": 16, "bits": 2, "neighbors": 10, "list_size": 40, "max_alpha": 1.2, "labelled": False}
    meta |= {"mean": [0.0] * 16, "std": [0.25 if trained else None] * 16}
    none = [frozenset()] * 900
    monkeypatch.setattr(graph.Search, "settle", None)  # no search for each row
    first, _ = Shard.empty(0, meta).grown(np.arange(900), v, none)
    more, replaced = first.grown(np.arange(800, 1000), -v[:200], none[:200])
    monkeypatch.undo()
    assert (first.n, more.n, replaced, int(more.deleted.sum())) == (900, 1100, 100, 100)
    g = more.graph()
    assert g.reachable() == 1100 and max(map(len, more.links.lists())) <= 10
    nodes = more.found(g, v[0].astype(float), 2**31, 100, None, None)[0]
    assert sorted(more.keys[nodes].tolist()) == list(range(1000))


def test_large_shards_are_linked_by_several_tasks(spark, tmp_path, monkeypatch):
    from vecspark.operators import index as module

    rng = np.random.default_rng(5)
    df = rows(spark, [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(700, 8)))])
    options, changed = IndexOptions(num_neighbors=10, shard_rows=400), df.where("vec_id % 3 = 0")
    every = lambda index: sorted(index.nodes().collect())
    alone = VectorIndex.create(df, f"{tmp_path}/a", options=options)
    first, then = every(alone), every(alone.insert(changed))
    taken = []
    dealt = VectorIndex._linked
    monkeypatch.setattr(module, "TOGETHER", 50)
    monkeypatch.setattr(module, "LINKED", 64)
    monkeypatch.setattr(VectorIndex, "_linked", staticmethod(lambda *a: taken.append(1) or dealt(*a)))
    index = VectorIndex.create(df, f"{tmp_path}/b", options=options)
    assert every(index) == first and every(index.insert(changed)) == then and len(taken) == 2
    plain = VectorIndex.create(df, f"{tmp_path}/p", options=IndexOptions(num_neighbors=10, storage_layout="plain", metric=Metric.L2))
    assert plain.scan([0.0] * 8).count() == 700


def test_empty_index_gets_as_many_shards_as_the_rows_need(spark, tmp_path):
    df = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    index = VectorIndex.create(df.limit(0), f"{tmp_path}/i", options=IndexOptions(shard_rows=100), dims=2).insert(df)
    assert index.meta["shards"] == 3 and VectorIndex(spark, index.path).insert(df.limit(5)).meta["shards"] == 3
    assert index.scan([1.0, 1.0]).count() == 300


def test_normalize_takes_the_norm_of_a_vector_once(spark):
    plan = spark.range(1).select(normalize(F.array(F.col("id").cast("double"), F.lit(4.0))).alias("v"))
    assert plan.first()["v"] == [0, 1] and value(spark, normalize(F.lit(None).cast("array<double>"))) is None
    # no lambda of an element holds the fold of the norm
    text = plan._jdf.queryExecution().analyzed().toString()
    assert "zip_with" in text and all("sqrt" not in x for x in text.split("lambdafunction((lambda x")[1:])
