"""Mixing sources to target weights by entropy balancing.

Each document gets a rate: how often the mix should take it. Of all rates that make every source's words meet its target, those are
wanted that stay closest, in relative entropy, to one common rate. Their form is an exponential tilt by size, held at ``CAP``:
``rate = min(CAP, base * exp(tilt * size / mean size))`` with one tilt a source. The dual is convex, and Newton's method finds all tilts
at once; each step is one aggregate over (source, size, number of documents), joined to one row a source. Rates then become whole copies.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark.llm.words import quoted, words
from vecspark.runtime import checkpoint, save

#: No document is taken more often, and no target exceeds this many times its source's size.
CAP = 2
#: Words of the mix, as a share of all words.
SHARE = 1.5
#: Weights of sources by code point, repeating, null last.
WEIGHTS = (5, 2, 1)
#: Documents that one task puts in order at once.
CHUNK = 4096


def _same_source(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def targets(sizes: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row a source of ``sizes`` (source, source_size): adds ``target``.

    Targets share ``share`` times all words by weight. One that passes ``cap`` times its source's size stops there, and the others
    share what it leaves, until none passes. Sorting by size per weight finds in one pass where that ends: sources that need the least
    water level fill first.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    ranked = sizes.withColumn("_at", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("_at") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_full", F.lit(float(cap)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("_full") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        ranked.withColumn("_pool", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("_used", F.coalesce(F.sum("_full").over(before), F.lit(0.0)))
        .withColumn("_left", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_pool") - F.col("_used")) / F.col("_left"))
        .withColumn("_open", F.col("_level") * F.col("_w") < F.col("_full"))
    )
    first_open = F.first(F.when(F.col("_open"), F.col("_level")), ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.withColumn("_final", first_open).withColumn("target", F.least(F.col("_full"), F.coalesce(F.col("_final") * F.col("_w"), F.col("_full")))).select("source", "source_size", "target")


def tilts(cells: DataFrame, wanted: DataFrame, cap: float = CAP, base: float = SHARE, steps: int = 40, tolerance: float = 1e-9) -> DataFrame:
    """Solves the dual. ``cells``: (source, size, n), size > 0; ``wanted``: (source, source_size, target). Adds ``tilt`` and ``unit`` to ``wanted``.

    A Newton step that leaves the bracket known so far is replaced by its middle, so it always converges. Sources whose target is all
    they can give need no tilt: every rate is ``cap``.
    """
    docs = cells.groupBy("source").agg(F.sum("n").alias("n_docs"), F.min("size").alias("least"), F.max("size").alias("most"))
    limit = math.log(cap / base)
    state = (
        wanted.join(docs, _same_source(wanted["source"], docs["source"])).drop(docs["source"])
        .withColumn("unit", F.col("source_size") / F.col("n_docs"))
        .withColumn("low", F.lit(-745.0) / (F.col("least") / F.col("unit")))
        .withColumn("high", F.lit(limit) / (F.col("least") / F.col("unit")))
        .withColumn("tilt", F.lit(0.0))
        .withColumn("done", F.col("target") >= F.lit(cap) * F.col("source_size") * (1 - 1e-12))
    )
    state = checkpoint(state.select("source", "target", "source_size", "unit", "low", "high", "tilt", "done"))
    for _ in range(steps):
        x = F.col("size") / F.col("unit")
        rate = F.lit(base) * F.exp(F.least(F.col("tilt") * x, F.lit(700.0)))
        s, c = state.where("NOT done").alias("s"), cells.alias("c")
        sums = (
            c.join(s, _same_source(F.col("c.source"), F.col("s.source")))
            .groupBy("s.source")
            .agg(F.sum(F.col("n") * F.col("size") * F.least(rate, F.lit(float(cap)))).alias("f"), F.sum(F.when(rate < cap, F.col("n") * F.col("size") * rate * x).otherwise(0.0)).alias("d"))
        )
        gap = F.coalesce(F.col("f"), F.lit(0.0)) - F.col("target")
        near = F.abs(gap) <= F.lit(tolerance) * F.col("target")
        newton = F.when(F.col("d") > 0, F.col("tilt") - gap / F.nullif(F.col("d"), F.lit(0.0)))
        moved = state.alias("s").join(sums.alias("t"), _same_source(F.col("s.source"), F.col("t.source")), "left").select(
            "s.source", "target", "source_size", "unit", "tilt", "done",
            F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")).alias("low"), F.when(gap > 0, F.col("tilt")).otherwise(F.col("high")).alias("high"), newton.alias("newton"), near.alias("near"),
        )
        step = F.when((F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high")), F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2)
        stop = F.col("done") | F.coalesce(F.col("near"), F.lit(True)) | (F.col("high") - F.col("low") <= 1e-15)
        state = checkpoint(moved.select("source", "target", "source_size", "unit", "low", "high", F.when(stop, F.col("tilt")).otherwise(step).alias("tilt"), stop.alias("done")))
        if not state.where("NOT done").limit(1).count():
            break
    else:
        raise RuntimeError("tilts did not settle")
    return state.select("source", "source_size", "target", "unit", "tilt", (F.col("target") >= F.lit(cap) * F.col("source_size") * (1 - 1e-12)).alias("all"))


def _cell_copies(cells: DataFrame, solved: DataFrame, cap: float, base: float) -> DataFrame:
    """(source, size) -> whole copies of each of its n documents, and how many documents get one more.

    Sizes of a source are taken from the largest; what rounding leaves over at one size is carried to the next, so a source ends within
    about its smallest size of the target. A source has no more cells than distinct sizes.
    """
    c, s = cells.alias("c"), solved.alias("s")
    rate = F.when(F.col("all"), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.lit(base) * F.exp(F.least(F.col("tilt") * F.col("size") / F.col("unit"), F.lit(700.0)))))
    rated = c.join(s, _same_source(F.col("c.source"), F.col("s.source"))).select("c.source", "size", "n", rate.alias("rate"))

    def carry(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("size", ascending=False)
        over, out = 0.0, []
        for size, n, rate in zip(cells["size"].tolist(), cells["n"].tolist(), cells["rate"].tolist(), strict=True):
            due = over + rate * n * size
            k = min(max(round(due / size), 0), int(cap * n))
            over = due - k * size
            out.append(k)
        return cells[["source", "size", "n"]].assign(k=out)

    done = rated.groupBy("source").applyInPandas(carry, "source string, size long, n long, k long")
    return done.select("source", "size", "n", F.expr("k div n").alias("whole"), (F.col("k") % F.col("n")).alias("extra"))


def copies(docs: DataFrame, columns: list[str], share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``columns`` of every row of ``docs`` (doc_id, source, text) with ``size``, ``source_size``, ``target`` and ``copies`` (0 to
    ``cap``). Columns with these names, in whatever case, are left out, as the new ones replace them.

    Null text has size 0; documents without words are never taken. Null sources are one source. Which documents of one source and size
    get the extra copy is decided by a hash of doc_id and text, so reruns agree. Rows alike in everything may trade places. Empty in,
    empty out.
    """
    added = ["size", "source_size", "target", "copies"]
    kept = [c for c in columns if c.lower() not in added]
    out = _copies(docs, kept, share, weights, cap)
    return out.select(*(F.col(f"own{k}").alias(c) for k, c in enumerate(kept)), *added)


def mix(docs: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Each row of ``docs`` as often as ``copies`` says, with the columns of ``docs``, whatever their names."""
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    taken = _copies(docs, docs.columns, share, weights, cap).where("copies > 0").withColumn("time", times)
    return taken.select(*(F.col(f"own{k}").alias(c) for k, c in enumerate(docs.columns)))


def _copies(docs: DataFrame, columns: list[str], share: float, weights: tuple[float, ...], cap: int) -> DataFrame:
    """As ``copies``, with the columns under the names own0, own1, ..."""
    own = [f"own{k}" for k in range(len(columns))]
    size = F.size(words(F.col("text"))).cast("long").alias("size")
    sized = docs.select(*(F.col(quoted(c)).alias(n) for c, n in zip(columns, own, strict=True)), "doc_id", "source", size, F.xxhash64(F.lit(17), "doc_id", "text").alias("_h"))
    sized = save(sized, "sizes")
    cells = checkpoint(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    wanted = checkpoint(targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), share, weights, cap))
    full = cells.where("size > 0")
    solved = tilts(full, wanted.where("source_size > 0"), cap, min(share, cap * 0.999))
    counted = _cell_copies(full, solved, cap, min(share, cap * 0.999))
    counted = checkpoint(counted.withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("long")))
    s, c = sized.alias("s"), counted.alias("c")
    chunk = F.pmod(F.xxhash64(F.lit(3), "doc_id", "_h"), F.coalesce("chunks", F.lit(1))).alias("_chunk")
    alike = _same_source(F.col("s.source"), F.col("c.source")) & (F.col("s.size") == F.col("c.size"))
    ranked = s.join(c, alike, "left").select("s.*", "n", "whole", "extra", chunk)
    ranked = ranked.withColumn("_some", F.coalesce(F.col("extra") > 0, F.lit(False)))
    # of a size with many documents, chunks are counted first and each is put in order by itself
    per = checkpoint(ranked.where("_some").groupBy("source", "size", "_chunk").agg(F.count(F.lit(1)).alias("m")))
    before = Window.partitionBy("source", "size").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("first", F.coalesce(F.sum("m").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("source", "size", "_chunk").orderBy("_h", "doc_id"))
    r, p = ranked.where("_some").withColumn("_place", place).alias("r"), per.alias("p")
    alike = _same_source(F.col("r.source"), F.col("p.source")) & (F.col("r.size") == F.col("p.size")) & (F.col("r._chunk") == F.col("p._chunk"))
    placed = r.join(p, alike).select("r.*", (F.col("first") + F.col("_place") <= F.col("extra")).cast("long").alias("_one"))
    plain = ranked.where("NOT _some").withColumn("_place", F.lit(0)).withColumn("_one", F.lit(0).cast("long"))
    out = placed.select(*plain.columns).unionByName(plain).withColumn("copies", F.coalesce(F.col("whole"), F.lit(0)) + F.col("_one"))
    w, o = wanted.alias("w"), out.alias("o")
    joined = o.join(w, _same_source(F.col("o.source"), F.col("w.source")))
    return joined.select(*[f"o.{c}" for c in own], "o.size", "w.source_size", "w.target", "o.copies")
