"""Quality rules by weak supervision: rules vote or abstain, EM estimates how far each can be trusted, and the posterior decides.

Everything runs as DataFrame expressions. Votes are counted by pattern (at most 3 to the power of the number of rules rows), and
each EM step is one aggregate over that table, so its cost does not depend on the number of documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm.words import WORD, let, quoted, words
from vecspark.runtime import checkpoint, save

#: Latin capital letters.
CAPITALS = "A-ZÀ-ÖØ-Þ"
#: Name of a rule, when it says "bad", when it says "good"; else it abstains. Ratios are per word unless they say otherwise.
RULES: tuple[tuple[str, str, str], ...] = (
    ("symbols", "n_symbols > 0.1 * n_words", "n_words >= 10"),
    ("capitals", "n_capitals > 0.3 * word_chars", "n_words >= 10"),
    ("exclamations", "n_exclaims > 0.2 * n_words", "n_words >= 10"),
    ("repeats", "n_repeat_words > 0.2 * n_words", "n_words >= 20"),
    ("repeated_lines", "n_dup_lines > 0.3 * n_lines", "n_lines >= 4"),
    ("variety", "n_distinct < least(0.25 * n_words, 11 * sqrt(n_words))", "n_words >= 30"),
    ("word_length", "word_chars < 2.5 * n_words OR word_chars > 14 * n_words", "n_words >= 10"),
    ("separators", "n_bars > 0.1 * n_words", "n_words >= 10"),
    ("sentences", "n_words >= 20 AND n_stops < 0.01 * n_words", "n_words >= 20"),
    ("length", "n_words < 10", "n_words >= 30"),
)


def _kept_only(text: Column, characters: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def _repeat_words(w: Column) -> Column:
    """Words inside 5-word windows that occur twice or more.

    Most texts repeat no window: their window hashes are all distinct. In the others hashes are sorted with their positions, which
    brings equal windows together; then the words that their windows cover are counted in order.
    """
    n = F.size(w)
    zero = F.lit(0).cast("long")

    def union(s: Column) -> Column:
        def same(j: Column, i: Column) -> Column:
            return F.coalesce(F.get(s, j)["h"] == F.get(s, i)["h"], F.lit(False))

        starts = F.filter(s, lambda x, j: same(j, j - 1) | same(j, j + 1))
        return F.aggregate(
            F.array_sort(F.transform(starts, lambda x: x["p"])),
            F.struct(F.lit(-5).alias("p"), zero.alias("t")),
            lambda a, x: F.struct(x.alias("p"), (a["t"] + F.least(F.lit(5), x - a["p"])).alias("t")),
            lambda a: a["t"],
        )

    def covered(keys: Column) -> Column:
        return let(F.sort_array(F.transform(keys, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), union)

    five = lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(5)))
    keys = F.transform(F.sequence(F.lit(0), n - 5), five)
    repeats = let(keys, lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), zero).otherwise(covered(x)))
    return F.when(n < 6, zero).otherwise(repeats)


def features(docs: DataFrame) -> DataFrame:
    """The frame with the counts that rules read: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and a few more.

    Null text counts as no words. ``docs`` must have no column of these names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def counted(w: Column) -> list[Column]:
        return [
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            _repeat_words(w).alias("n_repeat_words"),
        ]

    by_words = let(words(F.col("text")), lambda w: F.struct(*counted(w)))
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    # inline() makes each struct once a row; plain projections would be merged and compute it once a field
    marks = F.regexp_replace(text, f"[^#*$%&|<>!.?,;{CAPITALS}]+", "")
    out = docs.select("*", F.inline(F.array(by_words))).select("*", F.inline(F.array(by_lines))).select("*", F.inline(F.array(F.struct(marks.alias("_marks")))))
    m = F.col("_marks")
    return out.withColumns(
        {
            "n_symbols": _kept_only(m, "#*$%&|<>"),
            "n_bars": _kept_only(m, "|"),
            "n_exclaims": _kept_only(m, "!"),
            "n_stops": _kept_only(m, ".?!,;"),
            "n_capitals": _kept_only(m, CAPITALS),
        }
    ).drop("_marks")


def votes(featured: DataFrame) -> DataFrame:
    """Adds ``_votes``: one character per rule, + good, - bad, 0 abstains; no words: all but ``length`` abstain."""
    cases = [F.when(F.expr(bad), F.lit("-")).when(F.expr(f"n_words > 0 AND ({good})"), F.lit("+")).otherwise(F.lit("0")) for _, bad, good in RULES]
    return featured.withColumn("_votes", F.concat(*cases))


def base_failed() -> Column:
    return F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")


#: At the start: P(good), and how often a rule that votes says "bad" of a good and of a bad text. Rules are specific: a bad text breaks
#: one or two of them and passes the others.
START = (0.8, 0.005, 1 / 6)


def estimate(voted: DataFrame, iterations: int = 20) -> list[float]:
    """EM over the patterns of ``_votes``: the log prior odds of good, then for each rule log(P(vote | good) / P(vote | bad)) of "+" and of "-".

    Rows that the base rules reject take no part, as their verdict is known. A rule that abstains says nothing. No rule is trusted less
    than chance: "+" never counts as bad, nor "-" as good. Every other document counts. Without any: the starting values.
    """
    k = len(RULES)
    patterns = checkpoint(voted.where(~base_failed()).groupBy("_votes").agg(F.count(F.lit(1)).alias("n")))
    model = [math.log(START[0] / (1 - START[0]))] + [math.log((1 - START[1]) / (1 - START[2])), math.log(START[1] / START[2])] * k
    for _ in range(iterations):
        scored = patterns.withColumn("p", F.col("n") * posterior(model))
        by_vote = scored.select("n", "p", F.posexplode(F.split("_votes", ""))).where("col in ('+', '-')").groupBy("pos", "col").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
        total = scored.agg(F.lit(-1).alias("pos"), F.lit("").alias("col"), F.sum("n").alias("n"), F.sum("p").alias("p"))
        sums = {(r["pos"], r["col"]): (r["p"] or 0.0, (r["n"] or 0) - (r["p"] or 0.0)) for r in by_vote.unionByName(total).collect()}
        good, bad = sums[-1, ""]
        if good + bad == 0:
            break
        new = [math.log((good + 1) / (bad + 1))]
        for r in range(k):
            (gp, bp), (gm, bm) = sums.get((r, "+"), (0.0, 0.0)), sums.get((r, "-"), (0.0, 0.0))
            g, b = (gm + 0.5) / (gp + gm + 1), (bm + 0.5) / (bp + bm + 1)
            new += [max(0.0, math.log((1 - g) / (1 - b))), min(0.0, math.log(g / b))]
        moved = max(abs(a - b) for a, b in zip(model, new, strict=True))
        model = new
        if moved < 1e-3:
            break
    return model


def posterior(model: list[float]) -> Column:
    """P(good | votes) of ``_votes`` under the estimates. They stand in one array, so the code of each EM step is the same."""
    ratios = F.array(*map(F.lit, model[1:]))
    steps = F.sequence(F.lit(0), F.lit(len(RULES) - 1))

    def added(a: Column, r: Column) -> Column:
        mark = F.substr(F.col("_votes"), r + 1, F.lit(1))
        return a + F.when(mark == "+", F.get(ratios, 2 * r)).when(mark == "-", F.get(ratios, 2 * r + 1)).otherwise(F.lit(0.0))

    return F.aggregate(steps, F.lit(float(model[0])), added, lambda a: F.lit(1.0) / (F.lit(1.0) + F.exp(-a)))


def judge(docs: DataFrame, threshold: float = 0.5, keep_columns: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with its counts, ``base_failed``, ``quality`` (posterior) and ``kept``.

    ``keep_columns``: columns of ``docs`` to carry (default all); those with a name of the columns added here, in whatever case, are
    left out, as these replace them. Null or empty texts have no words and fail. Repeated rows are judged alike. An empty frame gives
    an empty frame.
    """
    carried = [c for c in (docs.columns if keep_columns is None else keep_columns) if c.lower() not in ADDED]
    plain = docs.select(*map(quoted, {*carried, "text"}))
    voted = save(votes(features(plain)).select(*map(quoted, carried), *COUNTS, "_votes"), "votes")
    model = estimate(voted)
    judged = voted.withColumn("base_failed", base_failed()).withColumn("quality", posterior(model))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).drop("_votes")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bars", "n_exclaims", "n_stops", "n_capitals", "n_lines", "n_distinct")


#: Names that are added, here or on the way.
ADDED = (*COUNTS, "base_failed", "quality", "kept", "_votes", "_marks")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``, whatever their names."""
    names = {c: c if c.lower() == "text" else f"own{k}" for k, c in enumerate(docs.columns)}
    good = judge(docs.select(*(F.col(quoted(c)).alias(n) for c, n in names.items()))).where("kept")
    return good.select(*(F.col(n).alias(c) for c, n in names.items()))
