import hashlib
import itertools
import math
import random
import tracemalloc
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.llm import chat, components, counting, jaccard, mixing, nearest, packing, quality, queries, scoring, suffix, tokens, warc

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, size int"
LONG = " ".join(f"word{k % 977}" for k in range(30_000))
ODD = [
    (1, None, None, None, None, "x", 1), (2, "", "en", "b", 0, None, None), (3, " \n\t ", "en", "b", 3, None, None), (4, "one two", "en", None, 7, None, None),
    (5, "one two", "en", "a", 7, None, None), (5, "one two", "en", "a", 7, None, None), (6, LONG, "en", "a", 1, None, None), (7, LONG + " more", "en", "c", 1, None, None),
    (None, "a text without an id " * 5, "en", "a", 1, None, None), (8, "é" * 300, "fr", "c", 1, None, None), (9, "~<[ </s>[INST] ok [/INST] <|endoftext|> \r\n  two  spaces", "en", "c", 1, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def words(text):
    return (text or "").encode().split()


def test_mixing(docs, odd, empty):
    for df in (docs, odd):
        got = mixing.copies(df, ["doc_id", "source"]).collect()
        assert len(got) == df.count()
        by = defaultdict(lambda: [0, 0, 0, 0])
        for r in got:
            assert 0 <= r["copies"] <= 2
            b = by[r["source"]]
            b[0] += r["size"]
            b[1] += r["copies"] * r["size"]
            b[2] = r["target"]
            assert r["source_size"] == b[3] or not b[3]
            b[3] = r["source_size"]
        total = sum(b[0] for b in by.values())
        names = sorted(by, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
        fixed, pool = {}, 1.5 * total
        while True:
            free = [s for s in names if s not in fixed]
            share = {s: (pool - sum(fixed.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
            over = [s for s in free if share[s] > 2 * by[s][0]]
            if not over:
                break
            fixed |= {s: 2.0 * by[s][0] for s in over}
        for s, want in (fixed | share).items():
            assert by[s][2] == pytest.approx(want)
    again = {(r["doc_id"], r["source"]): r["copies"] for r in mixing.copies(docs.repartition(5), ["doc_id", "source"]).collect()}
    assert all(again[r["doc_id"], r["source"]] == r["copies"] for r in mixing.copies(docs, ["doc_id", "source"]).collect())
    assert mixing.copies(empty, ["doc_id"]).count() == 0


def test_packing(docs, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df in (docs, odd):
        got = packing.pack(packing.cut(df)).collect()
        whole = defaultdict(int)
        texts = Counter()
        for r in df.collect():
            ids = [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 2]
            texts[r["doc_id"], len(ids)] += 1
            stops = list(range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024))
            for k, b in enumerate(stops):
                a = stops[k - 1] if k else 0
                whole[r["doc_id"], k, a, b - a, crc32(np.asarray(ids[a:b], "<u4").tobytes())] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == whole
        at = defaultdict(list)
        for r in got:
            at[r["sequence_id"]].append((r["offset"], r["length"]))
        for places in at.values():
            places.sort()
            assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(places)) and sum(places[-1]) <= 1024
        assert len(at) <= 1.02 * math.ceil(sum(r["length"] for r in got) / 1024) + 1
    assert packing.pack(packing.cut(empty)).count() == 0


def test_packing_over_many_partitions(spark):
    texts = spark.range(0, 40, 1, 40).select(F.col("id").alias("doc_id"), F.concat(F.lit(LONG[:9_000]), F.col("id").cast("string")).alias("text"))
    got = packing.pack(packing.cut(texts)).collect()
    assert {r["doc_id"] for r in got} == set(range(40))
    at = defaultdict(list)
    for r in got:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in at.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(places)) and sum(places[-1]) <= 1024
    # two pieces of over half a sequence never share one
    assert len(at) >= max(math.ceil(sum(r["length"] for r in got) / 1024), sum(r["length"] > 512 for r in got))


def brute_components(rows):
    sets = [jaccard.shingles(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = set(sets[a].tolist()), set(sets[b].tolist())
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            root[find(b)] = find(a)
    ids = defaultdict(list)
    for k, r in enumerate(rows):
        ids[find(k)].append(r["doc_id"])
    return Counter((r["doc_id"], len(sets[k]), min((i for i in ids[find(k)] if i is not None), default=None)) for k, r in enumerate(rows))


def test_shingles_are_those_of_words():
    def plain(text):
        w = [x.lower() for x in words(text)]
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    for t in ("", None, "a", "a b c d e f a b c d e", "A b\x0bc\x0cd e", "x " * 50, "É é"):
        assert len(jaccard.shingles(t)) == len(plain(t))


def test_jaccard(spark, docs, odd, empty):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    made = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(60)] = f"e{rng.randrange(1000)}"
        made.append((1000 + k, " ".join(w)))
    near = spark.createDataFrame(made, "doc_id long, text string")
    for df in (docs, odd, near):
        got = jaccard.group(df).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(df.collect())
    assert jaccard.group(empty).count() == 0
    _, classes, links = jaccard.links(near, all_links=True)
    sets = {r["doc_id"]: set(jaccard.shingles(dict(made)[r["doc_id"]]).tolist()) for r in classes.collect()}
    want = sum(100 * len(a & b) >= 80 * len(a | b) for a, b in itertools.combinations(sets.values(), 2))
    assert links.distinct().count() == want


def test_components(spark):
    chain = spark.createDataFrame([(f"{k:03d}", f"{k + 1:03d}") for k in range(0, 60) if k != 30], "u string, v string")
    for few in (0, 1000):
        got = {r["node"]: r["root"] for r in components.components(chain, few=few).collect()}
        assert got["030"] == "000" and got["060"] == "031" and len(got) == 61


def brute_repeats(rows, span=50):
    least = {}
    for r in rows:
        b = (r["text"] or "").encode()
        for p in range(len(b) - span + 1):
            if r["doc_id"] is not None:
                least[b[p : p + span]] = min(least.get(b[p : p + span], r["doc_id"]), r["doc_id"])
    out = Counter()
    for r in rows:
        b = (r["text"] or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - span + 1):
            if r["doc_id"] is not None and least[b[p : p + span]] < r["doc_id"]:
                gone[p : p + span] = True
        gone = gone[:-1]
        out[r["doc_id"], len(b), int(gone.sum()), int(np.diff(gone.astype(int), prepend=0).clip(0).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    return out


def test_suffix(docs, odd, empty):
    for df in (docs, odd):
        got = suffix.digests(df).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_repeats(df.collect())
    assert suffix.digests(empty).count() == 0


def test_scoring(docs, odd, empty):
    for df in (docs, odd):
        rows = df.collect()
        lower = lambda t: [*(w.lower() for w in words(t)), None]
        out = lambda i: crc32(b"" if i is None else str(i).encode()) % 10 == 0
        c = Counter(w for r in rows if not out(r["doc_id"]) for w in lower(r["text"]))
        n, v = sum(c.values()), len(c)
        want = sorted((str(r["doc_id"]), out(r["doc_id"]), len(lower(r["text"])), sum(c[w] > 0 for w in lower(r["text"])), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in lower(r["text"])), 4)) for r in rows)
        got = scoring.score(df).collect()
        assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert sum(r["score"] for r in scoring.score(docs).where("held_out").collect()) > sum(r["base_score"] for r in scoring.score(docs).where("held_out").collect())
    assert scoring.score(empty).count() == 0


def brute_scores(rows):
    """Every context up to the greatest length, extended without a bound."""
    texts = [[*words(t), None] for _, t in rows]
    train = [t for (i, _), t in zip(rows, texts) if crc32(str(i).encode()) % 10]
    c = Counter(w for t in train for w in t)
    n = sum(c.values())
    after = defaultdict(Counter)
    for t in train:
        for k in range(len(t)):
            for j in range(max(0, k - scoring.DEPTH), k):
                after[tuple(t[j:k])][t[k]] += 1
    states = {}

    def p(context, w):
        if not context:
            return (c[w] + 0.1) / (n + 0.1 * (len(c) + 1))
        lower = p(context[1:], w)
        if context not in states:
            return lower
        own, seen = states[context]
        return (own.get(w, 0) + (seen - sum(own.values()) + 5) * lower) / (seen + 5)

    for context in sorted(after, key=len):
        seen, own = sum(after[context].values()), {w: k for w, k in after[context].items() if k >= 2}
        lower = {w: p(context[1:], w) for w in own}
        rest = seen - sum(own.values())
        gain = sum(k * math.log(k / seen / lower[w]) for w, k in own.items()) + (rest and rest * math.log(rest / seen / (1 - sum(lower.values()))))
        if own and gain > math.log(n):
            states[context] = own, seen
    return max(map(len, states), default=0), [sum(math.log10(p(tuple(t[:k]), t[k])) for k in range(len(t))) for t in texts]


def test_scoring_keeps_long_contexts_on_any_partitioning(spark):
    rng = random.Random(3)
    rows = []
    for k in range(240):
        a = rng.choice("uv")
        rows.append((k, " ".join(x for _ in range(3) for x in (a, *rng.choices("pq", k=1), "r", "s", "t", {"u": "x", "v": "y"}[a], rng.choice("klmn") + str(rng.randrange(40))))))
    rows += [(1000 + k, rows[0][1] + " end of a copied text") for k in range(5)]
    depth, want = brute_scores(rows)
    assert depth > 2
    for parts in (1, 6, 16):
        got = {r["doc_id"]: r["score"] for r in scoring.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()}
        assert [got[i] for i, _ in rows] == pytest.approx(want, rel=1e-9)


def test_warc(spark):
    tag = lambda t, **more: {"etag": t} | more
    rows = [
        (1, "HTTP://Ex.com:80/a?b=2&a=1#f", 10, "response", tag('"1"', **{"content-type": "t"}), "d1"), (2, "http://ex.com/a?a=1&b=2", 20, "revisit", tag('W/"1"', date="x", server="s"), None),
        (3, "http://ex.com/a?a=1&b=2", 200_000, "response", tag('"2"'), "d2"), (4, "http://ex.com/a?a=1&b=2", 200_000, "revisit", tag('"2"'), None), (5, "http://ex.com/a?a=1&b=2", 200_001, "revisit", tag('"2"'), None),
        (6, "http://other/", 5, "revisit", None, None), (7, None, 5, "revisit", None, None), (8, "http://ex.com/a?a=1&b=2", 900_000, "revisit", {}, "d2"), (9, "http://ex.com/a?a=1&b=2", 900_000, "revisit", {}, None),
    ]
    got = {r["id"]: (r["status"], r["response_id"], r["headers"]) for r in warc.resolve(spark.createDataFrame(rows, "id long, url string, time long, kind string, headers map<string,string>, digest string")).collect()}
    assert got[2] == ("resolved", 1, {"content-type": "t", "etag": 'W/"1"', "date": "x"})
    assert got[4][:2] == ("changed", None) and got[5][:2] == ("resolved", 3) and got[6][0] == got[7][0] == "missing" and got[8][:2] == ("resolved", 3) and got[9][0] == "unverified"


def test_quality(spark, docs, odd, empty):
    def counts(t):
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", t or "") if x]
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {p for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\r\n\x0b\x0c")]
        return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)

    for df in (docs, odd.select("doc_id", "text")):
        got = quality.judge(df.select("doc_id", "text")).collect()
        assert len(got) == df.count()
        for r in got:
            n = counts(r["text"])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
            assert r["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and not (r["base_failed"] and r["kept"])
    assert quality.keep_good(odd).columns == odd.columns and quality.keep_good(empty).count() == 0
    plain = "Some words of a text, and a few more of them. They differ. "
    text = lambda k: " ".join(plain.replace("words", f"w{k}{j}").replace("differ", f"d{k}x{j}") for j in range(4))
    good = [(k, text(k)) for k in range(90)]
    bad = [(100 + k, " ".join(f"{w}$$$" for w in text(k).split())) for k in range(8)] + [(200 + k, " | ".join(text(k).split())) for k in range(8)]
    kept = {r["doc_id"] for r in quality.judge(spark.createDataFrame(good + bad, "doc_id long, text string")).where("kept").collect()}
    assert kept == set(range(90)) - {k for k, t in good if counts(t)[4] * 5 > counts(t)[0]}


def test_token_counts(docs, odd, empty):
    pieces = tokens.Pieces(tokens.default_path())
    for df in (docs, odd):
        got = counting.count_by_line(df).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("doc_tokens").alias("d"), F.count(F.lit(1)).alias("k")).collect()
        assert all(r["n"] == r["d"] * r["k"] // max(1, r["k"]) or r["doc_id"] == 5 for r in got)
    texts = [r["text"] or "" for r in docs.collect()] + [r[1] or "" for r in ODD] + ["日本語 テスト\n絵😀文字", "a\n\nb", " x", "x\n", "\0 a b"]
    for text, ids, plain in zip(texts, pieces.many(texts), pieces.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.ids
        assert [tuple(x) for x in pieces.spans(text, ids).tolist()] == plain.offsets
    assert tokens.attribute(np.array([[0, 4], [4, 6], [6, 6]]), np.array([0, 5]), np.array([5, 9])).tolist() == [0, 0, 1]
    assert counting.count_by_line(empty).count() == 0


def test_encoding_keeps_nothing_of_a_text():
    pieces = tokens.Pieces(tokens.default_path())
    pieces.many(["a text"])
    tracemalloc.start()
    assert len(pieces.many([" ".join(f"w{k}x" for k in range(at, at + 1000)) for at in range(0, 50_000, 1000)])) == 50
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 1 << 20


def test_odd_white_space_is_encoded_whole():
    pieces = tokens.Pieces(tokens.default_path())
    texts = [" a\tb", "col1\tcol2 ", "a\u00a0b c", "a\tb \nc", "a\tb\n", "a b\nc"]
    for text, ids, plain in zip(texts, pieces.many(texts), pieces.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.ids
        assert [tuple(x) for x in pieces.spans(text, ids).tolist()] == plain.offsets


def test_nearest(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(400, 8))
    rows = [(k, [float(x) for x in v[k]]) for k in range(400)] + [(1000, None), (1050, [0.0] * 8), (1100, [math.nan] * 8), (1150, [None] * 8), (500, [float(x) for x in v[0]]), (0, [float(x) for x in v[0]])]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    ids, all_v = [*range(400), 500], np.vstack([v, v[:1]])
    unit = all_v / np.linalg.norm(all_v, axis=1, keepdims=True)
    hits = 0
    for q in [k for k in ids if k % 50 == 0]:
        s = unit[ids.index(q)] @ unit.T
        want = [i for _, i in sorted((-s[k], i) for k, i in enumerate(ids) if i != q)][:5]
        hits += len(set(want) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hits >= 0.9 * 45 and {r["query_id"] for r in got} == {k for k in ids if k % 50 == 0} and len(got) == 45
    few = nearest.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r["vec_id"], r["rank"]) for r in few] == [(2, 1), (1, 2)]
    assert nearest.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_chat(spark):
    rows = [(1, 1, "assistant", "</s>[INST] ~1 <|end|>\n"), (1, 0, "user", None), (2, None, None, "x"), (2, None, None, "x"), (None, 0, "assistant", "é")]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(chat.canonical_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), "conv_id"), "conv_id").collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256("user\n\nassistant\n</s>[INST] ~1 <|end|>\n\n".encode()).hexdigest() and got[1]["loss_chars"] == len("</s>[INST] ~1 <|end|>\n")
    assert got[2]["n_turns"] == 2 and got[None]["loss_sha256"] == hashlib.sha256("é".encode()).hexdigest()
    records = [(1, '{"prompt":"a","response":"b"}'), (2, '{"messages":[{"role":"user","content":"x"}]}'), (3, '{"z":1}'), (4, None), (5, '{"instruction":"i","input":"","output":"o"}'), (6, '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}')]
    turns = {r["k"]: r["turns"] and [tuple(t) for t in r["turns"]] for r in chat.canonical_json(spark.createDataFrame(records, "k int, r string"), "k", "r").collect()}
    assert turns == {1: [("user", "a"), ("assistant", "b")], 2: [("user", "x")], 3: None, 4: None, 5: [("user", "i"), ("assistant", "o")], 6: [("user", "q"), ("assistant", "a")]}


def test_pipeline_against_plain_python(spark, docs):
    import corpus_pipeline as p

    names = [f for _, f in p.STAGES]
    good = names[0](spark, docs, DATA)
    assert good.columns == docs.columns
    one = names[1](spark, good, DATA)
    want = brute_components(good.collect())
    assert {r["doc_id"] for r in one.collect()} == {i for i, n, c in want if c == i or n == 0}
    cut = names[2](spark, one, DATA)
    left = {r["doc_id"]: len((r["text"] or "").encode()) for r in cut.collect()}
    for (doc_id, n, gone, _, _), _ in brute_repeats(one.collect()).items():
        assert n - gone - 8 <= left.get(doc_id, 0) <= n - gone
    mixed = names[3](spark, cut, DATA)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert names[4](spark, mixed, DATA).select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
