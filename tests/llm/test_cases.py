"""Odd tables: nulls, repeats, ties, clashing names, empty ones. And operators that SQL cannot express against plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.llm import chat, counting, jaccard, mixing, nearest, packing, quality, scoring, suffix, warc

DATA = "/root/testdata/sf0.001"


def shingled(text):
    w = [x.lower() for x in (text or "").encode().split()]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_against_tuples_of_words(spark):
    rng = random.Random(7)
    base = [[f"w{rng.randrange(900)}" for _ in range(80)] for _ in range(3)]
    shared = [f"common{k}" for k in range(30)]
    texts = []
    for k in range(160):
        w = list(base[k % 3])
        for _ in range(rng.randrange(5)):
            w[rng.randrange(80)] = f"e{rng.randrange(10_000)}"
        texts.append(" ".join(w))
    texts += [" ".join([*(f"x{rng.randrange(9999)}" for _ in range(rng.choice([8, 40]))), *shared]) for _ in range(60)]
    sets = [shingled(t) for t in texts]
    linked = {(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    _, classes, links = jaccard.links(df, all_links=True)
    ids = {r["id"]: r["doc_id"] for r in classes.collect()}
    cls = defaultdict(list)
    for k, s in enumerate(sets):
        cls[frozenset(s)].append(k)
    least = {k: min(v) for v in cls.values() for k in v}
    got = {tuple(sorted((ids[r["u"]], ids[r["v"]]), reverse=True)) for r in links.collect()}
    assert got == {tuple(sorted((least[a], least[b]), reverse=True)) for a, b in linked if least[a] != least[b]}


def test_tokens_that_many_classes_hold(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(jaccard, "FREQUENT", 1)
    texts = []
    for k in range(120):
        w = [f"s{j}" for j in range(60)]
        for j in rng.sample(range(60), rng.randrange(4)):
            w[j] = f"e{k}x{j}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = {(r["u"], r["v"]) for r in jaccard.links(df, all_links=True)[2].collect()}
    sets = [shingled(t) for t in texts]
    kinds = {frozenset(s) for s in sets}
    want = sum(100 * len(a & b) >= 80 * len(a | b) for k, a in enumerate(kinds) for b in list(kinds)[:k])
    assert len({tuple(sorted(x)) for x in plain}) == want


def test_keep_one_goes_by_rows(spark):
    a = "the same twelve words stand in this text and in another one"
    rows = [(1, a, 1), (2, a, 2), (2, "a text of its own that no other document comes near at all", 3), (None, a, 4), (None, "", 5), (7, "", 6), (7, "", 7), (1, a, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark int")
    kept = sorted(tuple(r) for r in jaccard.keep_one(df).select("doc_id", "text", "mark").collect() if r["text"])
    assert [(r[0], r[1]) for r in kept] == [(1, a), (2, rows[2][1])] and kept[0][2] in (1, 8)
    assert sorted(r["mark"] for r in jaccard.keep_one(df).collect() if not r["text"]) == [5, 6, 7]
    nulls = spark.createDataFrame([(None, a, 1), (None, a, 2), (9, a + " x", 3)], df.schema)
    assert [r["doc_id"] for r in jaccard.keep_one(nulls).collect()] == [9]


@pytest.mark.parametrize("hot", [2, 1024])
def test_hot_passages(spark, monkeypatch, hot):
    rng = random.Random(hot)
    monkeypatch.setattr(suffix, "HOT", hot)
    passage = "a passage that very many of the documents hold, word by word, to its very end"
    texts = [" ".join([*(f"{rng.randrange(10**6)}" for _ in range(rng.randrange(12))), passage, *(f"{rng.randrange(10**6)}" for _ in range(rng.randrange(12)))]) for _ in range(60)]
    texts += [passage * 2, passage[:50], passage[:49], "ab" * 700, "x" + "ab" * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    least = {}
    for k, t in enumerate(texts):
        for p in range(len(t) - 49):
            least.setdefault(t[p : p + 50], k)
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix.digests(df).collect()}
    for k, t in enumerate(texts):
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - 49):
            if least[t[p : p + 50]] < k:
                gone[p : p + 50] = True
        assert got[k] == (int(gone.sum()), int(np.diff(gone.astype(int), prepend=0).clip(0).sum()))


def test_names_that_clash(spark):
    good = " ".join(f"word{k % 37}x{k}" for k in range(60)) + ". And more, of it."
    rows = [(1, good, "a", 9, 9, 9, "h"), (2, good + " too", "b", 9, 9, 9, "h"), (3, "junk", "b", 9, 9, 9, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int, size int, copies int, mark string")
    assert quality.judge(df).columns.count("n_words") == 1
    assert {r["n_words"] for r in quality.judge(df).collect()} == {64, 65, 1}
    for out in (quality.keep_good(df), mixing.mix(df), jaccard.keep_one(df), suffix.cut_repeats(df)):
        assert out.columns == df.columns and {r["n_words"] for r in out.collect()} == {9} and {r["mark"] for r in out.collect()} == {"h"}
    assert mixing.copies(df, ["doc_id", "size"]).columns == ["doc_id", "size", "source_size", "target", "copies"]
    assert scoring.score(df).count() == 3
    upper = df.withColumnRenamed("n_words", "N_WORDS")
    assert quality.keep_good(upper).columns == upper.columns


def test_mix_meets_targets_with_the_rates_of_a_plain_solver(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = mixing.copies(docs, ["doc_id", "source"]).collect()
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    for rows in by.values():
        target, sizes = rows[0]["target"], np.array([r["size"] for r in rows if r["size"]], float)
        taken = sum(r["copies"] * r["size"] for r in rows)
        # a source ends within a document of its target, and large ones much nearer
        assert abs(taken - target) <= max(np.median(sizes), 1e-3 * target) + 1
        # the tilted rates, by bisection
        unit, low, high = sum(r["size"] for r in rows) / len(sizes), -745.0, 745.0
        if target >= 2 * sizes.sum() * (1 - 1e-9):
            continue
        rate = lambda tilt: np.minimum(2.0, 1.5 * np.exp(np.minimum(700, tilt * sizes / unit)))
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if (rate(middle) * sizes).sum() < target else (low, middle)
        expected = dict(zip(sizes.tolist(), rate(low).tolist(), strict=True))
        copies, counts = Counter(), Counter()
        for r in rows:
            if r["size"]:
                copies[r["size"]] += r["copies"]
                counts[r["size"]] += 1
        # carried from size to size, no size departs from its rate by more than rounding and what a larger one left over
        for size in counts:
            assert abs(copies[size] - expected[size] * counts[size]) <= 1 + max(sizes) / size
        wide = [s for s in counts if counts[s] > 3]
        assert all(abs(copies[s] / counts[s] - expected[s]) < 1.2 for s in wide)


def plain_em(votes, rounds=20):
    """EM over rows of votes (+, -, 0), as the operator states it."""
    k = len(quality.RULES)
    odds, plus, minus = math.log(quality.START[0] / (1 - quality.START[0])), [math.log((1 - quality.START[1]) / (1 - quality.START[2]))] * k, [math.log(quality.START[1] / quality.START[2])] * k
    score = lambda v: 1 / (1 + math.exp(-(odds + sum(plus[i] if c == "+" else minus[i] if c == "-" else 0 for i, c in enumerate(v)))))
    for _ in range(rounds):
        p = [score(v) for v in votes]
        new_odds = math.log((sum(p) + 1) / (len(p) - sum(p) + 1))
        new_plus, new_minus = [], []
        for i in range(k):
            gp, gm = sum(x for x, v in zip(p, votes) if v[i] == "+"), sum(x for x, v in zip(p, votes) if v[i] == "-")
            bp, bm = sum(1 - x for x, v in zip(p, votes) if v[i] == "+"), sum(1 - x for x, v in zip(p, votes) if v[i] == "-")
            g, b = (gm + 0.5) / (gp + gm + 1), (bm + 0.5) / (bp + bm + 1)
            new_plus.append(max(0.0, math.log((1 - g) / (1 - b))))
            new_minus.append(min(0.0, math.log(g / b)))
        moved = max(abs(a - b) for a, b in zip([odds, *plus, *minus], [new_odds, *new_plus, *new_minus]))
        odds, plus, minus = new_odds, new_plus, new_minus
        if moved < 1e-3:
            break
    return score


def test_quality_against_plain_em(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    voted = {r["doc_id"]: r for r in quality.votes(quality.features(docs.select("doc_id", "text"))).collect()}
    failed = {i: r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"] for i, r in voted.items()}
    score = plain_em([r["_votes"] for i, r in voted.items() if not failed[i]])
    for r in quality.judge(docs.select("doc_id", "text")).collect():
        p = score(voted[r["doc_id"]]["_votes"])
        assert r["quality"] == pytest.approx(p, abs=1e-6)
        assert r["kept"] == (not failed[r["doc_id"]] and p >= 0.5) or abs(p - 0.5) < 1e-6


def test_variety_of_long_texts(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(40)]
    rows = [(n, " ".join(rng.choices(words, k=n)) + ".") for n in (300, 1990, 2010, 9000)]
    got = quality.votes(quality.features(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    at = [name for name, *_ in quality.RULES].index("variety")
    assert {r["_votes"][at] for r in got} == {"-"}


def test_packing_betters_best_fit(spark):
    """Triples that fill a sequence exactly, which best fit by decreasing size does not find."""
    rng = np.random.default_rng(0)
    sizes = []
    for _ in range(100):
        a = int(rng.integers(260, 490))
        b = int(rng.integers(256, min(490, 1024 - a - 256)))
        sizes += [a, b, 1024 - a - b]
    rng.shuffle(sizes)
    plain = packing.best_fit(packing._decreasing(list(range(300)), sizes, rng, 0.0), sizes, 1024, ([], []))
    rows = [(k, k, 0, 0, int(n), 0) for k, n in enumerate(sizes)]
    got = packing.pack(spark.createDataFrame(rows, packing.PIECES)).collect()
    at = defaultdict(list)
    for r in got:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(got) == 300 and 100 <= len(at) <= len(plain[0]) - 2
    for places in at.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(places[-1]) <= 1024


def test_nearest_odd_vectors(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 4)).tolist()
    rows = [(k, x, 1) for k, x in enumerate(v)]
    rows += [(50, v[0], 2), (100, [math.inf, 0.0, 1.0, 2.0], 1), (150, [1.0, 2.0], 1), (151, [2.0, 4.0], 1), (None, [1.0] * 4, 1), (200, [-math.inf] * 4, 1), (250, [], 1)]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        by[r["query_id"]].append(r)
    assert set(by) == {0, 50, 150}
    assert [(r["vec_id"], r["rank"]) for r in by[150]] == [(151, 1)]
    held = {k: x for k, x, _ in rows if k is not None and k < 60}
    held[50] = min(v[0], v[50])
    for q in (0, 50):
        assert len({r["vec_id"] for r in by[q]}) == 5 and [r["rank"] for r in by[q]] == [1, 2, 3, 4, 5]
        cos = {k: np.dot(held[q], x) / np.linalg.norm(held[q]) / np.linalg.norm(x) for k, x in held.items() if k != q}
        assert all(r["score"] == pytest.approx(cos[r["vec_id"]], abs=1e-12) for r in by[q])


def test_nearest_among_many_equal_vectors(spark):
    rng = np.random.default_rng(3)
    kinds = rng.integers(-2, 3, size=(12, 4)).astype(float) + 0.5
    vecs = np.concatenate([np.repeat(kinds[:1], 400, axis=0), kinds[rng.integers(0, 12, 300)], 2 * kinds[rng.integers(0, 12, 50)]])
    ids = rng.permutation(len(vecs)).tolist()
    got = defaultdict(list)
    for r in nearest.search(spark.createDataFrame(list(zip(ids, vecs.tolist(), strict=True)), "vec_id long, embedding array<double>")).orderBy("rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    norms = np.sqrt((vecs * vecs).sum(axis=1))
    assert set(got) == {k for k in ids if k % 50 == 0}
    for q in np.flatnonzero(np.array(ids) % 50 == 0):
        score = (vecs[q] * vecs).sum(axis=1) / (norms[q] * norms)
        want = sorted((-s, i) for s, i in zip(score.tolist(), ids, strict=True) if i != ids[q])[:5]
        assert got[ids[q]] == [(-s, i) for s, i in want]


def test_recall_on_the_test_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    ids, v = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = defaultdict(set)
    for r in nearest.search(table).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[q]
        s[q] = -9
        best = set(ids[np.argsort(-s)[:5]].tolist())
        hits, total = hits + len(best & got[ids[q]]), total + 5
    assert hits >= 0.9 * total


def test_warc_odd_tables(spark):
    schema = "id long, url string, time long, kind string, headers map<string,string>, digest string, status string, canonical string"
    assert warc.resolve(spark.createDataFrame([], schema)).count() == 0
    long = "http://ex.com/" + "x" * 200_000
    rows = [(1, long, 1, "response", {"etag": "a"}, "d", "s", "c"), (2, long, 2, "revisit", {"etag": "a"}, "d", "s", "c"), (2, long, 2, "revisit", {"etag": "a"}, "d", "s", "c")]
    got = warc.resolve(spark.createDataFrame(rows, schema)).collect()
    assert [(r["id"], r["status"], r["response_id"]) for r in got] == [(2, "resolved", 1)] * 2


def test_chat_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.read_back(chat.format_chats(chat.canonical_rows(spark.createDataFrame([], schema)), "conv_id"), "conv_id").count() == 0
    long = "~<[" * 100_000
    got = chat.read_back(chat.format_chats(chat.canonical_rows(spark.createDataFrame([(1, 0, "assistant", long)], schema)), "conv_id"), "conv_id").first()
    assert got["loss_chars"] == len(long)


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    schema = docs.schema
    text = " ".join(f"odd{k}" for k in range(80)) + ". Some more words, of one text."
    rows = [(None, text, None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (3, text, "en", "b", 1), (3, text, "en", "b", 1), (4, text + " é", "en", None, 1)]
    odd = spark.createDataFrame([tuple(dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)).get(c) for c in docs.columns) for r in rows], schema)
    for k, df in enumerate((odd, docs.limit(0))):
        df.write.parquet(str(tmp_path / f"{k}/documents.parquet"))
        out = p.run(spark, str(tmp_path / str(k)))
        ids = {r["doc_id"] for r in out.collect()}
        assert ids == ({3} if k == 0 else set())


def test_pipeline_sequences_hold_all_that_the_mix_takes(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("extra", F.lit("size"))
    mixed = p.STAGES[3][1](spark, docs, DATA)
    sizes = Counter()
    taken = Counter()
    for r in mixed.select("doc_id").collect():
        taken[r["doc_id"]] += 1
    expected = {r["doc_id"]: r["copies"] for r in mixing.copies(docs, ["doc_id"]).where("copies > 0").collect()}
    assert taken == expected
    packed = p.STAGES[4][1](spark, mixed, DATA).collect()
    pieces = Counter((r["doc_id"], r["piece"]) for r in packed)
    assert all(n == taken[i] for (i, _), n in pieces.items()) and {i for i, _ in pieces} == set(taken)
    for r in packed:
        sizes[r["sequence_id"]] += r["length"]
    assert max(sizes.values()) <= 1024


def test_warc_files(spark, tmp_path):
    import gzip

    def record(kind, n, date, http, url="http://ex.com/a", **more):
        block = http.encode()
        head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:{n}>", "WARC-Target-URI": url, "WARC-Date": date, "Content-Length": len(block)} | more
        return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"

    full = 'HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nETag: "x"\r\n\r\n<html>WARC/ in a text</html>'
    again = 'HTTP/1.1 304 Not Modified\r\nETag: "x"\r\nDate: today\r\n\r\n'
    made = [
        record("warcinfo", 0, "2024-01-01T00:00:00Z", "software: none"), record("response", 1, "2024-01-01T00:00:00Z", full),
        record("revisit", 2, "2024-01-02T00:00:00Z", again), record("revisit", 3, "no date", again), record("response", 4, "2024-01-03T00:00:00Z", "broken"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(made[:2]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, made[2:])))
    (tmp_path / "c.warc").write_bytes(b"")
    captures = warc.read(spark, str(tmp_path))
    assert {(r["kind"], r["status"], r["time"]) for r in captures.collect()} == {
        ("response", 200, 1704067200), ("revisit", 304, 1704153600), ("revisit", 304, None), ("response", None, 1704240000),
    }
    got = {r["status"]: r for r in warc.resolve(captures).collect()}
    assert set(got) == {"resolved", "missing"} and dict(got["resolved"]["headers"]) == {"content-type": "text/html", "etag": '"x"', "date": "today"}


def test_token_counts_line_by_line(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(60).collect()
    rows = [tuple(r) for r in docs] + [(-1, None), (-2, ""), (-3, "\n"), (-4, "a\n\n\nb  c\n"), (-5, "é\n日本語 テスト\n\n😀"), (-4, "a\n\n\nb  c\n")]
    got = Counter()
    for r in counting.count_by_line(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[tuple(r)] += 1
    want = Counter()
    for doc_id, text in rows:
        if not text:
            want[doc_id, None, 0, 0, 0, 0] += 1
            continue
        lines, at = [], 0
        for line in text.split("\n"):
            lines.append((at, min(at + len(line) + 1, len(text))))
            at += len(line) + 1
        lines = [x for x in lines if x[0] < len(text)]
        counts, offsets = [0] * len(lines), plain.encode(text, add_special_tokens=False).offsets
        for a, b in offsets:
            held = [min(b, y) - max(a, x) for x, y in lines]
            point = [k for k, (x, y) in enumerate(lines) if a == b and x <= a <= y]
            if max(held) > 0:
                counts[held.index(max(held))] += 1
            elif point:
                counts[max(k for k in point if lines[k][0] <= a)] += 1
        for k, (x, y) in enumerate(lines):
            want[doc_id, k, x, y, counts[k], len(offsets)] += 1
    assert got == want


def test_scoring_packs_what_repeats():
    rng = np.random.default_rng(2)
    which = np.minimum(rng.zipf(1.3, 20_000), 500) - 1
    for x in (rng.integers(0, 1 << 63, 500).astype(np.uint64)[which], rng.random(500)[which], rng.random(50), np.empty(0)):
        assert (scoring._unpack(scoring._pack_coded(x), x.dtype) == x).all()
    assert len(scoring._pack_coded(rng.random(500)[which])) < 2.5 * len(which)
    counts = which.astype(np.uint32)
    assert (scoring._unpack(scoring._pack(counts), np.uint32) == counts).all() and len(scoring._pack(counts)) < 1.5 * len(counts)


def test_parities_part_what_all_orders_agree_on(spark):
    rng = np.random.default_rng(5)
    for n, m, both in ((40, 45, 38), (300, 280, 150), (1000, 1030, 900), (7, 3000, 5), (1, 1, 1)):
        tokens = np.unique(rng.integers(0, 1 << 63, n + m - both, np.uint64))
        a, b = np.sort(tokens[:n]), np.sort(tokens[n - both :])
        assert jaccard.apart(jaccard.parities(a), jaccard.parities(b)) <= n + m - 2 * both
        assert jaccard.apart(jaccard.parities(b), jaccard.parities(b.copy())) == 0
    # pairs of 60 % and of just 80 % (800 of 1000): all share prefix tokens under all orders
    sets, pairs = [], []
    for k, both in enumerate([675] * 4 + [800] * 4):
        tokens = rng.permutation(np.unique(rng.integers(0, 1 << 63, 1800 - both, np.uint64)))
        sets += [(2 * k, np.sort(tokens[:900]).tobytes()), (2 * k + 1, np.sort(tokens[900 - both :]).tobytes())]
        pairs.append((2 * k, 2 * k + 1))
    none = spark.sparkContext.broadcast((np.empty(0, np.uint64), np.empty(0, np.int64)))
    found = jaccard._agreed(spark.createDataFrame(pairs, "u long, v long"), spark.createDataFrame(sets, "id long, set binary"), none, 80)
    assert sorted(map(tuple, found.collect())) == pairs[4:]


def test_scoring_asks_by_numbers_of_words(spark):
    # what blocks ask and keep names words by small numbers: hashes of eight bytes, which do not compress, took most of it
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(3000)]
    rows = [(k, " ".join(words[j] for j in rng.zipf(1.3, 400) % 3000)) for k in range(200)]
    first = scoring._tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted(r["kind"] for r in first) == [scoring.TOKENS, scoring.WORDS]
    tokens, seen = sorted((r.asDict() for r in first), key=lambda r: r["kind"])
    hashes, counts = scoring._unpack(seen["a"], np.uint64), scoring._unpack(seen["b"], np.uint32)
    block = scoring._Block(tokens)
    block.named(counts.astype(np.int64), 1 + np.argsort(np.argsort(-counts.astype(np.int64), kind="stable")).astype(np.uint64))
    assert sorted(block.words.tolist()) == list(range(1, len(hashes) + 1))
    block.p = np.ones(len(block.t))
    asked = scoring._questions(block, 1).to_pylist()[0]
    assert len(asked["a"]) + len(asked["d"]) < 2.5 * (len(scoring._unpack(asked["a"], np.uint64)) + len(scoring._unpack(asked["d"], np.uint64)))


def test_jaccard_writes_few_files_under_many_partitions(spark):
    # with a file for each shuffle partition, small tables took most of the time where a session has many partitions
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    most = 2 * spark.sparkContext.defaultParallelism
    for k, v in zip(held, (str(3 * most), "false"), strict=True):
        spark.conf.set(k, v)
    try:
        rows = [(k, " ".join(f"w{(k // 2, j)}".replace(" ", "") for j in range(30)) + " end" * (k % 2)) for k in range(20 * most)]
        _, classes, found = jaccard.links(spark.createDataFrame(rows, "doc_id long, text string"))
        assert len(classes.inputFiles()) <= most and len(found.inputFiles()) <= 3 * most
        assert classes.count() == len(rows) and found.distinct().count() == len(rows) // 2
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
