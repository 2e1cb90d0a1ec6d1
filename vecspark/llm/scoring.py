"""Language-model scores by a probabilistic suffix tree over words.

A context, the words before a token, is a state if what follows it differs from what follows its suffix: the divergence of the two
distributions, times the context's count, must exceed a threshold that grows with the logarithm of all tokens. A token is scored in
the longest state that its past ends in. A state gives mass by count to the words that follow it at least twice, and the rest, plus a
constant, by its suffix's distribution; at the root that is the smoothed share of each word. So every distribution sums to 1.

Contexts are learned by length, in steps that are exchanges between blocks of tokens and tasks that each hold some contexts with all
that follows them. A block sends each context it has with its following words, their counts in training texts and their probability
so far, that of the context's suffix. The task adds up, tests and answers what the block needs to update the probabilities of its own
tokens, those of the texts to be scored included. Nothing is collected; each exchange is a table in the shared folder.

What a longer context sees is some of what its suffix sees. So its count times its divergence from its suffix is at most the suffix's
code length of all that, and, as the divergence is convex, at most the gain of some words with all their occurrences. A context for
which such a bound is below the threshold has no state among its extensions, and only the others go on. A context seen once, and a word
that followed its suffix once, are not sent. None of this changes the result, up to contexts of DEPTH words, the usual bound of
the method.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.hashing import word_hashes
from vecspark.runtime import discard, partitions_for, save

#: Least count of a word after a context to be listed; words of the longest contexts; constant of the smoothing.
LEAST, DEPTH, STRENGTH = 2, 8, 5.0
#: Words of the contexts that blocks ask about. Tokens whose context goes on from there are few; they go, with what stands before them,
#: to the task of that context, which takes them to the end.
BY_BLOCK = 3
#: Tokens of a block; pairs of a context and a word that one task holds.
BLOCK, PAIRS = 1 << 20, 1_000_000
#: The end of a text, as a word.
END = np.uint64(0x5DEECE66D1234567)
ADD = 0.1
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

MANY = 1 << 40
#: Kinds of rows: a block of tokens, answers to it, questions, results of documents, a count, and a block's words.
TOKENS, ANSWER, QUESTION, DONE, COUNT, WORDS = range(6)
_ROW = "kind int, block long, level int, part long, n long, a binary, b binary, c binary, d binary, e binary, f binary"
_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6]


def held_out(doc_id: int | None, folds: int = 10) -> bool:
    """crc32 of the id as text; a null id is an empty text."""
    return crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == 0


def _pack(x: np.ndarray) -> bytes:
    """First bytes of all numbers first, then the second ones, up to the last that any needs, compressed. After a mark, how many bytes
    each number has here, and the size."""
    if not len(x):
        return b""
    parts = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)
    width = parts.shape[1]
    if x.dtype.kind in "iu" and (x.dtype.kind == "u" or x.min() >= 0):
        width = max(1, (int(x.max()).bit_length() + 7) // 8)
    planes = np.empty((width, len(x)), np.uint8)
    for k in range(width):
        planes[k] = parts[:, k]
    return b"\0" + bytes([width]) + planes.size.to_bytes(8, "little") + pa.compress(planes.data, codec="zstd", asbytes=True)


def _pack_coded(x: np.ndarray) -> bytes:
    """As ``_pack``, of numbers of eight bytes that repeat: the distinct ones, and which of them each is, where that is shorter."""
    one, number = np.unique(np.ascontiguousarray(x).view(np.uint64), return_inverse=True)
    if 4 * len(one) > 3 * len(x):
        return _pack(x)
    head = _pack(one)
    return b"\1\0" + len(head).to_bytes(8, "little") + head + _pack(number.astype(np.uint32))


def _unpack(blob: bytes, kind) -> np.ndarray:
    if not blob:
        return np.empty(0, kind)
    width, size = blob[1], int.from_bytes(blob[2:10], "little")
    if blob[0]:
        return _unpack(blob[10 : 10 + size], kind)[_unpack(blob[10 + size :], np.uint32)]
    planes = np.frombuffer(pa.decompress(blob[10:], size, codec="zstd"), np.uint8).reshape(width, -1)
    out = np.zeros(planes.shape[1], kind)
    parts = out.view(np.uint8).reshape(len(out), -1)
    for k in range(width):
        parts[:, k] = planes[k]
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (kind, block, level, part, n, arrays...); arrays that are packed already stay as they are."""
    packed = ((*r[:5], *(x if isinstance(x, bytes) else _pack(x) for x in r[5:]), *[None] * (11 - len(r))) for r in rows)
    columns = list(zip(*packed, strict=True)) or [()] * 11
    names = [x.split()[0] for x in _ROW.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=names)


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a context with one more word before it."""
    h = (h * _STEP[0]) ^ (h >> np.uint64(29))
    return (h + word) * _STEP[1]


def _ordered(x: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in the order of the values, values in order) of numbers below ``top``. Sorting values with their places behind them is
    several times as fast as sorting places."""
    bits = max(1, len(x).bit_length())
    if top.bit_length() + bits > 63:
        by = np.argsort(x, kind="stable")
        return by, x[by]
    both = (x.astype(np.int64) << bits) | np.arange(len(x))
    both.sort()
    return both & ((1 << bits) - 1), both >> bits


def _unique(x: np.ndarray, top: int = 1 << 64) -> tuple[np.ndarray, np.ndarray]:
    """(place of one of each value, number of each one's value), values in order; ``top``: what all are below."""
    if top < 1 << 63:
        by, values = _ordered(x, top)
    else:
        by = np.argsort(x)
        values = x[by]
    new = np.ones(len(x), bool)
    new[1:] = values[1:] != values[:-1]
    number = np.empty(len(x), np.int32)
    number[by] = np.cumsum(new, dtype=np.int32) - 1
    return by[new], number


def _tokens(docs: DataFrame) -> DataFrame:
    """Blocks of tokens: the order of the distinct words' hashes, the tokens as numbers of those words, lengths of the texts, ids, and
    twice each text's number, plus 1 if the id is null. ``n``: training tokens. And for each block a row of WORDS: their hashes in
    order, and counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        hashes: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size, number = 0, TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            lengths = np.concatenate(counts) + 1
            ends = np.cumsum(lengths) - 1
            t = np.empty(int(lengths.sum()), np.uint64)
            inner = np.ones(len(t), bool)
            inner[ends] = False
            t[inner] = np.concatenate(hashes)
            t[ends] = END
            one, which = _unique(t)
            # the most frequent words get the smallest numbers
            by = np.argsort(-np.bincount(which), kind="stable")
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            counted = t[one]
            which = rank[which]
            train = np.array([not held_out(i) for i in ids])
            seen = np.bincount(which, weights=np.repeat(train, lengths), minlength=len(by))[rank].astype(np.uint32)
            held = np.array([0 if i is None else i for i in ids], np.int64)
            place = 2 * np.arange(len(ids), dtype=np.uint32) + np.array([i is None for i in ids])
            arrays = (rank.astype(np.uint32), which.astype(np.uint32), lengths.astype(np.uint32), held, place.astype(np.uint32))
            return _rows([(TOKENS, number, 0, 0, int(lengths[train].sum()), *arrays), (WORDS, number, 0, 0, 0, counted, seen)])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                h, n = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()])
                ids += part.column(0).to_pylist()
                hashes.append(h)
                counts.append(n)
                size += len(h) + len(n)
                if size >= BLOCK:
                    yield out()
                    ids, hashes, counts, size, number = [], [], [], 0, number + 1
        if ids:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ROW)


class _Block:
    """Tokens of some texts, and for those still open the context reached and the probability so far."""

    def __init__(self, row: dict) -> None:
        self.number, self.level = row["block"], row["level"]
        #: numbers of the words that all blocks share; at first the places of the block's own ones in the order of their hashes
        self.words = _unpack(row["a"], np.uint64)
        self.t = _unpack(row["b"], np.uint32).view(np.int32)
        self.lengths = _unpack(row["c"], np.uint32).astype(np.int64)
        self.ids, self.place = _unpack(row["d"], np.int64), _unpack(row["e"], np.uint32)
        held = [held_out(None if n & 1 else i) for i, n in zip(self.ids.tolist(), self.place.tolist(), strict=True)]
        self.train = ~np.repeat(np.array(held, bool), self.lengths)
        self.first = np.repeat((np.cumsum(self.lengths) - self.lengths).astype(np.int32), self.lengths)
        self.at = np.arange(len(self.t), dtype=np.int32)
        self.hash = np.zeros(len(self.t), np.uint64)
        self.context = np.zeros(len(self.t), np.int32)
        self.p = np.ones(len(self.t))
        #: how often what stands here followed the context so far, in training texts; many where that was not asked
        self.before = np.full(len(self.t), MANY)
        if row["f"]:
            state = _unpack(row["f"], np.uint8)
            n = len(state) // 13
            whole = lambda x, kind: np.ascontiguousarray(x.reshape(-1, n).T).reshape(-1).view(kind)
            self.at = np.cumsum(whole(state[: 4 * n], np.uint32)).astype(np.int32)
            self.p[self.at] = whole(state[4 * n : 12 * n], float)
            self.before[self.at] = np.where(state[12 * n :], LEAST, 0)
            self.hash = np.zeros(n, np.uint64)
            for k in range(1, self.level + 1):
                self.hash = _longer(self.hash, self.words[self.t[self.at - k]])
            self.context = _unique(self.hash)[1]

    def named(self, counts: np.ndarray, codes: np.ndarray) -> None:
        """Of the words, in the order of their hashes, counts in training texts and shared numbers."""
        place = self.words
        self.words, count = np.empty(len(place), np.uint64), np.empty(len(place), np.int64)
        self.words[place], count[place] = codes, counts
        self.before = count[self.t]

    def left(self) -> tuple:
        """The row of what is still open."""
        doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        keep = np.zeros(len(self.lengths), bool)
        keep[doc[self.at]] = True
        inside = keep[doc]
        moved = np.cumsum(inside) - 1
        some = np.unique(self.t[inside])
        number = np.zeros(len(self.words), np.uint32)
        number[some] = np.arange(len(some))
        often = (self.before[self.at] >= LEAST).astype(np.uint8)
        planes = lambda x: x.view(np.uint8).reshape(len(x), -1).T.ravel()
        state = np.concatenate([planes(np.diff(moved[self.at], prepend=0).astype(np.uint32)), planes(self.p[self.at]), often])
        arrays = (self.words[some], number[self.t[inside]], self.lengths[keep].astype(np.uint32), self.ids[keep], self.place[keep], state)
        return (TOKENS, self.number, self.level, 0, 0, *arrays)

    def ask(self) -> tuple[np.ndarray, ...]:
        """Go to contexts that are a word longer. (hash of each context, its words from the last to the first, how many pairs of it are
        sent, unsent training tokens; word of each pair sent, count in training, place of a token), ordered by task; what ``hear`` needs
        is kept."""
        self.level += 1
        n, size = self.level, len(self.words)
        keep = (self.at - n >= self.first[self.at])
        # the context, as a word after the one before: seen once it is nothing
        keep[keep] &= self.before[self.at[keep] - 1] >= LEAST
        self.at, self.context, self.hash = self.at[keep], self.context[keep], self.hash[keep]
        earlier = self.t[self.at - n]
        if n == 1:
            one = np.full(size, -1)
            one[earlier] = np.arange(len(earlier))
            self.context = (np.cumsum(one >= 0, dtype=np.int32) - 1)[earlier]
            one = one[one >= 0]
        else:
            key = self.context * np.int64(size) + earlier
            one, self.context = _unique(key, int(key.max(initial=0)) + 1)
        context_hash = _longer(self.hash[one], self.words[earlier[one]])
        self.hash = context_hash[self.context]
        # contexts in the order of their hashes, so of the tasks that they go to; pairs by context
        self.order = np.argsort(context_hash)
        rank = np.empty(len(one), np.int32)
        rank[self.order] = np.arange(len(one))
        self.context = rank[self.context]
        listed = self.before[self.at] >= LEAST
        at, context = self.at[listed], self.context[listed]
        place, number = _unique(context * np.int64(size) + self.t[at], len(one) * size + 1)
        self.pair = np.full(len(self.at), -1, np.int32)
        self.pair[listed] = number
        counts = np.bincount(number, weights=self.train[at], minlength=len(place)).astype(np.uint32)
        unsent = np.bincount(self.context[~listed], weights=self.train[self.at[~listed]], minlength=len(one)).astype(np.uint32)
        sizes = np.bincount(context[place], minlength=len(one)).astype(np.uint32)
        some, ends = at[place], self.at[one[self.order]]
        # on the first level a word's count stands for its probability
        so_far = self.before[some].astype(np.uint64) if n == 1 else self.p[some]
        words = np.stack([self.words[self.t[ends - k]] for k in range(1, n + 1)])
        return context_hash[self.order], words, sizes, unsent, self.words[self.t[some]], counts, so_far

    def hear(self, own: np.ndarray, seen: np.ndarray, rest: np.ndarray, flags: np.ndarray) -> None:
        """Answers: how often each pair sent was seen, if often enough; of each context all tokens, those not listed, and whether it
        is a state (1) and goes on (2)."""
        mine = np.where(self.pair >= 0, np.append(own, 0)[self.pair], 0).astype(np.int64)
        self.before[:] = MANY
        self.before[self.at] = mine
        state, s = flags[self.context] & 1 > 0, seen[self.context].astype(float)
        p = self.p[self.at]
        self.p[self.at] = np.where(state, (mine + (rest[self.context] + STRENGTH) * p) / (s + STRENGTH), p)
        on = flags[self.context] & 2 > 0
        self.at, self.context, self.hash = self.at[on], self.context[on], self.hash[on]

    def closed(self, started: np.ndarray) -> np.ndarray:
        """Of each text, the logarithm of the tokens of ``started`` that go no further."""
        over = started.copy()
        over[self.at] = False
        doc = np.repeat(np.arange(len(self.lengths)), self.lengths)[over]
        return np.bincount(doc, weights=np.log10(self.p[over]), minlength=len(self.lengths))


def _to(h: np.ndarray) -> np.ndarray:
    """Coarse order of contexts by where they go: tasks take ranges of these."""
    return (h >> np.uint64(40)).astype(np.int64)


def _questions(block: _Block, parts: int) -> pa.RecordBatch:
    """What a block asks, a row for each part."""
    context, words, sizes, unsent, word, count, so_far = block.ask()
    to = _to(context) * parts >> 24
    ends = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
    starts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])).tolist() if len(to) else []
    rows = []
    for a, b in zip(starts, [*starts[1:], len(to)], strict=True) if starts else ():
        x, y = ends[a], ends[b]
        past = _pack_coded(so_far[x:y]) if block.level > 1 else so_far[x:y]
        arrays = (words[:, a:b].ravel(), sizes[a:b], unsent[a:b], word[x:y], count[x:y], past)
        rows.append((QUESTION, block.number, block.level, int(to[a]), 0, *arrays))
    return _rows(rows)


def _judge(level: int, total: int, kinds: int):
    """Answers to questions of all blocks about some contexts."""
    need, scale = math.log(max(total, 2)), total + ADD * (kinds + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in b.to_pylist()]
        if not got:
            return
        read = lambda name, kind: [_unpack(r[name], kind) for r in got]
        sizes, words, counts = read("b", np.uint32), read("d", np.uint64), read("e", np.uint32)
        hashes = [reduce(_longer, x.reshape(level, -1), np.zeros(len(x) // level, np.uint64)) for x in read("a", np.uint64)]
        context_of = np.concatenate(hashes)
        one, context = _unique(context_of)
        n = len(one)
        pair_context = np.repeat(context, np.concatenate(sizes))
        word, count = np.concatenate(words), np.concatenate(counts).astype(float)
        if level == 1:
            p = (np.concatenate(read("f", np.uint64)) + ADD) / scale
        else:
            p = np.concatenate(read("f", np.float64))
        # equal pairs, in the order of a hash that depends on nothing but them
        some, pair = _unique(_longer(context_of[one][pair_context], word))
        c, of, p = np.bincount(pair, weights=count, minlength=len(some)), pair_context[some], p[some]
        seen = np.bincount(of, weights=c, minlength=n) + np.bincount(context, weights=np.concatenate(read("c", np.uint32)), minlength=n)
        listed = c >= LEAST
        own = np.where(listed, c, 0.0)
        flags, rest = _tested(of[listed], c[listed], p[listed], seen, need)
        at_context = at_pair = 0
        for r, h, w in zip(got, hashes, words, strict=True):
            k = context[at_context : at_context + len(h)]
            o = own[pair[at_pair : at_pair + len(w)]].astype(np.uint64)
            at_context, at_pair = at_context + len(h), at_pair + len(w)
            yield _rows([(ANSWER, r["block"], level, r["part"], 0, o, seen[k].astype(np.uint64), rest[k].astype(np.uint64), flags[k])])

    return run


def _tested(of: np.ndarray, c: np.ndarray, p: np.ndarray, seen: np.ndarray, need: float) -> tuple[np.ndarray, np.ndarray]:
    """(1 for a state, 2 for a context that goes on, or both; unlisted tokens) of contexts, from their listed words: context, count,
    probability so far."""
    total = lambda x: np.bincount(of, weights=x, minlength=len(seen))
    ratio = c * np.log(c / (seen[of] * p))
    explicit, free, most = total(c), 1 - np.minimum(total(p), 1 - 1e-12), np.zeros(len(seen))
    np.maximum.at(most, of, c)
    rest = seen - explicit
    apart = np.where(rest > 0, rest * np.log(np.maximum(rest, 1) / np.maximum(seen, 1) / free), 0.0)
    state, loose = (explicit > 0) & (total(ratio) + apart > need), (rest + STRENGTH) / (seen + STRENGTH)
    # at most these are the code lengths of what was seen: a state's probability of a word is at least the word's own part of it
    own = total(c * np.log((seen[of] + STRENGTH) / c)) - rest * np.log(loose * free)
    plain = -total(c * np.log(p)) - rest * np.log(free)
    # and this is the most that some of the words, with all their occurrences, can gain over the whole
    scale, top = np.where(state, seen + STRENGTH, np.maximum(seen, 1)), np.maximum(most, rest)
    share = lambda x: np.where(x > 0, x * np.log(scale / np.maximum(x, 1e-300)), 0.0)
    parted = np.maximum(share(np.maximum(top, scale / math.e)), share(np.minimum(seen - top, scale / math.e)))
    parted += np.where(state, -rest * np.log(free), total(np.maximum(ratio, 0)) + np.maximum(apart, 0))
    on = (explicit > 0) & (np.minimum(np.where(state, own, plain), parted) > need)
    return (state + 2 * on).astype(np.uint8), rest


def _count_words(parts: int):
    """Questions about words are answered with their counts in training texts and a number of each, small for frequent ones; and how
    many have any count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in b.to_pylist()]
        if got:
            words = [_unpack(r["a"], np.uint64) for r in got]
            some, number = _unique(np.concatenate(words))
            counts = np.bincount(number, weights=np.concatenate([_unpack(r["b"], np.uint32) for r in got])).astype(np.int64)
            codes = np.empty(len(some), np.uint64)
            codes[np.argsort(-counts, kind="stable")] = np.arange(len(some)) * parts + got[0]["part"] + 1  # 0 stands for none
            yield _rows([(COUNT, 0, 0, 0, int((counts > 0).sum()))])
            at = 0
            for r, w in zip(got, words, strict=True):
                mine = number[at : at + len(w)]
                yield _rows([(ANSWER, r["block"], 0, r["part"], 0, counts[mine], codes[mine])])
                at += len(w)

    return run


def _ask_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                words, counts = _unpack(row["a"], np.uint64), _unpack(row["b"], np.uint32)
                to = _to(words) * parts >> 24
                some = np.unique(to)
                cuts = zip(some.tolist(), np.searchsorted(to, some).tolist(), np.searchsorted(to, some, "right").tolist(), strict=True)
                yield _rows([(QUESTION, row["block"], 0, p, 0, words[a:b], counts[a:b]) for p, a, b in cuts])

    return run


def _advance(level: int, parts: int, total: int, kinds: int, what: str):
    """Blocks, with answers to all that they asked since their rows were written, ``ask`` about contexts of ``level`` words. Or they
    leave results of what goes no further, and a row of what is ``open``, or send it on to be finished (``send``)."""
    scale = total + ADD * (kinds + 1)

    def read(rows: list, name: str, kind) -> np.ndarray:
        return np.concatenate([_unpack(r[name], kind) for r in rows])

    def done(block: _Block, answers: list) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for r in sorted(answers, key=lambda r: (r["level"], r["part"])):
            by.setdefault(r["level"], []).append(r)
        started, fresh = np.zeros(len(block.t), bool), block.level == 0
        started[block.at] = True
        if fresh:
            block.named(read(by[0], "a", np.int64), read(by[0], "b", np.uint64))
            block.p = (block.before + ADD) / scale
            known, base = block.before > 0, np.log10(block.p)
        for n in range(block.level + 1, level):
            block.ask()
            if n in by:
                block.hear(*(read(by[n], name, kind) for name, kind in zip("abcd", (np.uint64, np.uint64, np.uint64, np.uint8), strict=True)))
        if what != "ask":
            results = [block.closed(started), block.place]
            if fresh:
                doc = np.repeat(np.arange(len(block.lengths)), block.lengths)
                sums = [np.bincount(doc, weights=x, minlength=len(block.lengths)) for x in (base, known)]
                results += [block.ids, block.lengths, *sums]
            yield _rows([(DONE, block.number, 0, 0, int(fresh), *results)])
        if len(block.at):
            yield _rows([block.left()]) if what == "open" else _questions(block, parts) if what == "ask" else _sent(block, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, answers = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                if r["kind"] == TOKENS:
                    if block is not None:
                        yield from done(block, answers)
                    block, answers = _Block(r), []
                else:
                    answers.append(r)
        if block is not None:
            yield from done(block, answers)

    return run


def _sent(block: _Block, parts: int) -> pa.RecordBatch:
    """The tokens still open, a row for each part: hash of the context, word, probability, number of the text, whether it is for training,
    and the words before the context, 0 where the text begins."""
    by = np.argsort(_to(block.hash), kind="stable")
    at, h = block.at[by], block.hash[by]
    doc = np.repeat(np.arange(len(block.lengths)), block.lengths)[at]
    history = np.zeros((len(at), DEPTH - BY_BLOCK), np.uint64)
    for k in range(DEPTH - BY_BLOCK):
        there = at - BY_BLOCK - 1 - k
        inside = there >= block.first[at]
        history[inside, k] = block.words[block.t[there[inside]]]
    word, p, place, train = block.words[block.t[at]], block.p[at], block.place[doc], block.train[at].astype(np.uint8)
    to = _to(h) * parts >> 24
    starts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])).tolist()
    cut = lambda a, b: (h[a:b], word[a:b], p[a:b], place[a:b], train[a:b], history[a:b].T.ravel())
    return _rows([(QUESTION, block.number, 0, int(to[a]), 0, *cut(a, b)) for a, b in zip(starts, [*starts[1:], len(to)], strict=True)])


def _finish(total: int):
    """Longer contexts of the tokens of some contexts, to the end: results of their texts."""
    need = math.log(max(total, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in b.to_pylist()]
        if not got:
            return
        read = lambda name, kind: np.concatenate([_unpack(r[name], kind) for r in got])
        h, word, p, train = read("a", np.uint64), read("b", np.uint64), read("c", float).copy(), read("e", np.uint8).astype(float)
        history = np.concatenate([_unpack(r["f"], np.uint64).reshape(DEPTH - BY_BLOCK, -1).T for r in got])
        at = np.arange(len(h))
        for k in range(history.shape[1]):
            at = at[history[at, k] != 0]
            if not len(at):
                break
            h[at] = _longer(h[at], history[at, k])
            one, context = _unique(h[at])
            some, pair = _unique(_longer(h[at], word[at]))
            c, of, seen = np.bincount(pair, weights=train[at]), context[some], np.bincount(context, weights=train[at])
            listed = c >= LEAST
            flags, rest = _tested(of[listed], c[listed], p[at][some][listed], seen, need)
            state = flags[context] & 1 > 0
            own = np.where(listed, c, 0.0)[pair]
            p[at] = np.where(state, (own + (rest[context] + STRENGTH) * p[at]) / (seen[context] + STRENGTH), p[at])
            at = at[flags[context] & 2 > 0]
        logs, first = np.log10(p), 0
        for r in got:
            places, doc = np.unique(_unpack(r["d"], np.uint32), return_inverse=True)
            sums = np.bincount(doc, weights=logs[first : first + len(doc)])
            first += len(doc)
            yield _rows([(DONE, r["block"], 0, 0, 0, sums, places)])

    return run


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text of a DONE row: its block and number, and what the row has of it."""
    names = ["block", "place", "log", "doc_id", "held_out", "n_tokens", "base", "known"]
    for batch in batches:
        for r in batch.to_pylist():
            log, place = _unpack(r["a"], float), _unpack(r["b"], np.uint32)
            n = len(log)
            if r["n"]:
                ids = [None if k & 1 else i for i, k in zip(_unpack(r["c"], np.int64).tolist(), place.tolist(), strict=True)]
                rest = [pa.array(ids, pa.int64()), pa.array([held_out(i) for i in ids], pa.bool_()), pa.array(_unpack(r["d"], np.int64))]
                rest += [pa.array(_unpack(r["e"], float)), pa.array(_unpack(r["f"], float).astype(np.int64))]
            else:
                rest = [pa.nulls(n, k) for k in (pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["block"])), pa.array(place.astype(np.int64)), pa.array(log), *rest], names=names)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    Null texts are empty: one token, the end. A null doc_id counts as an empty text for the fold. Repeated rows are texts of their own.
    Without training rows every token is unknown. Empty in, empty out. Other columns of ``docs``, whatever their names, take no part.
    """
    spark = docs.sparkSession
    first = save(_tokens(docs), "tokens")
    total, blocks = (int(x or 0) for x in first.agg(F.sum("n"), F.count_if(F.col("kind") == TOKENS)).first())
    if not blocks:
        return spark.createDataFrame([], "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    tasks = partitions_for(spark, blocks * BLOCK, PAIRS)
    parts = tasks
    # blocks are dealt out evenly: they are numbered within the task that made them
    nth = F.col("block").bitwiseAND(0xFFFFFFFF)
    most = first.agg(F.max(nth)).first()[0] + 1
    place = F.pmod(F.shiftright("block", 32) * most + nth, F.lit(tasks)).cast("int")

    def exchanged(questions: DataFrame, how, name: str) -> DataFrame:
        return save(questions.repartitionById(tasks, F.col("part").cast("int")).mapInArrow(how, _ROW), name)

    def advanced(level: int, kinds: int, what: str, *rows: DataFrame) -> DataFrame:
        together = reduce(DataFrame.unionByName, rows).where(F.col("kind") <= ANSWER)
        dealt = together.repartitionById(tasks, place).sortWithinPartitions("block", "kind")
        return dealt.mapInArrow(_advance(level, parts, total, kinds, what), _ROW)

    answers = [exchanged(first.where(F.col("kind") == WORDS).mapInArrow(_ask_words(parts), _ROW), _count_words(parts), "counts")]
    # hashes of words, half of the table, are of no more use
    whole, first = first, save(first.where(F.col("kind") == TOKENS), "blocks")
    discard(whole)
    kinds = int(answers[0].where(F.col("kind") == COUNT).agg(F.sum("n")).first()[0] or 0)
    for level in range(1, BY_BLOCK):
        answers.append(exchanged(advanced(level, kinds, "ask", first, *answers), _judge(level, total, kinds), "answers"))
    # the last of these lengths is reached by few tokens, so what is open is written once and read twice
    left = save(advanced(BY_BLOCK, kinds, "open", first, *answers), "left")
    discard(first, *answers)
    last = exchanged(advanced(BY_BLOCK, kinds, "ask", left), _judge(BY_BLOCK, total, kinds), "answers")
    sent = save(advanced(BY_BLOCK + 1, kinds, "send", left, last), "sent")
    rest = exchanged(sent.where(F.col("kind") == QUESTION), _finish(total), "rest")
    finished = [save(x.where(F.col("kind") == DONE), "done") for x in (left, sent, rest)]
    discard(left, last, sent, rest)
    columns = "block long, place long, log double, doc_id long, held_out boolean, n_tokens long, base double, known long"
    rows = reduce(DataFrame.unionByName, finished).mapInArrow(_results, columns)
    whole = rows.groupBy("block", "place").agg(*(f(c).alias(c) for c, f in (("log", F.sum), ("doc_id", F.max), ("held_out", F.max), ("n_tokens", F.max), ("base", F.max), ("known", F.max))))
    return whole.select(
        "doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), F.col("log").alias("score"),
    )
