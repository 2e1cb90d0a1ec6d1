"""Token ids and spans of whole texts, by a byte-level BPE whose tokenizer file is a parameter.

Each text is encoded whole, by a merger that has vocabulary and merge order from that file. Texts that hold a special token's string go
to the ``tokenizers`` library as they are. No pieces are kept for later texts: looking them up takes longer than merging them again,
and a worker that keeps many has that much less memory for what else it runs.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable

import numpy as np


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in such files: printable Latin-1 characters stand for themselves, others follow from code point 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pieces:
    """A tokenizer. Ids are unsigned little-endian 32-bit numbers."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        special = {x["content"]: x["id"] for x in held.get("added_tokens", [])}
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in token): k for token, k in held["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("from-file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.n_bytes = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for token, k in [*ranks.items(), *((t.encode(), k) for t, k in special.items())]:
            self.n_bytes[k] = len(token)

    def encode(self, text: str) -> bytes:
        if self.special and self.special.search(text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        # twice as fast as a numpy array from a list
        return array("I", self.fast.encode_ordinary(text)).tobytes()

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text."""
        return [self.encode(t) if t else b"" for t in texts]

    def spans(self, text: str, ids: bytes) -> np.ndarray:
        """(start, end) in characters of each token; those that share a character all cover it."""
        ends = np.cumsum(self.n_bytes[np.frombuffer(ids, "<u4")])
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        if text.isascii():
            return np.stack([starts, ends], axis=1)
        at = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1
        return np.stack([at[starts], at[ends - 1] + 1], axis=1)


_LOADED: dict[tuple[type, str], object] = {}


def loaded(kind: type, path: str):
    """One of its kind in each Python worker."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def attribute(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Section of each token: the one that holds most of its characters, the earlier of two that hold as many, -1 if none holds any.

    ``starts`` ascend and sections do not overlap. A token without characters belongs to the section that its place is in.
    """
    if not len(starts) or not len(spans):
        return np.full(len(spans), -1)
    first = np.maximum(np.searchsorted(starts, spans[:, 0], side="right") - 1, 0)
    last = np.maximum(np.searchsorted(starts, np.maximum(spans[:, 1] - 1, spans[:, 0]), side="right") - 1, first)

    def share(k: np.ndarray) -> np.ndarray:
        return np.minimum(ends[k], spans[:, 1]) - np.maximum(starts[k], spans[:, 0])

    best, most = first.copy(), share(first)
    for step in range(1, int((last - first).max(initial=0)) + 1):
        k = np.minimum(first + step, last)
        more = share(k) > most
        best, most = np.where(more, k, best), np.where(more, share(k), most)
    point = (spans[:, 0] == spans[:, 1]) & (spans[:, 0] >= starts[first]) & (spans[:, 0] <= ends[first])
    return np.where((most > 0) | point, best, -1)


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines as sections, each with its line feed; an empty text has none."""
    cuts = [m.end() for m in re.finditer("\n", text)]
    starts = [0, *cuts] if not cuts or cuts[-1] < len(text) else [0, *cuts[:-1]]
    if not text:
        starts = []
    return np.asarray(starts, np.int64), np.asarray([*starts[1:], len(text)] if starts else [], np.int64)


def section_counts(texts: Iterable[str | None], path: str):
    """For each text: its tokens, and of its lines start, end and tokens."""
    pieces = loaded(Pieces, path)
    held = [t or "" for t in texts]
    for text, ids in zip(held, pieces.many(held), strict=True):
        starts, ends = line_sections(text)
        of = attribute(pieces.spans(text, ids), starts, ends)
        yield len(ids) // 4, starts, ends, np.bincount(of[of >= 0], minlength=len(starts)) if len(starts) else np.empty(0, np.int64)
