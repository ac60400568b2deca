"""Byte-level BPE by monoid tree reduction.

A text is cut in halves down to leaves.  Every node holds the exact encoding of its own span.  Two
neighbours are joined by re-encoding a window around their border that grows until what lies outside
is proved unchanged, by one of two facts:

* *Class borders.*  The splitting pattern never matches across a change between the classes letter,
  number, other and white space, except from white space to what follows and from an apostrophe to a
  letter.  At such a border both sides encode independently of each other.
* *Pairs.*  Within one match, a sequence of tokens is the BPE encoding of its bytes if every two
  neighbours a, b are the encoding of bytes(a) + bytes(b): up to the first merge over a token border the
  run over the whole does, around that border, what the run over the pair does.

So the work of a join doesn't depend on the length of its sides, except for runs of white space and
the odd apostrophe at a border, where the window grows to the next class border.  Decoding concatenates
the bytes of halves up the same kind of tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from .common import map_rows

LEAF_CHARS = 512
LEAF_IDS = 512
#: How far from a border a class border is looked for before tokens of one long run are joined by pairs.
REACH = 48


class TreeBpe:
    """Encoder and decoder over a rank file; `leaf` is the longest span that is encoded in one go."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF_CHARS):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._piece = self._enc._core_bpe.encode_single_piece
        self._bytes = {i: t for t, i in ranks.items()}
        self._leaf = max(2, leaf)
        self._class = lru_cache(8192)(_char_class)
        self._pair = lru_cache(16384)(self._pair_holds)

    def encode(self, text: str) -> list[int]:
        return self._node(text, 0, len(text)) if text else []

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join([self._bytes[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def _node(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= self._leaf:
            return self._enc.encode_ordinary(text[a:b])
        m = (a + b) // 2
        return self._join(text, a, m, b, self._node(text, a, m), self._node(text, m, b))

    def _border(self, text: str, p: int) -> bool:
        """Whether no match spans position p, whatever surrounds the two characters there."""
        left, right = self._class(text[p - 1]), self._class(text[p])
        return left != right and left != "s" and not (text[p - 1] == "'" and right == "l")

    def _join(self, text: str, a: int, m: int, b: int, left: list[int], right: list[int]) -> list[int]:
        if self._border(text, m):
            return left + right
        p = next((p for p in range(m - 1, max(a, m - REACH), -1) if self._border(text, p)), None)
        if p is None and (joined := self._join_run(text, a, m, b, left, right)) is not None:
            return joined
        p = p if p is not None else next((p for p in range(m - REACH, a, -1) if self._border(text, p)), a)
        q = next((q for q in range(m + 1, b) if self._border(text, q)), b)
        drop, skip = (len(self._enc.encode_ordinary(x)) for x in (text[p:m], text[m:q]))
        return left[: len(left) - drop] + self._enc.encode_ordinary(text[p:q]) + right[skip:]

    def _join_run(self, text: str, a: int, m: int, b: int, left: list[int], right: list[int]) -> list[int] | None:
        """Join inside one run of a class that began at least REACH characters before m; None if that isn't so."""
        kind = self._class(text[m])
        start = max(a, m - REACH)
        if kind == "s" or m - start < REACH or any(self._class(c) != kind for c in text[start:m]):
            return None
        end = m
        while end < b and self._class(text[end]) == kind:
            end += 1
        if kind == "o" and end == m + 1 and text[m] == "'":
            return None  # on its own, the right side may have begun with a contraction
        spare, tail = len(text[start:m].encode()), 0
        while tail < len(left) and spare >= (n := len(self._bytes[left[-1 - tail]])):
            spare, tail = spare - n, tail + 1  # tokens that surely lie in the run
        need, head = len(text[m:end].encode()), 0
        while need > 0:
            need, head = need - len(self._bytes[right[head]]), head + 1
        i = j = 1
        while True:
            i, j = min(i, tail), min(j, head)
            window = self._piece(b"".join([self._bytes[t] for t in left[len(left) - i :] + right[:j]]))
            ok_left = i < len(left) and self._pair(left[-1 - i], window[0])
            ok_right = j == head or self._pair(window[-1], right[j])
            if ok_left and ok_right:
                return left[: len(left) - i] + window + right[j:]
            if (not ok_left and i == tail) or (not ok_right and j == head):
                return None
            i, j = i if ok_left else i * 2, j if ok_right else j * 2

    def _pair_holds(self, x: int, y: int) -> bool:
        return self._piece(self._bytes[x] + self._bytes[y]) == [x, y]


def _char_class(c: str, of=regex.compile(r"(\p{L})|(\p{N})|(\p{White_Space})")) -> str:
    m = of.match(c)
    return "o" if m is None else "lns"[m.lastindex - 1]


_OPEN: dict[tuple, TreeBpe] = {}


def tokenizer(path: str, pattern: str, leaf: int = LEAF_CHARS) -> TreeBpe:
    """One encoder per process and rank file."""
    key = (path, pattern, leaf)
    if key not in _OPEN:
        _OPEN[key] = TreeBpe(*key)
    return _OPEN[key]


def encode_documents(docs: DataFrame, path: str, pattern: str, leaf: int = LEAF_CHARS) -> DataFrame:
    """doc_id, ids array<int>, decoded binary of every row of docs.

    A null text counts as empty: no ids and no bytes.  Repeated rows, null ids and extra columns are
    of no account: one row comes out for each row that comes in.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        bpe = tokenizer(path, pattern, leaf)
        for doc_id, text in rows:
            ids = bpe.encode(text or "")
            yield doc_id, ids, bpe.decode(ids)

    return map_rows(docs.select("doc_id", "text"), "doc_id long, ids array<int>, decoded binary", run)


def digest_documents(docs: DataFrame, path: str, pattern: str, leaf: int = LEAF_CHARS) -> DataFrame:
    """encode_documents() reduced in the same pass to doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null or empty text has no tokens, and both digests are those of the empty string.  An empty table gives no rows.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        bpe = tokenizer(path, pattern, leaf)
        names = {i: str(i) for i in bpe._bytes}
        for doc_id, text in rows:
            ids = bpe.encode(text or "")
            listed = ",".join([names[i] for i in ids]).encode()
            yield doc_id, len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

    return map_rows(docs.select("doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", run)
