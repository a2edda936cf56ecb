"""Problem 8: encoding of the whole corpus with a public tokenizer.

Method: a monoid tree reduction. A long text is halved recursively; leaves are encoded, neighbours joined
by re-encoding a window around their border that grows until the tokens outside provably stay the same;
decoding concatenates the leaves of the tree.

Why the outside is stable: the vocabulary's pre-tokenizer matches from left to right and its state is its
position alone, and byte pairs are merged within one piece. A piece of the left half that ends at least
LOOK characters before the border, and is followed by one that does so too, is the same in the joined
text, as no match looks further ahead. If a piece of the window begins where a piece of the right half
begins, both go on alike for ever. So the window runs from the last sure border of the left half to the
first border that both it and the right half have; it grows until there is one.

One Arrow pass without a shuffle; the vocabulary (its size is fixed) is broadcast, so that executors need
no file. Texts are handled whole.

Defined results: null and empty texts give an empty list. Special tokens are never produced, their
strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Where the vocabulary files lie; a parameter of every function that needs it.
TOKENIZERS = os.environ.get("CAIRN_TOKENIZERS", "/opt/tokenizers")
NAME = "byte_bpe_50k"
# Fixed value: the published pre-tokenizer pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF, LOOK = 4096, 8


@dataclass
class Node:
    """An encoded stretch of text: its ids, and where each piece begins in the text and in the ids."""

    text: str
    ids: list[int]
    at: list[int]
    id_at: list[int]


class Encoder:
    """Byte-level BPE of one vocabulary; long texts by the tree."""

    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF):
        import regex
        import tiktoken

        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(PATTERN)
        self.leaf = leaf
        self.piece_ids = lru_cache(maxsize=100_000)(lambda p: tuple(self.bpe.encode_ordinary(p)))

    def node(self, text: str) -> Node:
        n = Node(text, [], [], [])
        for m in self.pieces.finditer(text):
            n.at.append(m.start())
            n.id_at.append(len(n.ids))
            n.ids += self.piece_ids(m.group())
        return n

    def join(self, a: Node, b: Node) -> Node:
        if not a.text or not b.text:
            return b if not a.text else a
        # pieces of the left half that end far enough before the border are sure
        k = bisect_left(a.at, len(a.text) - LOOK)
        k = max(0, min(k, len(a.at) - 1) - 1)
        while k > 0 and a.text[a.at[k] : a.at[k] + 1].isspace():  # a run of white space may reach the border
            k -= 1
        cut, size = a.at[k], max(64, LOOK * 4)
        tail = a.text[cut:]
        while True:
            whole = size >= len(b.text)
            window = self.node(tail + b.text[:size])
            sure = len(window.text) if whole else len(window.text) - LOOK
            for i, p in enumerate(window.at):
                q = p - len(tail)
                if q <= 0:
                    continue
                if p > sure or (not whole and i + 1 < len(window.at) and window.at[i + 1] > sure):
                    break
                j = bisect_left(b.at, q)
                if j < len(b.at) and b.at[j] == q:
                    return self._glue(a, k, window, i, b, j, cut, len(a.text))
            if whole:
                return self._glue(a, k, window, len(window.at), b, len(b.at), cut, len(a.text))
            size *= 2

    @staticmethod
    def _glue(a: Node, k: int, w: Node, i: int, b: Node, j: int, cut: int, border: int) -> Node:
        ids = a.ids[: a.id_at[k]]
        mid = w.ids[: w.id_at[i]] if i < len(w.at) else w.ids
        tail = b.ids[b.id_at[j] :] if j < len(b.at) else []
        at = a.at[:k] + [cut + p for p in w.at[:i]] + [border + p for p in b.at[j:]]
        base = len(ids)
        off = base + len(mid) - (b.id_at[j] if j < len(b.at) else 0)
        id_at = a.id_at[:k] + [base + p for p in w.id_at[:i]] + [off + p for p in b.id_at[j:]]
        return Node(a.text + b.text, ids + mid + tail, at, id_at)

    def tree(self, text: str) -> Node:
        """Leaves first, then neighbours level by level: the balanced tree without recursion depth."""
        level = [self.node(text[i : i + self.leaf]) for i in range(0, len(text), self.leaf)]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else Node("", [], [], [])

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= self.leaf:
            return self.bpe.encode_ordinary(text)
        return self.tree(text).ids

    def decode(self, ids: list[int]) -> str:
        """The text; long lists by halves, whose bytes are concatenated up the tree."""

        def go(lo: int, hi: int) -> bytes:
            if hi - lo <= 65536:
                return self.bpe.decode_bytes(ids[lo:hi])
            mid = (lo + hi) // 2
            return go(lo, mid) + go(mid, hi)

        return go(0, len(ids)).decode("utf-8")


def vocabulary(folder: str = TOKENIZERS, name: str = NAME) -> bytes:
    """The vocabulary file, some hundred kilobytes."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def encoder(file: bytes, leaf: int = LEAF) -> Encoder:
    """One encoder per Python worker."""
    return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}, leaf)


def _udf(spark: SparkSession, folder: str, count_only: bool):
    shared = spark.sparkContext.broadcast(vocabulary(folder))

    @F.pandas_udf(T.LongType() if count_only else T.ArrayType(T.IntegerType()))
    def go(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(shared.value)
        for texts in batches:
            yield texts.map(lambda t: len(enc.encode(t))) if count_only else texts.map(enc.encode)

    return go


def token_ids(documents: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids) of every document."""
    return documents.select("doc_id", _udf(documents.sparkSession, folder, False)("text").alias("ids"))


def token_counts(documents: DataFrame, *keep: str, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, the kept columns, n_tokens) of every document."""
    return documents.select("doc_id", *keep, _udf(documents.sparkSession, folder, True)("text").alias("n_tokens"))
