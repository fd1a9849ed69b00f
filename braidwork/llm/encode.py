"""Token ids of texts by a public byte-level vocabulary, as a reduction over a tree.

A long text is halved down to leaves. A leaf is encoded alone; two neighbours are joined by
encoding again a window around their border. The splitting pattern reads a text from left
to right, and what it takes at a place depends only on the text from there to LOOK
characters past the piece. So the pieces of the left half that end LOOK characters before
the border stand, and as soon as the window, begun at the last such piece, has a piece
start in common with the right half, all pieces behind it stand too. Until then the window
doubles.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.texts import strings

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
LEAF_CHARS = 4096
WINDOW_CHARS = 64
#: Fixed value: the pattern that splits text before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A piece is decided by the two characters behind it, and by three from its start ('ll).
LOOK = 2
SPLIT = regex.compile(PATTERN)


class Node:
    """The pieces of text[beg:end] read alone: where each starts, and its ids."""

    __slots__ = ("beg", "end", "starts", "ids")

    def __init__(self, beg: int, end: int, starts: list[int], ids: list[list[int]]):
        self.beg, self.end, self.starts, self.ids = beg, end, starts, ids


class TreeEncoder:
    """Encodes and decodes with the merges of ``<folder>/<vocabulary>.tiktoken``; no special tokens."""

    def __init__(self, folder: str = FOLDER, vocabulary: str = VOCABULARY, leaf: int = LEAF_CHARS, window: int = WINDOW_CHARS):
        with open(f"{folder}/{vocabulary}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.leaf, self.window = max(1, leaf), max(1, window)

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self.plain.encode_ordinary(text)
        return list(chain.from_iterable(self._node(text, 0, len(text)).ids))

    def decode(self, ids: list[int]) -> str:
        return self._bytes(ids, 0, len(ids)).decode("utf-8", "replace")

    def _bytes(self, ids: list[int], beg: int, end: int) -> bytes:
        if end - beg <= self.leaf:
            return self.plain.decode_bytes(ids[beg:end])
        mid = (beg + end) // 2
        return self._bytes(ids, beg, mid) + self._bytes(ids, mid, end)

    def _piece(self, text: str) -> list[int]:
        return self.plain._encode_single_piece(text)

    def _node(self, text: str, beg: int, end: int) -> Node:
        if end - beg <= self.leaf:
            pieces = [(m.start(), m.group()) for m in SPLIT.finditer(text, beg, end)]
            return Node(beg, end, [s for s, _ in pieces], [self._piece(p) for _, p in pieces])
        mid = (beg + end) // 2
        return self._join(text, self._node(text, beg, mid), self._node(text, mid, end))

    def _join(self, text: str, left: Node, right: Node) -> Node:
        border = right.beg
        keep = len(left.starts) - 1  # the pieces before this one stand
        while keep > 0 and (left.starts[keep] + LOOK > border or left.starts[keep - 1] + LOOK + 1 > border):
            keep -= 1
        begin, size = left.starts[keep], self.window
        while True:
            stop = min(border + size, right.end)
            starts, pieces, meet = [], [], -1
            for m in SPLIT.finditer(text, begin, stop):
                at = m.start()
                if stop < right.end and (m.end() + LOOK > stop or at + LOOK + 1 > stop):
                    # This piece isn't sure yet, but where it starts is.
                    if at >= border:
                        meet = self._same(right, at)
                    break
                if at >= border and (meet := self._same(right, at)) >= 0:
                    break
                starts.append(at)
                pieces.append(m.group())
            if meet >= 0 or stop == right.end:
                break
            size *= 2
        behind = meet if meet >= 0 else len(right.starts)
        return Node(
            left.beg,
            right.end,
            left.starts[:keep] + starts + right.starts[behind:],
            left.ids[:keep] + [self._piece(p) for p in pieces] + right.ids[behind:],
        )

    @staticmethod
    def _same(node: Node, at: int) -> int:
        i = bisect_left(node.starts, at)
        return i if i < len(node.starts) and node.starts[i] == at else -1


@lru_cache(maxsize=4)
def encoder(folder: str, vocabulary: str) -> TreeEncoder:
    """One encoder a worker process."""
    return TreeEncoder(folder, vocabulary)


def _encoded(tree: TreeEncoder, texts: list[str | None]) -> list[list[int]]:
    """Short texts are single leaves and go through in one call; long ones through the tree."""
    short = [i for i, t in enumerate(texts) if t and len(t) <= tree.leaf]
    out: list[list[int]] = [[]] * len(texts)
    for i, ids in zip(short, tree.plain.encode_ordinary_batch([texts[i] for i in short], num_threads=1)):
        out[i] = ids
    for i, t in enumerate(texts):
        if t and len(t) > tree.leaf:
            out[i] = tree.encode(t)
    return out


def encode_texts(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY
) -> DataFrame:
    """``doc_id, ids`` of every row; null and empty texts have the empty list.

    Names of special tokens in a text are ordinary text. Rows stay in their partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = encoder(folder, vocabulary)
        for batch in batches:
            ids = _encoded(tree, strings(batch.column(1)))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
            flat = np.fromiter(chain.from_iterable(ids), np.int32, ends[-1])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_ids(
    df: DataFrame, doc_id: str = "doc_id", ids: str = "ids", folder: str = FOLDER, vocabulary: str = VOCABULARY
) -> DataFrame:
    """``doc_id, text`` of every row; null and empty lists give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = encoder(folder, vocabulary)
        for batch in batches:
            texts = [tree.decode(x) if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id bigint, text string")
