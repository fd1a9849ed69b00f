"""Choosing closed syncmers: k-mers whose smallest s-mer comes first or last in them.

:func:`closed_syncmers` works on numpy arrays read by read, :func:`closed_syncmers_sql` on whole batches
and gives no hash, order or strand; both for any s < 32.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.functions.sequence import mix_array, plain_bases

_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    _CODE[_b] = _CODE[_b + 32] = _i
_CODE[ord("U")] = _CODE[ord("u")] = 3

_LETTERS = np.frombuffer(b"ACGT", np.uint8)
#: Bases worked on at a time.
PIECE = 1 << 18

SCHEMA = "sid bigint, idx int, pos int, rev int, kmer string, smer bigint"


def select(seq: str, k: int, s: int) -> list[tuple[int, int, str, int]]:
    """(position, whether the reverse strand is the canonical k-mer, that k-mer, s-mer hash) of a sequence whose runs are already compressed.

    A window with an ambiguous letter is skipped, as is one equal to its own reverse
    complement at an s-mer (it has no hash and can't be smallest). The k-mer counts if its smallest hash stands
    first or last; if both, it is dropped.
    """
    code = _CODE[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
    m = len(code) - s + 1
    if len(code) < k or m < 1:
        return []
    fwd, rev = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
    for i in range(s):
        c = code[i : i + m].astype(np.uint64)
        fwd = (fwd << np.uint64(2)) | (c & np.uint64(3))
        rev |= (np.uint64(3) - (c & np.uint64(3))) << np.uint64(2 * i)
    bad = np.convolve(code > 3, np.ones(s, int))[s - 1 : s - 1 + m] > 0
    top = np.uint64(2**64 - 1)
    h = np.where(bad | (fwd == rev), top, mix_array(np.minimum(fwd, rev), 2 * s))
    q = k - s + 1
    w = sliding_window_view(h, q)
    least = w.min(axis=1)
    clean = np.convolve(code > 3, np.ones(k, int))[k - 1 : k - 1 + len(w)] == 0
    first, last = w[:, 0] == least, w[:, -1] == least
    out = []
    for p in np.flatnonzero(clean & (first ^ last) & (least != top)):
        at = p if first[p] else p + q - 1
        word = seq[p : p + k].upper().replace("U", "T")
        other = word.translate(str.maketrans("ACGT", "TGCA"))[::-1]
        out.append((int(p), int(other < word), min(word, other), int(h[at])))
    return out


def closed_syncmers(reads: DataFrame, k: int, s: int, seq: str = "seq") -> DataFrame:
    """``sid, idx, pos, rev, kmer, smer`` of reads whose runs are compressed already."""
    if not 0 < s < 32 or k <= s:
        raise ValueError("needs 0 < s < 32 and s < k")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(sid, i, p, r, kmer, h) for sid, t in zip(frame["sid"], frame["seq"]) if t for i, (p, r, kmer, h) in enumerate(select(t, k, s))]
            yield pd.DataFrame(rows, columns=["sid", "idx", "pos", "rev", "kmer", "smer"])

    return reads.select(F.col("sid").cast("bigint").alias("sid"), F.col(seq).alias("seq")).mapInPandas(run, SCHEMA)


def closed_syncmers_sql(reads: DataFrame, k: int, s: int, seq: str = "seq") -> DataFrame:
    """``sid, pos, kmer``: the same on whole batches of reads laid end to end, in pieces of bounded size whatever the length of a read."""
    if not 0 < s < 32 or k <= s:
        raise ValueError("needs 0 < s < 32 and s < k")
    base = reads.select("sid", plain_bases(seq).alias("_t")).where(F.length("_t") >= k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One byte a letter: what isn't ASCII is ambiguous anyway.
            text = pc.replace_substring_regex(batch.column(1).cast(pa.large_string()), "[^\\x00-\\x7F]", "N")
            if not len(text):
                continue
            ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            code = _CODE[np.frombuffer(text.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
            ends = ends - ends[0]
            for at in range(0, len(code) - k + 1, PIECE):
                pos, words = _chosen(code[at : at + PIECE + k - 1], k, s)
                row = np.searchsorted(ends, pos + at, "right") - 1
                own = pos + at + k <= ends[row + 1]
                pos, words, row = pos[own] + at, words[own], row[own]
                n = len(pos)
                kmer = pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(0, (n + 1) * k, k, dtype=np.int32)), pa.py_buffer(_LETTERS[words]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array((pos - ends[row]).astype(np.int32)), kmer], names=["sid", "pos", "kmer"])

    return base.mapInArrow(run, f"sid {dict(reads.dtypes)['sid']}, pos int, kmer string")


def _chosen(code: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Where k-mers of ``code`` count as closed syncmers, as if it were one read, and the bases of their smaller strands."""
    m, q = len(code) - s + 1, k - s + 1
    n = m - q + 1
    fwd, rev = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
    for i in range(s):
        c = (code[i : i + m] & 3).astype(np.uint64)
        fwd = (fwd << np.uint64(2)) | c
        rev |= (np.uint64(3) - c) << np.uint64(2 * i)
    other = np.concatenate([[0], np.cumsum(code > 3)])
    top = np.uint64(2**64 - 1)
    h = np.where((other[s:] > other[:-s]) | (fwd == rev), top, mix_array(np.minimum(fwd, rev), 2 * s))
    least, span = h, 1
    while 2 * span <= q:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    least = np.minimum(least[:n], least[q - span : q - span + n])
    pos = np.flatnonzero((other[k:] == other[:-k]) & (least != top) & ((h[:n] == least) ^ (h[q - 1 :] == least)))
    words = code[pos[:, None] + np.arange(k)]
    back = 3 - words[:, ::-1]
    row, at = np.arange(len(pos)), (words != back).argmax(axis=1)
    return pos, np.where((back[row, at] < words[row, at])[:, None], back, words)
