"""Scalar functions on nucleotide sequences, as column expressions.

All take and return columns and stay inside generated code or higher-order functions; null
gives null and the empty sequence an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nucleotides with ambiguity letters, and their complements.
BASES = "ACGTUNRYSWKMBDHV"
COMPLEMENTS = "TGCAANYRSWMKVHDB"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def plain_bases(seq: str | Column) -> Column:
    """Upper case, with U as T."""
    return F.translate(F.upper(_c(seq)), "U", "T")


def encode_bases(seq: str | Column) -> Column:
    """A C G T/U as 0 1 2 3 in either case; every other letter as 4."""
    return F.regexp_replace(F.translate(plain_bases(seq), "ACGT", "0123"), "[^0123]", "4")


def reverse_complement(seq: str | Column, keep_case: bool = False) -> Column:
    """The other strand read forward. Without ``keep_case`` lower-case letters come out in upper case."""
    if keep_case:
        return F.reverse(F.translate(_c(seq), BASES + BASES.lower(), COMPLEMENTS + COMPLEMENTS.lower()))
    return F.reverse(F.translate(F.upper(_c(seq)), BASES, COMPLEMENTS))


def run_list(seq: str | Column) -> Column:
    """The runs of one base as strings; an ambiguous letter is a run of its own."""
    return F.regexp_extract_all(plain_bases(seq), F.lit("A+|C+|G+|T+|[^ACGT]"), F.lit(0))


def compress_runs(seq: str | Column) -> Column:
    """One base for each run; ambiguous letters as A."""
    heads = F.transform(run_list(seq), lambda r: F.substring(r, 1, 1))
    return F.regexp_replace(F.array_join(heads, ""), "[^ACGT]", "A")


def run_lengths(seq: str | Column) -> Column:
    """Lengths of the runs of :func:`compress_runs`."""
    return F.transform(run_list(seq), F.length)


def expand_runs(bases: str | Column, lengths: str | Column) -> Column:
    """Every base as often as its run was long."""
    return F.array_join(F.zip_with(F.split(_c(bases), ""), _c(lengths), lambda b, n: F.repeat(b, n)), "")


def windows(seq: str | Column, k: int) -> Column:
    """All substrings of length ``k`` in order."""
    seq = _c(seq)
    n = F.length(seq) - (k - 1)
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(seq, i, F.lit(k)))
    )


def base_code(word: Column) -> Column:
    """The number whose base-4 digits are the bases of ``word`` (31 bases at most)."""
    return F.conv(F.translate(word, "ACGT", "0123"), 4, 10).cast("bigint")


def small_words(seq: str | Column, s: int) -> Column:
    """Of every window of ``s`` < 32 bases: code of its smaller strand, and whether that is the reverse one.

    Null for windows with a letter other than A C G T, and for those equal to their own reverse complement.
    """
    if not 0 < s < 32:
        raise ValueError("s must be between 1 and 31")

    def of(word: Column) -> Column:
        other = F.reverse(F.translate(word, "ACGT", "TGCA"))
        return F.when(
            word.rlike("^[ACGT]+$") & (word != other),
            F.struct(base_code(F.least(word, other)).alias("code"), (other < word).alias("rev")),
        )

    return F.transform(windows(seq, s), of)


def mix_bits(key: Column, bits: int) -> Column:
    """An invertible mix of ``bits`` <= 30 bits (the well-known 64-bit integer mix by T. Wang, masked)."""
    if bits > 30:
        raise ValueError("beyond 30 bits use mix_array, where sums wrap")
    mask = (1 << bits) - 1
    left, right = F.shiftleft, F.shiftrightunsigned
    k = (F.bitwise_not(key) + left(key, 21)).bitwiseAND(F.lit(mask))
    k = k.bitwiseXOR(right(k, 24))
    k = (k + left(k, 3) + left(k, 8)).bitwiseAND(F.lit(mask))
    k = k.bitwiseXOR(right(k, 14))
    k = (k + left(k, 2) + left(k, 4)).bitwiseAND(F.lit(mask))
    k = k.bitwiseXOR(right(k, 28))
    return (k + left(k, 31)).bitwiseAND(F.lit(mask))


def mix_array(key: np.ndarray, bits: int) -> np.ndarray:
    """The same mix for arrays of up to 64 bits."""
    mask = np.uint64((1 << bits) - 1)
    k = key.astype(np.uint64)
    s = lambda n: np.uint64(n)
    with np.errstate(over="ignore"):
        k = (~k + (k << s(21))) & mask
        k ^= k >> s(24)
        k = (k + (k << s(3)) + (k << s(8))) & mask
        k ^= k >> s(14)
        k = (k + (k << s(2)) + (k << s(4))) & mask
        k ^= k >> s(28)
        return (k + (k << s(31))) & mask


def word_at(seq: str | Column, pos: str | Column, k: int, rev: str | Column) -> Column:
    """The ``k`` bases at 0-based ``pos``, reverse-complemented where ``rev`` is not 0."""
    word = F.substring(_c(seq), _c(pos).cast("int") + 1, F.lit(k))
    return F.when(_c(rev).cast("int") != 0, reverse_complement(word)).otherwise(word)


def canonical_word(word: str | Column) -> Column:
    """The smaller of a word and its reverse complement: the identity of a k-mer."""
    return F.least(_c(word), reverse_complement(word))


def content_hash(word: str | Column) -> Column:
    """A 64-bit key of a k-mer that both strands share; only for spreading rows, never for order."""
    return F.xxhash64(canonical_word(word))


def path_steps(path: str | Column) -> Column:
    """``u1+,u2-`` as an array of (name, rev); an entry without a sign has null ``rev``."""
    entry = F.trim
    return F.transform(
        F.filter(F.split(_c(path), ","), lambda x: F.trim(x) != ""),
        lambda x: F.struct(
            F.regexp_replace(entry(x), "[+-]$", "").alias("name"),
            F.when(entry(x).endswith("+"), 0).when(entry(x).endswith("-"), 1).alias("rev"),
        ),
    )


def rotate_left(a: str | Column, d: int | Column) -> Column:
    """The array begun at place ``d`` (from 0), its head put behind."""
    a, d = _c(a), F.lit(d) if isinstance(d, int) else d
    d = F.when(F.size(a) > 0, F.pmod(d, F.size(a))).otherwise(0).cast("int")
    return F.concat(F.slice(a, d + 1, F.greatest(F.size(a) - d, F.lit(0))), F.slice(a, F.lit(1), d))


def reverse_path(a: str | Column) -> Column:
    """An oriented path walked from its other end."""
    return F.transform(F.reverse(_c(a)), lambda v: v.bitwiseXOR(F.lit(1).cast("bigint")))


def rotate_sequence(seq: str | Column, pos: str | Column, rev: str | Column) -> Column:
    """A circular sequence begun at 1-based ``pos``; on the reverse strand, from there backwards.

    Null where ``pos`` lies outside the sequence.
    """
    seq, pos = _c(seq), _c(pos).cast("int")
    forward = F.concat(F.substring(seq, pos, F.length(seq)), F.substring(seq, F.lit(1), pos - 1))
    back = F.concat(
        reverse_complement(F.substring(seq, F.lit(1), pos)), reverse_complement(F.substring(seq, pos + 1, F.length(seq)))
    )
    ok = (pos >= 1) & (pos <= F.length(seq))
    return F.when(ok, F.when(_c(rev).cast("boolean"), back).otherwise(forward))


def is_transfer_rna(gene: str | Column) -> Column:
    return _c(gene).startswith("trn")


def is_ribosomal_rna(gene: str | Column) -> Column:
    return _c(gene).startswith("rrn")


def wrap(seq: str | Column, width: int = 60) -> Column:
    """Lines of ``width`` letters; 0 leaves one line."""
    if not width:
        return _c(seq)
    return F.regexp_replace(F.regexp_replace(_c(seq), f"(.{{{width}}})", "$1\n"), "\n$", "")
