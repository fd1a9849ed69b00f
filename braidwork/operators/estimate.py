"""Coverage of unitigs from alignments by expectation and maximisation, on tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.operators.align import shared_intervals
from braidwork.operators.coverage import fenced_mean
from braidwork.operators.onetask import TASK_ROWS, in_one_task
from braidwork.storage import discard, materialize


def unique_depth(aln: DataFrame, sizes: DataFrame) -> DataFrame:
    """``uid, cov``: fenced mean depth over the places of a unitig, of reads that lie nowhere else; at least 1.

    ``sizes``: uid, n k-mers. Places of a fragment on the reverse strand are mirrored.
    """
    rows = aln.where("n_aln = 1").select(F.shiftright("uid", 1).alias("u"), (F.col("uid") % 2).alias("r"), "u_beg", "u_end")
    rows = rows.join(sizes.select(F.col("uid").alias("u"), "n"), "u")
    beg = F.when(F.col("r") == 1, F.col("n") - 1 - F.col("u_end")).otherwise(F.col("u_beg"))
    end = F.when(F.col("r") == 1, F.col("n") - 1 - F.col("u_beg")).otherwise(F.col("u_end"))
    at = rows.select("u", F.explode(F.sequence(beg, end)).alias("place")).groupBy("u", "place").agg(F.count(F.lit(1)).alias("depth"))
    every = sizes.select(F.col("uid").alias("u"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("place"))
    depth = every.join(at, ["u", "place"], "left").select("u", F.coalesce("depth", F.lit(0)).alias("depth"))
    mean = fenced_mean(depth, "u", "depth")
    return sizes.join(mean.select(F.col("u").alias("uid"), "mean"), "uid", "left").select("uid", F.greatest(F.coalesce("mean", F.lit(0.0)), F.lit(1.0)).alias("cov"))


def expected_coverage(aln: DataFrame, sizes: DataFrame, start: DataFrame, rounds: int = 1000, tolerance: float = 2.220446e-16, task_rows: int = TASK_ROWS) -> DataFrame:
    """``uid, cov``: stretches of reads divided among the unitigs they may lie on, in proportion to coverage.

    Repeats until coverages change by less than ``tolerance`` in total, or ``rounds`` times. Stretches that name the same unitigs are
    one row with the sum of their lengths; up to ``task_rows`` of these are worked on in one task, more on tables.
    """
    same = shared_intervals(aln).groupBy("uids").agg(F.sum(F.col("fin") - F.col("beg") + 1).alias("len"))
    same, _ = materialize(same.withColumn("block", F.monotonically_increasing_id()))
    blocks, n = materialize(same.select("block", "len", F.explode("uids").alias("uid")))
    cov, _ = materialize(start.select("uid", "cov"))
    if n <= task_rows:
        rows = blocks.join(cov, "uid").join(sizes.select("uid", "n"), "uid").orderBy("block", "uid").select("block", "len", "uid", "cov", "n")
        settled = in_one_task(rows, lambda *x: _settled(*x, rounds, tolerance), "uid bigint, _new double")
        out = sizes.select("uid").join(settled, "uid", "left")
        return out.select("uid", F.coalesce("_new", F.lit(1e-9)).alias("cov"))
    last = cov
    for _ in range(rounds):
        rows = blocks.join(cov, "uid")
        total = rows.groupBy("block").agg(F.sum("cov").alias("total"))
        given = rows.join(total, "block").groupBy("uid").agg(F.sum(F.col("len") * F.col("cov") / F.col("total")).alias("mass"))
        new = sizes.join(given, "uid", "left").join(cov.withColumnRenamed("cov", "_old"), "uid")
        new = new.select("uid", (F.coalesce("mass", F.lit(0.0)) / F.col("n")).alias("cov"), "_old")
        new, _ = materialize(new.withColumn("cov", F.greatest("cov", F.lit(1e-9))))
        moved = new.agg(F.sum(F.abs(F.col("cov") - F.col("_old"))).alias("m")).first()["m"] or 0.0
        discard(last)
        cov, last = new.select("uid", "cov"), new
        if moved < tolerance:
            break
    return cov


def _settled(block: np.ndarray, length: np.ndarray, uid: np.ndarray, cov: np.ndarray, n: np.ndarray, rounds: int, tolerance: float) -> dict[str, np.ndarray]:
    """The same steps on arrays, a row for each block and unitig."""
    blocks, at = np.unique(block, return_inverse=True)
    uids, first, to = np.unique(uid, return_index=True, return_inverse=True)
    now, size = cov[first], n[first]
    for _ in range(rounds):
        own = now[to]
        mass = np.bincount(to, length * own / np.bincount(at, own)[at], len(uids))
        new = np.maximum(mass / size, 1e-9)
        moved = np.abs(new - now).sum()
        now = new
        if moved < tolerance:
            break
    return {"uid": uids, "_new": now}


def split_kmer_coverage(members: DataFrame, kmers: DataFrame, cov: DataFrame) -> DataFrame:
    """``uid, cov``: coverage of k-mers divided among the unitigs that hold them in proportion to ``cov``; fenced mean, at least 1."""
    at = members.select("uid", F.shiftright("v", 1).alias("vid")).join(cov, "uid")
    total = at.groupBy("vid").agg(F.sum("cov").alias("total"))
    rows = at.join(total, "vid").join(kmers.select("vid", F.col("cov").alias("k")), "vid")
    own = rows.select("uid", F.floor(F.col("k") * F.col("cov") / F.col("total")).cast("bigint").alias("part"))
    mean = fenced_mean(own, "uid", "part")
    return mean.select("uid", F.greatest("mean", F.lit(1.0)).alias("cov"))


def alignment_coverage(aln: DataFrame, members: DataFrame, kmers: DataFrame) -> DataFrame:
    """``uid, cov`` after all three steps: unique depth, division of shared stretches, division of k-mers."""
    sizes, _ = materialize(members.groupBy("uid").agg(F.count(F.lit(1)).alias("n")))
    first, _ = materialize(unique_depth(aln, sizes))
    return split_kmer_coverage(members, kmers, expected_coverage(aln, sizes, first))
