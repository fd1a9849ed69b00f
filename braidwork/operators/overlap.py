"""Distances between neighbouring k-mers, and consensus sequences of k-mers and unitigs.

Occurrences here have ``sid, idx, pos, rev, kid`` and optionally ``ec``, true where a
k-mer was put there by correction and has no place of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.functions.sequence import expand_runs, reverse_complement
from braidwork.operators.occurrence import canonical_pair


def seen(occ: DataFrame) -> DataFrame:
    """Occurrences with a place of their own."""
    return occ.where("not coalesce(ec, false)") if "ec" in occ.columns else occ


def pair_distances(occ: DataFrame, place: str = "pos") -> DataFrame:
    """``va, vr, wa, wr, d, n``: how often two k-mers are next to each other on a read at each distance.

    Neighbours are those in the whole read; pairs with a corrected one don't count.
    """
    along = Window.partitionBy("sid").orderBy("idx")
    mark = F.coalesce("ec", F.lit(False)) if "ec" in occ.columns else F.lit(False)
    rows = occ.withColumn("_ec", mark)
    ahead = lambda c: F.lead(c).over(along)
    rows = rows.select("kid", "rev", "_ec", ahead("kid").alias("kid2"), ahead("rev").alias("rev2"), ahead("_ec").alias("_ec2"), (ahead(place) - F.col(place)).alias("d"))
    rows = rows.where("kid2 is not null and d is not null and not _ec and not _ec2")
    pair = canonical_pair(*(F.col(c) for c in ("kid", "rev", "kid2", "rev2")))
    return rows.select(*pair, F.col("d").cast("bigint").alias("d")).groupBy("va", "vr", "wa", "wr", "d").agg(F.count(F.lit(1)).alias("n"))


def modal_distances(distances: DataFrame) -> DataFrame:
    """``va, vr, wa, wr, d, n, second, total``: the most frequent distance (the smaller, if equal) and the count of the next."""
    key = ["va", "vr", "wa", "wr"]
    entry = F.struct((-F.col("n")).alias("m"), "d")
    # As many entries as distances, which reads bound.
    best = distances.groupBy(*key).agg(F.slice(F.sort_array(F.collect_list(entry)), 1, 2).alias("b"), F.sum("n").alias("total"))
    return best.select(*key, F.col("b")[0]["d"].alias("d"), (-F.col("b")[0]["m"]).alias("n"), F.coalesce(-F.get("b", F.lit(1))["m"], F.lit(0)).alias("second"), "total")


def run_consensus(occ: DataFrame, runs: DataFrame, kmers: DataFrame, k: int) -> DataFrame:
    """``kid, kmer, lengths``: mean run length at each place of a k-mer, rounded, over its seen occurrences.

    ``runs``: sid, lengths of all runs of the read. ``kmers``: kid, kmer. A k-mer without a seen
    occurrence has null lengths. Sums are combined before the shuffle, so frequent k-mers don't weigh on one task.
    """
    at = seen(occ).join(runs, "sid").select("kid", "rev", F.slice("lengths", F.col("pos").cast("int") + 1, k).alias("r")).where(F.size("r") == k)
    each = at.select("kid", F.posexplode(F.when(F.col("rev") == 1, F.reverse("r")).otherwise(F.col("r"))).alias("i", "n"))
    mean = each.groupBy("kid", "i").agg(F.round(F.avg("n")).cast("int").alias("n"))
    whole = mean.groupBy("kid").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "n"))), lambda x: x["n"]).alias("lengths"))
    return kmers.select("kid", "kmer").join(whole, "kid", "left")


def consensus_sequence(consensus: DataFrame) -> DataFrame:
    """``kid, seq``: k-mers with their runs, or as many unknown bases where nothing was seen."""
    seq = F.when(F.col("lengths").isNull(), F.repeat(F.lit("N"), F.length("kmer"))).otherwise(expand_runs("kmer", "lengths"))
    return consensus.select("kid", seq.alias("seq"))


def unitig_sequences(members: DataFrame, kmers: DataFrame, arcs: DataFrame, k: int) -> DataFrame:
    """``uid, seq``: the k-mers of unitigs laid over each other at their modal distances.

    ``members``: uid, pos, v; ``kmers``: vid, kmer and optionally ``lengths`` of its runs;
    ``arcs``: v, w, d. Of each k-mer only what lies beyond the sequence so far is added;
    beyond a distance of k the free bases are N. A missing distance counts as k.
    """
    along = Window.partitionBy("uid").orderBy("pos")
    rows = members.select("uid", "pos", "v").withColumn("_p", F.lag("v").over(along))
    rows = rows.join(arcs.select(F.col("v").alias("_p"), F.col("w").alias("v"), "d"), ["_p", "v"], "left")
    rows = rows.withColumn("vid", F.shiftright("v", 1)).join(kmers, "vid")
    back = F.col("v").bitwiseAND(F.lit(1).cast("bigint")) == 1
    new = F.when(F.col("_p").isNull(), k).otherwise(F.coalesce("d", F.lit(k))).cast("int")
    skip = F.greatest(k - new, F.lit(0))
    base = F.substr(F.when(back, reverse_complement("kmer")).otherwise(F.col("kmer")), skip + 1)
    if "lengths" in kmers.columns:
        own = F.when(back, F.reverse("lengths")).otherwise(F.col("lengths"))
        base = F.when(F.col("lengths").isNull(), F.repeat(F.lit("N"), F.length(base))).otherwise(expand_runs(base, F.slice(own, skip + 1, F.greatest(F.lit(k) - skip, F.lit(0)))))
    piece = F.concat(F.repeat(F.lit("N"), F.greatest(new - k, F.lit(0))), base)
    parts = rows.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("pos", piece.alias("s")))).alias("p"))
    return parts.select("uid", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("seq"))


def link_overlaps(links: DataFrame, sizes: DataFrame, kmers: DataFrame, k: int) -> DataFrame:
    """Links with ``ls``, the bases that both ends share, no more than either is long (``sizes``: v, len).

    ``links``: v, w, b (the first k-mer of w, oriented), d (distance of the k-mers at the
    junction; a missing one counts as k). The ``k - d`` shared places of the k-mer are as
    long as its runs are (``kmers``: vid, lengths).
    """
    end = sizes.select("v", F.col("len").alias("_lv"))
    rows = links.join(end, "v").join(end.withColumnsRenamed({"v": "w", "_lv": "_lw"}), "w")
    rows = rows.join(kmers.select(F.col("vid").alias("_vid"), "lengths"), F.shiftright("b", 1) == F.col("_vid"), "left")
    shared = F.greatest(k - F.coalesce("d", F.lit(k)), F.lit(0)).cast("int")
    own = F.when(F.col("b").bitwiseAND(F.lit(1).cast("bigint")) == 1, F.reverse("lengths")).otherwise(F.col("lengths"))
    bases = F.aggregate(F.slice(own, F.lit(1), shared), F.lit(0).cast("bigint"), lambda t, n: t + n)
    ls = F.least(F.coalesce(bases, shared), "_lv", "_lw")
    return rows.withColumn("ls", ls.cast("bigint")).drop("_lv", "_lw", "_vid", "lengths")
