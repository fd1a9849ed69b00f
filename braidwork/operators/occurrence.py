"""Operators on occurrences of k-mers along reads.

An occurrence table has ``sid, idx, rev, kid``: read, place on the read, strand and k-mer.
An oriented k-mer is the pair (kid, rev), compared as such, so that identifiers of any sign
and size keep their full width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(occ: DataFrame, distance: int = 1) -> DataFrame:
    """Pairs of occurrences ``distance`` places apart on a read: the row, and ``kid2, rev2, idx2``.

    A window of one read, no join: a read's records are bounded by its length.
    """
    along = Window.partitionBy("sid").orderBy("idx", "kid", "rev")
    ahead = lambda c: F.lead(c, distance).over(along).alias(f"{c}2")
    return occ.select("sid", "idx", "kid", "rev", ahead("kid"), ahead("rev"), ahead("idx")).where("kid2 is not null")


def canonical_pair(kid1: Column, rev1: Column, kid2: Column, rev2: Column) -> list[Column]:
    """An arc and its twin under one form: the smaller of (v, w) and (w turned, v turned)."""
    here = F.struct(kid1.alias("va"), rev1.alias("vr"), kid2.alias("wa"), rev2.alias("wr"))
    twin = F.struct(kid2.alias("va"), (1 - rev2).alias("vr"), kid1.alias("wa"), (1 - rev1).alias("wr"))
    least = F.least(here, twin)
    return [least[c].alias(c) for c in ("va", "vr", "wa", "wr")]


def arc_coverage(occ: DataFrame) -> DataFrame:
    """``va, vr, wa, wr, cov``: how often each canonical arc is walked by reads."""
    pair = canonical_pair(*(F.col(c) for c in ("kid", "rev", "kid2", "rev2")))
    return neighbours(occ).select(*pair).groupBy("va", "vr", "wa", "wr").agg(F.count(F.lit(1)).alias("cov"))


def refresh_coverage(arcs: DataFrame, occ: DataFrame) -> DataFrame:
    """Coverage of arcs that exist already, in both directions; arcs that no read walks have 0."""
    pair = canonical_pair(*(F.col(c) for c in ("va", "vr", "wa", "wr")))
    keyed = arcs.select("va", "vr", "wa", "wr", F.struct(*pair).alias("key"))
    counted = arc_coverage(occ).select(F.struct("va", "vr", "wa", "wr").alias("key"), "cov")
    return keyed.join(counted, "key", "left").select("va", "vr", "wa", "wr", F.coalesce("cov", F.lit(0)).alias("cov"))


def kmer_table(occ: DataFrame) -> DataFrame:
    """``kid, cov, smer, consistent``: number of occurrences, and whether all agree on the s-mer."""
    return occ.groupBy("kid").agg(
        F.count(F.lit(1)).alias("cov"), F.min("smer").alias("smer"),
        F.coalesce(F.min("smer") == F.max("smer"), F.lit(True)).alias("consistent"),
    )


def kept_kmers(kmers: DataFrame, min_cov: int, column: str = "cov") -> DataFrame:
    """All k-mers with ``del`` true where coverage is below ``min_cov`` or it was so before."""
    before = F.col("del") if "del" in kmers.columns else F.lit(False)
    return kmers.withColumn("del", before | (F.col(column) < min_cov))


def supported_arcs(arcs: DataFrame, kmers: DataFrame, min_fraction: float) -> DataFrame:
    """Arcs between kept k-mers with at least ``min_fraction`` of the smaller end's coverage."""
    ends = kmers.where("not del").select("kid", F.col("cov").alias("kcov"))
    v = ends.select(F.col("kid").alias("va"), F.col("kcov").alias("vcov"))
    w = ends.select(F.col("kid").alias("wa"), F.col("kcov").alias("wcov"))
    both = arcs.join(v, "va").join(w, "wa")
    return both.where(F.col("cov") >= min_fraction * F.least("vcov", "wcov")).select(*arcs.columns)


def kmer_graph(occ: DataFrame, min_cov: int, min_fraction: float) -> tuple[DataFrame, DataFrame]:
    """Vertices (kept k-mers) and arcs with their twins; a self-complementary arc has none."""
    kmers = kept_kmers(kmer_table(occ), min_cov)
    arcs = supported_arcs(arc_coverage(occ), kmers, min_fraction).withColumn("comp", F.lit(False))
    twin = arcs.select(
        F.col("wa").alias("va"), (1 - F.col("wr")).alias("vr"), F.col("va").alias("wa"), (1 - F.col("vr")).alias("wr"),
        "cov", F.lit(True).alias("comp"),
    ).where("not (va = wa and vr <> wr)")
    return kmers.where("not del"), arcs.unionByName(twin)


def count_of_counts(df: DataFrame, key: str, top: int = 1000) -> DataFrame:
    """``mult, n``: how many keys occur how often; more than ``top`` counts as ``top``."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy(F.least("c", F.lit(top)).cast("bigint").alias("mult")).agg(F.count(F.lit(1)).alias("n"))


def histogram_bars(hist: DataFrame, stars: int = 100) -> DataFrame:
    """The histogram with bars of up to ``stars`` stars for its largest count, and a mark beyond it."""
    peak = hist.agg(F.max("n").alias("n"))
    width = F.floor(F.col("n") * stars / peak.scalar()).cast("int")
    return hist.withColumn("bar", F.repeat(F.lit("*"), width))


def occurrence_stats(occ: DataFrame, kmers: DataFrame) -> DataFrame:
    """One row: reads, occurrences, k-mers, singletons, means, and the spacing of neighbours."""
    per_read = occ.groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
    reads = per_read.agg(F.count(F.lit(1)).alias("reads"), F.sum("n").alias("occurrences"), F.max("n").alias("most_on_read"))
    kinds = kmers.agg(
        F.count(F.lit(1)).alias("kmers"), F.count_if(F.col("cov") == 1).alias("singletons"), F.avg("cov").alias("mean_cov"),
    )
    gaps = neighbours(occ).agg(F.avg(F.col("idx2") - F.col("idx")).alias("mean_step"))
    one = F.lit(1).alias("one")
    rows = [x.select("*", one) for x in (reads, kinds, gaps)]
    return rows[0].join(rows[1], "one").join(rows[2], "one").drop("one")


def coverage_peaks(hist: list[tuple[int, int]], start: int = 2) -> tuple[int | None, int | None]:
    """Heterozygous and homozygous peak of a count-of-counts histogram of at most 1001 rows.

    From the low point behind the errors on the left, the highest place is the main peak. A
    side peak on its left of at least 5 % of its height, with a valley of at most 95 % of the
    side peak between them, is the heterozygous one; one on its right no farther than 2.5
    times makes the main peak heterozygous instead.
    """
    counts = dict(hist)
    if not counts:
        return None, None
    top = max(counts)
    at = lambda i: counts.get(i, 0)
    low = start
    while low < top and at(low + 1) <= at(low):
        low += 1
    if low >= top:
        return None, None
    main = max(range(low, top + 1), key=lambda i: (at(i), -i))
    if not at(main):
        return None, None

    def side(places: range, towards: range) -> int | None:
        best = None
        for i in places:
            if at(i) >= 0.05 * at(main) and at(i) >= at(i - 1) and at(i) >= at(i + 1):
                between = [at(j) for j in range(min(i, main) + 1, max(i, main))]
                if between and min(between) <= 0.95 * at(i) and (best is None or at(i) > at(best)):
                    best = i
        return best

    left = side(range(low + 1, main - 1), range(0))
    if left is not None:
        return left, main
    right = side(range(main + 2, min(top, int(2.5 * main)) + 1), range(0))
    return (main, right) if right is not None else (None, main)


def automatic_cutoff(het: int | None, hom: int | None) -> int:
    """Ten times the heterozygous peak, or the homozygous one."""
    return 10 * (het or hom or 0)


def spacing_regression(occ: DataFrame, kmers: DataFrame, gaps: list[int]) -> DataFrame:
    """For each gap: slope through the origin of link counts on the smaller k-mer coverage, error and R².

    Of each gap's links the middle 90 % by ratio count.
    """
    kc = kmers.select("kid", F.col("cov").alias("kcov"))
    out = None
    for d in gaps:
        pair = canonical_pair(*(F.col(c) for c in ("kid", "rev", "kid2", "rev2")))
        links = neighbours(occ, d).select(*pair).groupBy("va", "vr", "wa", "wr").agg(F.count(F.lit(1)).alias("y"))
        links = links.join(kc.withColumnsRenamed({"kid": "va", "kcov": "c1"}), "va").join(kc.withColumnsRenamed({"kid": "wa", "kcov": "c2"}), "wa")
        links = links.select(F.least("c1", "c2").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
        edge = links.agg(F.percentile(F.col("y") / F.col("x"), F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
        kept = links.join(F.broadcast(edge), F.expr("y / x >= q[0] and y / x <= q[1]"))  # one row
        s = kept.agg(
            F.count(F.lit(1)).alias("links"), F.sum(F.col("x") * F.col("y")).alias("xy"),
            F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"),
        )
        slope = F.col("xy") / F.nullif("xx", F.lit(0.0))
        rest = F.col("yy") - slope * F.col("xy")
        s = s.select(
            F.lit(d).alias("gap"), "links", slope.alias("slope"),
            F.sqrt(F.greatest(rest, F.lit(0.0)) / F.nullif(F.col("links") - 1, F.lit(0)) / F.col("xx")).alias("error"),
            (1 - rest / F.nullif("yy", F.lit(0.0))).alias("r2"),
        )
        out = s if out is None else out.unionByName(s)
    return out


def within_limits(occ: DataFrame, reads: DataFrame) -> DataFrame:
    """One row: the greatest read number and records of a read, and whether ids fit 32 and 31 bits."""
    a = reads.agg(F.max("sid").alias("top_sid")).withColumn("one", F.lit(1))
    b = occ.groupBy("sid").count().agg(F.max("count").alias("most")).withColumn("one", F.lit(1))
    ok = (F.coalesce("top_sid", F.lit(0)) < 2**32 - 1) & (F.coalesce("most", F.lit(0)) <= 2**31 - 1)
    return a.join(b, "one").select("top_sid", "most", ok.alias("ok"))


def reads_at_least(occ: DataFrame) -> DataFrame:
    """``n, reads``: how many reads have ``n`` occurrences or more, for every n from 1 to the most that a read has.

    Reads are counted by their occurrences first; the running sum from the far end is over these counts, which the
    longest read bounds.
    """
    sizes = occ.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    every = sizes.agg(F.max("n").alias("m")).where("m is not null").select(F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m"))).alias("n"))
    own = F.coalesce("c", F.lit(0)).cast("bigint")
    return every.join(sizes, "n", "left").select("n", F.sum(own).over(Window.orderBy(F.desc("n"))).alias("reads"))
