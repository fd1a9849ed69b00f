"""Paths over oriented segments: places, sequences, metrics and order.

A path is rows ``path_id, pos, v``. Overlaps come from arcs ``v, w, ls``; a negative one is
that many unknown bases, and where two successive segments have no arc, GAP unknown bases stand between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.functions.sequence import reverse_complement, wrap

GAP = 100


def _joined(steps: DataFrame, vertices: DataFrame, arcs: DataFrame, circular: bool) -> DataFrame:
    """Steps with ``vid, name, slen, rev`` and ``ls``, the overlap with the step before (null where there is no arc).

    With ``circular`` the first step's is that with the last.
    """
    along = Window.partitionBy("path_id").orderBy("pos")
    before = F.lag("v").over(along)
    rows = steps.select("path_id", "pos", "v")
    if circular:
        # One value a path: its last step, which the first one follows.
        last = rows.groupBy("path_id").agg(F.max_by("v", "pos").alias("_last"))
        rows = rows.join(last, "path_id")
        before = F.coalesce(before, "_last")
    rows = rows.withColumn("_before", before)
    overlap = arcs.groupBy(F.col("v").alias("_before"), F.col("w").alias("v")).agg(F.max("ls").alias("ls"))
    rows = rows.join(overlap, ["_before", "v"], "left")
    named = vertices.select("vid", F.col("name").alias("sname"), F.col("len").alias("slen"), "cov")
    rows = rows.withColumn("vid", F.shiftright("v", 1)).join(named, "vid", "left")
    return rows.withColumn("rev", F.col("v").bitwiseAND(F.lit(1).cast("bigint")).cast("int"))


def placed_steps(steps: DataFrame, vertices: DataFrame, arcs: DataFrame, circular: bool = False, gap: int = GAP) -> DataFrame:
    """``path_id, pos, v, sname, slen, rev, trim, offset``: what a step cuts off its segment, and where it begins.

    A window of one path, as long as the path itself.
    """
    rows = _joined(steps, vertices, arcs, circular)
    first = F.col("_before").isNull()
    rows = rows.withColumn("trim", F.when(first, 0).otherwise(F.greatest(F.least(F.coalesce("ls", F.lit(0)), "slen"), F.lit(0))))
    lead = F.when(first, 0).when(F.col("ls").isNull(), gap).otherwise(F.greatest(-F.col("ls"), F.lit(0)))
    own = F.coalesce("slen", F.lit(0)) - F.coalesce("trim", F.lit(0)) + lead
    upto = F.sum(own).over(Window.partitionBy("path_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("offset", upto - F.coalesce("slen", F.lit(0)) + F.coalesce("trim", F.lit(0)))
    return rows.select("path_id", "pos", "v", "sname", "slen", "rev", "trim", "offset")


def path_sequences(steps: DataFrame, vertices: DataFrame, arcs: DataFrame, circular: bool = False, gap: int = GAP) -> DataFrame:
    """``path_id, seq, len``: segments without their overlaps, unknown bases where an arc or a sequence is missing."""
    rows = placed_steps(steps, vertices, arcs, circular, gap).withColumn("vid", F.shiftright("v", 1)).join(vertices.select("vid", "seq"), "vid", "left")
    known = F.coalesce("seq", F.repeat(F.lit("N"), F.coalesce("slen", F.lit(0)).cast("int")))
    strand = F.when(F.col("rev") == 1, reverse_complement(known)).otherwise(known)
    piece = F.substr(strand, F.col("trim").cast("int") + 1)
    upto = F.lag(F.col("offset") + F.col("slen") - F.col("trim"), 1, 0).over(Window.partitionBy("path_id").orderBy("pos"))
    rows = rows.withColumn("_gap", F.greatest(F.col("offset") - upto, F.lit(0)).cast("int"))
    piece = F.concat(F.repeat(F.lit("N"), F.col("_gap")), piece)
    parts = rows.select("path_id", F.struct("pos", piece.alias("s")).alias("p")).groupBy("path_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    seq = F.array_join(F.transform("p", lambda x: x["s"]), "")
    return parts.select("path_id", seq.alias("seq")).withColumn("len", F.length("seq").cast("bigint"))


def path_metrics(steps: DataFrame, vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    """``path_id, nv, len, wlen, circ``: steps, bases without overlaps, the same weighted by coverage, and whether an arc closes it."""
    rows = _joined(steps, vertices, arcs, True)
    head = F.min_by("ls", "pos")
    own = F.coalesce("slen", F.lit(0)) - F.coalesce("ls", F.lit(0))
    m = rows.groupBy("path_id").agg(
        F.count(F.lit(1)).alias("nv"), F.sum(own).alias("len"), F.sum(own * F.coalesce("cov", F.lit(0)).cast("double")).alias("wlen"),
        head.alias("_close"), F.min_by("cov", "pos").alias("_cov"),
    )
    circ = F.col("_close").isNotNull()
    # A path that isn't closed keeps the whole of its first segment; no overlap was taken off it.
    return m.select("path_id", "nv", "len", "wlen", circ.alias("circ"))


def path_order(metrics: DataFrame, steps: DataFrame) -> DataFrame:
    """Paths with ``rank``: by weighted length, length, circles first, fewer steps last; equal ones by their vertices.

    ``best`` marks the best circle, and the best linear path if it beats that circle.
    """
    walk = steps.groupBy("path_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("walk"))
    rows = metrics.join(walk, "path_id")
    keys = [F.desc("wlen"), F.desc("len"), F.desc("circ"), F.desc("nv"), "walk", "path_id"]
    ranked = rows.withColumn("_o", F.struct(-F.col("wlen"), -F.col("len"), ~F.col("circ"), -F.col("nv"), "walk", "path_id"))
    first = ranked.groupBy("circ").agg(F.min("_o").alias("_first"))
    top = ranked.agg(F.min("_o").alias("_top"))
    ranked = ranked.join(F.broadcast(first), "circ")  # two rows
    best = (F.col("_o") == F.col("_first")) & (F.col("circ") | (F.col("_o") == top.scalar()))
    return ranked.withColumn("best", best).orderBy(*keys).drop("_o", "_first")


def order_correlation(marks: DataFrame) -> DataFrame:
    """``path_id, n, rho``: Spearman's correlation of places on a path with ranks, both counted without gaps; 0 for a single mark.

    ``marks``: path_id, pos, rank, each once on a path. Windows of one path.
    """
    along = lambda c: F.row_number().over(Window.partitionBy("path_id").orderBy(c)).cast("bigint")
    rows = marks.withColumn("_d", along("pos") - along("rank"))
    got = rows.groupBy("path_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_d") * F.col("_d")).alias("_s"))
    rho = 1 - 6 * F.col("_s") / F.nullif(F.col("n") * (F.col("n") * F.col("n") - 1), F.lit(0))
    return got.select("path_id", "n", F.coalesce(rho, F.lit(0.0)).alias("rho"))


def fasta_lines(paths: DataFrame, width: int = 60) -> DataFrame:
    """One text a path, ready to be written: header with number, form and metrics, and the wrapped sequence.

    ``paths``: number, circ, len, wlen, nv, walk (names), seq.
    """
    header = F.format_string(
        ">ctg%06d%s length=%d wlength=%.3f nv=%d circular=%s path=%s",
        F.col("number"), F.when(F.col("circ"), "c").otherwise("l"), F.col("len"), F.col("wlen"), F.col("nv"), F.col("circ").cast("string"), F.col("walk"),
    )
    return paths.select(F.concat_ws("\n", header, wrap("seq", width)).alias("value"))
