"""Correction of k-mers along reads by paths through the well-supported part of the graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.functions.sequence import reverse_complement
from braidwork.operators.graph import turned
from braidwork.operators.skew import join_by_key
from braidwork.storage import materialize


@dataclass(frozen=True)
class CorrectionRules:
    """Below ``min_kmer`` a k-mer is an error, from ``max_error`` on it never is; arcs are good from ``min_arc`` and ``arc_part``."""

    min_kmer: int = 3
    max_error: int = 30
    min_arc: int = 3
    arc_part: float = 0.35
    edits: float = 0.02
    min_edits: int = 6
    min_block: int = 10
    max_paths: int = 10_000


def error_kmers(kmers: DataFrame, arcs: DataFrame, rules: CorrectionRules = CorrectionRules()) -> DataFrame:
    """``vid, cov, del``: k-mers seen too rarely, or with arcs on a side of which none is good.

    A k-mer of coverage ``max_error`` or more is never an error. ``arcs`` has both directions with cov.
    """
    c = kmers.select("vid", F.col("cov").alias("c"))
    rows = arcs.withColumns({"_v": F.shiftright("v", 1), "_w": F.shiftright("w", 1)})
    rows = rows.join(c.withColumnsRenamed({"vid": "_v", "c": "_cv"}), "_v").join(c.withColumnsRenamed({"vid": "_w", "c": "_cw"}), "_w")
    good = (F.col("cov") >= rules.min_arc) & (F.col("cov") >= rules.arc_part * F.least("_cv", "_cw"))
    sides = rows.groupBy("v").agg(F.max(good).alias("some"))
    bad = sides.where("not some").select(F.shiftright("v", 1).alias("vid")).distinct().withColumn("_bad", F.lit(True))
    rows = kmers.join(bad, "vid", "left")
    gone = (F.col("cov") < rules.min_kmer) | F.coalesce("_bad", F.lit(False))
    return rows.select("vid", "cov", (gone & (F.col("cov") < rules.max_error)).alias("del"))


def blocks(occ: DataFrame, marked: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """``sid, beg, fin, source, sink, seq``: runs of error k-mers between the good ones beside them.

    ``occ``: sid, idx, pos, v; ``reads``: sid, seq. ``beg`` and ``fin`` are the first and last
    idx replaced. ``seq`` is what lies behind the source's k-mer up to the end of the sink's.
    At the end of a read the sink is null; at its beginning the block is turned round, with
    the good k-mer behind it as source. Reads without a good k-mer have no block.
    """
    along = Window.partitionBy("sid").orderBy("idx")
    own = occ.withColumn("vid", F.shiftright("v", 1))
    sizes, _ = materialize(own.groupBy("vid").agg(F.count(F.lit(1)).alias("_n")).join(marked.select("vid", "del"), "vid"))
    rows = join_by_key(own, sizes, "vid", "_n", sizes.agg(F.sum("_n")).first()[0] or 0)
    rows = rows.withColumn("_start", F.when(F.col("del") != F.lag("del", 1, False).over(along), 1).otherwise(0))
    rows = rows.withColumn("_run", F.sum("_start").over(along))
    edge = {c: F.lag(c).over(along) for c in ("v", "pos")} | {f"{c}2": F.lead(c).over(along) for c in ("v", "pos")}
    rows = rows.select("sid", "idx", "del", "_run", *[F.when(F.lit(True), x).alias(f"_{c}") for c, x in edge.items()])
    runs = rows.where("del").groupBy("sid", "_run").agg(
        F.min("idx").alias("beg"), F.max("idx").alias("fin"), F.min_by("_v", "idx").alias("source"), F.min_by("_pos", "idx").alias("p"),
        F.max_by("_v2", "idx").alias("sink"), F.max_by("_pos2", "idx").alias("q"),
    )
    runs = runs.where("source is not null or sink is not null").join(reads.select("sid", F.col("seq").alias("_s")), "sid")
    head = F.col("source").isNull()
    end = F.coalesce(F.col("q") + k, F.length("_s")).cast("int")
    middle = F.substring("_s", F.col("p").cast("int") + k + 1, end - F.col("p").cast("int") - k)
    front = reverse_complement(F.substring("_s", F.lit(1), F.col("q").cast("int")))
    return runs.select(
        "sid", "beg", "fin", F.when(head, turned("sink")).otherwise(F.col("source")).alias("source"), F.when(~head, F.col("sink")).alias("sink"),
        F.when(head, front).otherwise(middle).alias("seq"), head.alias("turned"),
    )


def corrected(block: DataFrame, arcs: DataFrame, kmers: DataFrame, marked: DataFrame, k: int, rules: CorrectionRules = CorrectionRules()) -> DataFrame:
    """``sid, beg, fin, turned, status, path, edits``: for each block the path through good k-mers that spells it best.

    ``arcs``: v, w, d (distance), ``kmers``: vid, kmer. All blocks walk at once, an arc a round; a
    walk stops when it is longer than the block and its band. ``status``: 'success', 'ambiguous_path' (equally good
    paths spell the same), 'ambiguous_sequence' (they spell different ones), 'failure' (none in the band, or more than ``max_paths``), 'short'
    (below ``min_block`` bases; left alone).
    """
    good = marked.where("not del").select("vid")
    ok = arcs.join(good, F.shiftright("w", 1) == F.col("vid"), "left_semi").join(good, F.shiftright("v", 1) == F.col("vid"), "left_semi")
    spelled = ok.withColumn("vid", F.shiftright("w", 1)).join(kmers.select("vid", "kmer"), "vid")
    word = F.when(F.col("w").bitwiseAND(F.lit(1).cast("bigint")) == 1, reverse_complement("kmer")).otherwise(F.col("kmer"))
    spelled, _ = materialize(spelled.where(F.col("d").between(1, k)).select(F.col("v").alias("at"), F.col("w").alias("to"), F.substr(word, (k - F.col("d") + 1).cast("int")).alias("more")))

    key = ["sid", "beg", "fin"]
    all_, _ = materialize(block.withColumn("l", F.length("seq")).withColumn("band", F.greatest(F.lit(rules.min_edits), F.ceil(rules.edits * F.length("seq"))).cast("int")))
    walk = all_.where(F.col("l") >= rules.min_block).select(*key, "sink", F.col("seq").alias("want"), "l", "band", F.col("source").alias("at"), F.array().cast("array<bigint>").alias("path"), F.lit("").alias("spelt"))
    found, full = [], []
    walk, n = materialize(walk)
    while n:  # every arc adds a base, so walks end with their band
        step = walk.join(spelled, "at").where(F.length("spelt") + F.length("more") <= F.col("l") + F.col("band"))
        step = step.select(*key, "sink", "want", "l", "band", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"), F.concat("spelt", "more").alias("spelt"))
        step, _ = materialize(step)
        there = F.when(F.col("sink").isNotNull(), F.col("at") == F.col("sink")).otherwise(F.length("spelt") >= F.col("l"))
        text = F.when(F.col("sink").isNull(), F.substring("spelt", F.lit(1), F.col("l"))).otherwise(F.col("spelt"))
        ended = step.where(there).withColumn("edits", F.levenshtein(text, F.col("want"))).where("edits <= band")
        found.append(ended.select(*key, "path", text.alias("spelt"), "edits"))
        many = step.groupBy(*key).agg(F.count(F.lit(1)).alias("paths")).where(F.col("paths") > rules.max_paths).select(*key)
        many, m = materialize(many)
        if m:
            full.append(many)
        # Beyond its band a walk can't come back: what it spells must be near some beginning of the block.
        prefix = F.levenshtein("spelt", F.substring("want", F.lit(1), F.length("spelt")))
        go_on = step.where(prefix <= 2 * F.col("band")).join(many, key, "left_anti")
        walk, n = materialize(go_on.where(~there | F.col("sink").isNotNull()))
    base = all_.select(*key, "turned", F.col("l"))
    if not found:
        return base.select(*key, "turned", F.when(F.col("l") < rules.min_block, "short").otherwise("failure").alias("status"), F.lit(None).cast("array<bigint>").alias("path"), F.lit(None).cast("int").alias("edits"))
    hits = found[0]
    for f in found[1:]:
        hits = hits.unionByName(f)
    for f in full:
        hits = hits.join(f, key, "left_anti")
    least = hits.groupBy(*key).agg(F.min("edits").alias("edits"))
    best = hits.join(least, [*key, "edits"]).groupBy(*key, "edits").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n"), F.count_distinct("spelt").alias("texts"))
    status = F.when(F.col("n").isNull(), F.when(F.col("l") < rules.min_block, "short").otherwise("failure"))
    status = status.when(F.col("n") == 1, "success").when(F.col("texts") == 1, "ambiguous_path").otherwise("ambiguous_sequence")
    return base.join(best, key, "left").select(*key, "turned", status.alias("status"), F.when(status == "success", F.col("path")).alias("path"), "edits")


def spliced(occ: DataFrame, fixed: DataFrame) -> DataFrame:
    """Occurrences with the k-mers of corrected blocks in place of those they replace: ``sid, idx, v, pos, ec``.

    Corrected ones have no place of their own. Idx is counted anew along the read.
    """
    good = fixed.where("status = 'success'")
    # Range of one read: a read has few blocks, so the join is on sid with a filter.
    cut = occ.join(good.select("sid", "beg", "fin"), "sid").where("idx between beg and fin").select("sid", "idx")
    kept = occ.join(cut, ["sid", "idx"], "left_anti").select("sid", F.col("idx").cast("double").alias("at"), F.lit(0).alias("sub"), "v", "pos", F.lit(False).alias("ec"))
    # A path between two good k-mers ends with the sink itself, which is there already.
    path = F.when(F.col("turned"), F.transform(F.reverse("path"), lambda x: x.bitwiseXOR(F.lit(1).cast("bigint")))).otherwise(F.col("path"))
    new = good.withColumn("_n", F.when(F.col("sink_in_path"), F.size("path") - 1).otherwise(F.size("path"))) if "sink_in_path" in fixed.columns else good.withColumn("_n", F.size("path"))
    new = new.select("sid", F.col("beg").cast("double").alias("at"), F.posexplode(F.slice(path, F.lit(1), F.col("_n"))).alias("sub", "v"), F.lit(None).cast("bigint").alias("pos"), F.lit(True).alias("ec"))
    rows = kept.withColumn("pos", F.col("pos").cast("bigint")).unionByName(new)
    number = F.row_number().over(Window.partitionBy("sid").orderBy("at", "sub")) - 1
    return rows.select("sid", number.alias("idx"), "v", "pos", "ec")


def recounted(occ: DataFrame, kmers: DataFrame) -> DataFrame:
    """``vid, cov, own, del``: occurrences after correction, those seen by themselves, and k-mers without any of these."""
    counts = occ.groupBy(F.shiftright("v", 1).alias("vid")).agg(F.count(F.lit(1)).alias("cov"), F.count_if(~F.col("ec")).alias("own"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return kmers.select("vid").join(counts, "vid", "left").select("vid", zero("cov"), zero("own"), (F.coalesce("own", F.lit(0)) == 0).alias("del"))


def correction_summary(fixed: DataFrame) -> DataFrame:
    """``status, blocks, kmers, edits``."""
    return fixed.groupBy("status").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.col("fin") - F.col("beg") + 1).alias("kmers"), F.sum("edits").alias("edits"))


def correct_reads(occ: DataFrame, kmers: DataFrame, arcs: DataFrame, reads: DataFrame, k: int, rules: CorrectionRules = CorrectionRules()) -> tuple[DataFrame, DataFrame]:
    """Corrected occurrences, and what became of each block.

    ``kmers``: vid, kmer, cov; ``arcs``: v, w, d, cov in both directions; ``reads``: sid, seq with runs compressed.
    """
    marked, _ = materialize(error_kmers(kmers, arcs, rules))
    todo, _ = materialize(blocks(occ, marked, reads, k))
    fixed, _ = materialize(corrected(todo, arcs, kmers, marked, k, rules).join(todo.select("sid", "beg", "fin", F.col("sink").isNotNull().alias("sink_in_path")), ["sid", "beg", "fin"]))
    return materialize(spliced(occ, fixed))[0], fixed
