"""Scored annotation hits on segments: filters, scores, classes, and their places on paths.

Hits have ``hit_id, gname, sname, alifrom, alito, strand, evalue, score, og_type``. Types
are 0 unclassified, 1 mitochondrial, 2 plastid, 3 minicircle.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.functions.sequence import is_ribosomal_rna, is_transfer_rna

UNCLASSIFIED, MITO, PLTD, MINI = range(4)
TYPES = 4
#: Orders of hits by name: the columns, each followed by hit_id.
ORDERS = {
    "none": ["hit_id"],
    "gene": ["gname"],
    "segment": ["sname"],
    "gene_score": ["gname", "-score"],
    "segment_type": ["sname", "og_type", "gname", "-score"],
    "segment_place": ["sname", "alifrom", "alito"],
    "score": ["-score"],
}


#: The core genes of a plastid in their usual order.
PLASTID_ORDER = [
    "psbA", "matK", "rps16", "psbK", "psbI", "atpA", "atpF", "atpH", "atpI", "rps2",
    "rpoC2", "rpoC1", "rpoB", "ycf6", "psbM", "psbD", "psbC", "ycf9", "rps14", "psaB",
    "psaA", "ycf3", "rps4", "ndhJ", "psbG", "ndhC", "atpE", "atpB", "rbcL", "accD",
    "psaI", "ycf4", "cemA", "petA", "psbJ", "psbL", "psbF", "psbE", "ORF31", "petG",
    "psaJ", "rpl33", "rps18", "rpl20", "clpP", "psbB", "psbT", "psbN", "psbH", "petB",
    "petD", "rpoA", "rps11", "rpl36", "rps8", "rpl14", "rpl16", "rps3", "rpl22", "rps19",
    "ndhF", "rpl32", "ycf5", "ndhD", "psaC", "ndhE", "ndhG", "ndhI", "ndhA", "ndhH",
    "rps15",
]


@dataclass(frozen=True)
class ClassRules:
    """Thresholds of the classification; defaults are the usual ones for plant organelles."""

    max_evalue: float = 1e-6
    transfer_rna: bool = False
    ribosomal_rna: bool = False
    core_genes: int = 0  # 0: all
    min_score: float = 300.0
    min_len: int = 10_000
    min_plastid: int = 80_000
    max_plastid: int = 250_000
    folds: tuple[float, float] = (3.0, 5.0)
    own_gene: float = 0.8


def considered(hits: DataFrame, rules: ClassRules = ClassRules()) -> DataFrame:
    """Hits up to the largest E-value, without RNA genes unless asked for. A null E-value isn't considered."""
    kept = hits.where(F.col("evalue") <= rules.max_evalue)
    if not rules.transfer_rna:
        kept = kept.where(~is_transfer_rna("gname"))
    if not rules.ribosomal_rna:
        kept = kept.where(~is_ribosomal_rna("gname"))
    return kept


def ordered(hits: DataFrame, order: str) -> DataFrame:
    """Hits in one of ORDERS, nulls last; hit_id decides ties."""
    keys = [F.col(c[1:]).desc_nulls_last() if c[0] == "-" else F.col(c).asc_nulls_last() for c in ORDERS[order]]
    return hits.orderBy(*keys, "hit_id")


def of_segments(hits: DataFrame, vertices: DataFrame) -> DataFrame:
    """Hits on known segments with their ``vid`` and ``len``; others are left out."""
    return hits.join(vertices.select("vid", F.col("name").alias("sname"), F.col("len").alias("slen")), "sname")


def best_genes(hits: DataFrame, key: str) -> DataFrame:
    """``key, og_type, gname, score``: the best score of a gene there."""
    return hits.groupBy(key, "og_type", "gname").agg(F.max("score").alias("score"))


def type_scores(best: DataFrame, key: str, core_genes: int = 0) -> DataFrame:
    """``key, og_type, score``: the sum over the best ``core_genes`` genes of the type; negative scores count as 0.

    A window of one key and type, which holds at most as many rows as there are genes.
    """
    best = best.withColumn("score", F.greatest("score", F.lit(0.0)))
    if core_genes:
        rank = F.row_number().over(Window.partitionBy(key, "og_type").orderBy(F.desc("score"), "gname"))
        best = best.withColumn("_r", rank).where(F.col("_r") <= core_genes)
    return best.groupBy(key, "og_type").agg(F.sum("score").alias("score"))


def _exact_parts(values: Iterable[float]) -> list[float]:
    """Few numbers with exactly the sum of ``values``, none of them negative; the first is the nearest double to it."""
    rows, got = list(values), []
    while True:
        try:
            s = math.fsum([*rows, *(-x for x in got)])
        except OverflowError:
            return [math.inf]
        if not math.isfinite(s):
            return [s]
        if s == 0:
            return got or [0.0]
        got.append(s)


def exact_sums(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, value``: the nearest double to the exact sum of numbers that aren't negative, the same for every order of the rows.

    Doubles added one by one depend on their order, by which equal sums may come out unequal. Each batch leaves
    a few numbers a key that hold its sum exactly, so that no list of a key is long. Keys aren't null; null numbers don't count.
    """
    plain = rows.select(*keys, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull())
    names, schema = plain.columns, plain.schema

    def parts(frames):
        for f in frames:
            own: dict[tuple, list[float]] = {}
            for *key, x in zip(*(f[c] for c in names)):
                own.setdefault(tuple(key), []).append(x)
            yield pd.DataFrame([(*key, y) for key, xs in own.items() for y in _exact_parts(xs)], columns=names)

    def whole(frames):
        for f in frames:
            yield f.assign(**{value: [_exact_parts(xs)[0] for xs in f[value]]})

    return plain.mapInPandas(parts, schema).groupBy(*keys).agg(F.collect_list(value).alias(value)).mapInPandas(whole, schema)


def two_best(values: Sequence[Column]) -> Column:
    """Places and values of the largest and the second largest; the first wins ties: ``imax, max, imin2, second``."""
    entries = F.array(*[F.struct((-F.coalesce(v, F.lit(0.0))).alias("n"), F.lit(i).alias("i")) for i, v in enumerate(values)])
    s = F.array_sort(entries)
    return F.struct(s[0]["i"].alias("best"), (-s[0]["n"]).alias("score"), s[1]["i"].alias("next"), (-s[1]["n"]).alias("sscore"))


def classed(scores: DataFrame, key: str, sizes: DataFrame, rules: ClassRules, whole: bool) -> DataFrame:
    """``key, og_type, score, sscore, len``: the type with the best score, if it is good enough and alone.

    Segments need ``min_score``; for components (``whole``) the length ``min_len`` is enough too.
    """
    each = [F.max(F.when(F.col("og_type") == t, F.col("score"))).alias(f"s{t}") for t in range(TYPES)]
    wide = sizes.join(scores.groupBy(key).agg(*each), key, "left")
    wide = wide.select(key, "len", two_best([F.col(f"s{t}") for t in range(TYPES)]).alias("b"))
    good = F.col("b.score") >= rules.min_score
    if whole:
        good = good | (F.col("len") >= rules.min_len)
    kind = F.when(good & (F.col("b.score") != F.col("b.sscore")), F.col("b.best")).otherwise(UNCLASSIFIED)
    return wide.select(key, kind.alias("og_type"), F.col("b.score").alias("score"), F.col("b.sscore").alias("sscore"), "len")


def segment_classes(hits: DataFrame, vertices: DataFrame, rules: ClassRules = ClassRules()) -> DataFrame:
    """Class of every segment: ``vid, og_type, score, sscore, len``."""
    on = of_segments(considered(hits, rules), vertices)
    return classed(type_scores(best_genes(on, "vid"), "vid", rules.core_genes), "vid", vertices.select("vid", "len"), rules, False)


def component_classes(hits: DataFrame, vertices: DataFrame, place: DataFrame, rules: ClassRules = ClassRules()) -> tuple[DataFrame, DataFrame]:
    """Classes of components (``place``: vid, cid) and their genes: ``cid, og_type, gname, score`` with whole scores."""
    on = of_segments(considered(hits, rules), vertices).join(place, "vid")
    best = best_genes(on, "cid")
    sizes = vertices.join(place, "vid").groupBy("cid").agg(F.sum("len").alias("len"))
    found = classed(type_scores(best, "cid", rules.core_genes), "cid", sizes, rules, True)
    genes = best.withColumn("score", F.floor("score").cast("bigint"))
    return found, genes


def own_genes(genes: DataFrame, share: float = 0.8) -> DataFrame:
    """``cid, mito_genes, pltd_genes``: genes whose best hit lies there, and nowhere else one of ``share`` of it."""
    top = genes.groupBy("og_type", "gname").agg(F.max("score").alias("top"))
    near = genes.join(top, ["og_type", "gname"]).where(F.col("score") >= share * F.col("top"))
    only = near.groupBy("og_type", "gname").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("cid")).where("n = 1")
    return only.groupBy("cid").agg(
        F.count_if(F.col("og_type") == MITO).alias("mito_genes"), F.count_if(F.col("og_type") == PLTD).alias("pltd_genes")
    )


def repaired(found: DataFrame, genes: DataFrame, rules: ClassRules = ClassRules()) -> DataFrame:
    """Plastid components that are likelier mitochondrial change their type.

    The best plastid stays: the best score with a fitting length, else the best of those
    longer. Another one keeps its type if it has enough own genes or a clear score; if it
    has neither, it changes where the scores are close or its length doesn't fit, and its two scores change places.
    """
    fits = F.col("len").between(rules.min_plastid, rules.max_plastid)
    pl = found.where((F.col("og_type") == PLTD) & (F.col("len") >= rules.min_plastid))
    best = pl.orderBy(F.desc(fits), F.desc("score"), "cid").limit(1).select(F.col("cid").alias("_best"))
    low, high = rules.folds
    own = own_genes(genes, rules.own_gene)
    all_ = found.join(F.broadcast(best), F.lit(True), "left").join(own, "cid", "left")  # one row at most
    clear = (F.coalesce("pltd_genes", F.lit(0)) > high * F.coalesce("mito_genes", F.lit(0))) | (F.col("score") > high * F.col("sscore"))
    change = (
        F.col("_best").isNotNull() & (F.col("cid") != F.col("_best")) & (F.col("og_type") == PLTD) & ~clear
        & ((F.col("score") < low * F.col("sscore")) | ~fits)
    )
    kind = F.when(change, F.when(F.col("sscore") > 0, MITO).otherwise(UNCLASSIFIED)).otherwise(F.col("og_type"))
    score = F.when(change, F.col("sscore")).otherwise(F.col("score"))
    second = F.when(change, F.col("score")).otherwise(F.col("sscore"))
    return all_.select("cid", kind.alias("og_type"), score.alias("score"), second.alias("sscore"), "len")


def gaining(
    classes: DataFrame, genes: DataFrame, min_score: float = 300.0, gains: dict[int, int] | None = None, near: float = 0.85, part: float = 0.6, plastid_size: int = 160_000
) -> DataFrame:
    """``cid`` of the components of each type that bring genes, taken by descending score.

    ``classes``: cid, og_type, score, len; ``genes``: cid, og_type, gname, score. A component is left out if fewer
    than ``gains`` (by type) of its genes score ``min_score`` and no less than what is taken already, unless it has ``part`` as many
    genes as are taken, each with ``near`` of the best score so far. A plastid one is left out too if it would exceed
    ``plastid_size`` with less than ``part`` of the score per base. One task follows the typed components of a type, which are few.
    """
    gains = {PLTD: 3, MITO: 1} if gains is None else gains
    typed = classes.where(F.col("og_type") != UNCLASSIFIED).select("cid", "og_type", F.col("score").cast("double").alias("total"), "len")
    own = genes.groupBy("cid", "og_type").agg(F.collect_list(F.struct("gname", F.col("score").cast("double").alias("score"))).alias("genes"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        kind, taken, score, size, out = int(frame["og_type"].iat[0]), {}, 0.0, 0, []
        frame = frame.sort_values(["total", "cid"], ascending=[False, True])
        for cid, total, n, listed in zip(frame["cid"], frame["total"], frame["len"], frame["genes"]):
            mine = {g["gname"]: g["score"] for g in listed} if listed is not None else {}
            extra = sum(s >= min_score and s >= taken.get(g, 0) for g, s in mine.items())
            alike = sum(s >= near * taken.get(g, 0) for g, s in mine.items())
            if extra < gains.get(kind, 1) and alike < part * len(taken):
                continue
            if kind == PLTD and size + n > plastid_size and total * size < score * n * part:
                continue
            for g, s in mine.items():
                taken[g] = max(s, taken.get(g, s))
            score, size = score + total, size + n
            out.append(cid)
        return pd.DataFrame({"cid": out}, dtype="int64")

    return typed.join(own, ["cid", "og_type"], "left").groupBy("og_type").applyInPandas(run, "cid bigint")


def gene_table(genes: DataFrame) -> DataFrame:
    """``og_type, gname, score, share``: the best score of each gene over all components, and its part of the type's total."""
    best = genes.groupBy("og_type", "gname").agg(F.max("score").alias("score"))
    total = best.groupBy("og_type").agg(F.sum("score").alias("total"))
    return best.join(total, "og_type").select("og_type", "gname", "score", "total")


def in_order(hits: DataFrame) -> DataFrame:
    """Hits with the smaller of the two limits on the segment first; those with a null limit stay as they are."""
    both = F.col("alifrom").isNotNull() & F.col("alito").isNotNull()
    low, high = F.least("alifrom", "alito"), F.greatest("alifrom", "alito")
    return hits.withColumns({"alifrom": F.when(both, low).otherwise(F.col("alifrom")), "alito": F.when(both, high).otherwise(F.col("alito"))})


def lifted(hits: DataFrame, steps: DataFrame, og_type: int | None = None, max_evalue: float = 1e-6) -> DataFrame:
    """Hits on paths: ``seq, gname, strand, start, end, score`` with 0-based half-open places.

    ``steps``: ``path_id, sname, slen, rev, trim, offset``, a segment read forward or
    backward, less its first ``trim`` bases, from ``offset`` on the path. Hits that lose
    more than half of their length to the trim are left out, as are those whose limits are null or not
    in order (see :func:`in_order`).
    """
    own = hits.where((F.col("evalue") <= max_evalue) & (F.col("alifrom") <= F.col("alito")))
    if og_type is not None:
        own = own.where(F.col("og_type") == og_type)
    on = own.join(steps, "sname")
    back = F.col("rev") != 0
    beg = F.when(back, F.col("slen") - F.col("alito")).otherwise(F.col("alifrom"))
    end = F.when(back, F.col("slen") - F.col("alifrom")).otherwise(F.col("alito"))
    on = on.withColumn("_b", F.greatest(beg, F.col("trim")) - F.col("trim")).withColumn("_e", F.greatest(end, F.col("trim")) - F.col("trim"))
    on = on.where(2 * (F.col("_e") - F.col("_b")) >= F.col("alito") - F.col("alifrom"))
    minus = (F.coalesce("strand", F.lit(0)) != 0) != back
    return on.select(
        F.col("path_id").alias("seq"), "gname", F.when(minus, "-").otherwise("+").alias("strand"),
        (F.col("_b") + F.col("offset")).cast("bigint").alias("start"), (F.col("_e") + F.col("offset")).cast("bigint").alias("end"),
        F.least(F.round("score"), F.lit(1000)).cast("int").alias("score"),
    )


def classification_summary(found: DataFrame) -> DataFrame:
    """``og_type, components, bases, best`` for each type."""
    return found.groupBy("og_type").agg(F.count(F.lit(1)).alias("components"), F.sum("len").alias("bases"), F.max("score").alias("best"))
