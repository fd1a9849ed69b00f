"""Separating the ways through repeats, and back to single k-mers."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.operators.graph import turned, twins
from braidwork.storage import materialize

#: A way is dropped if it has less than this part of the best score on both of its sides.
KEEP = 0.3
MIN_SCORE = 10.0
MAX_BASES = 30_000


def kept_ways(links: DataFrame, sizes: DataFrame, triplets: DataFrame, k: int, keep: float = KEEP, min_score: float = MIN_SCORE) -> DataFrame:
    """``u, a, b, score`` of the ways a -> u -> b that stay, for unitigs (read forward) that can be threaded.

    Threadable are unitigs of at most MAX_BASES / k k-mers without an arc onto themselves,
    whose arcs are all supported by some way, with a best score of at least ``min_score``. An
    arc without support might belong to any way, so such a unitig is left as it is.
    """
    even = lambda df: df.where("u % 2 = 0")
    ins = even(links.select(F.col("v").alias("a"), F.col("w").alias("u")))
    outs = even(links.select(F.col("v").alias("u"), F.col("w").alias("b")))
    loops = links.where((F.col("v") == F.col("w")) | (F.col("v") == turned("w"))).select((F.shiftright("v", 1) * 2).alias("u")).distinct()
    small = sizes.where(F.col("n") <= math.ceil(MAX_BASES / k)).select((F.col("uid") * 2).alias("u"))
    ways = even(triplets.where("score > 0")).join(ins, ["a", "u"], "left_semi").join(outs, ["u", "b"], "left_semi")
    ways, _ = materialize(ways.join(small, "u", "left_semi").join(loops, "u", "left_anti").select("u", "a", "b", "score"))
    bare = ins.join(ways, ["a", "u"], "left_anti").select("u").unionByName(outs.join(ways, ["u", "b"], "left_anti").select("u")).distinct()
    ways = ways.join(bare, "u", "left_anti")
    top_a = ways.groupBy("u", "a").agg(F.max("score").alias("ta"))
    top_b = ways.groupBy("u", "b").agg(F.max("score").alias("tb"))
    top = ways.groupBy("u").agg(F.max("score").alias("tu")).where(F.col("tu") >= min_score)
    rows = ways.join(top, "u").join(top_a, ["u", "a"]).join(top_b, ["u", "b"])
    return rows.where(~((F.col("score") < keep * F.col("ta")) & (F.col("score") < keep * F.col("tb")))).select("u", "a", "b", "score")


def way_groups(ways: DataFrame) -> DataFrame:
    """``u, side, x, grp, share``: arcs of a unitig that some way connects have one group number.

    ``side`` is 'in' or 'out', ``x`` the other end; ``share`` is the group's part of all
    scores. Only unitigs with two groups or more have rows. A group of rows is the ways of one unitig.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        parent: dict = {}

        def find(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in zip(frame["a"], frame["b"]):
            ra, rb = find(("in", a)), find(("out", b))
            parent[max(ra, rb)] = min(ra, rb)
        roots = sorted({find(x) for x in list(parent)})
        cols = ["u", "side", "x", "grp", "share"]
        if len(roots) < 2:
            return pd.DataFrame([], columns=cols)
        score = dict.fromkeys(roots, 0.0)
        for a, s in zip(frame["a"], frame["score"]):
            score[find(("in", a))] += s
        total = sum(score.values())
        u = frame["u"].iat[0]
        return pd.DataFrame([(u, side, x, roots.index(find((side, x))), score[find((side, x))] / total) for side, x in sorted(parent)], columns=cols)

    return ways.groupBy("u").applyInPandas(run, "u bigint, side string, x bigint, grp int, share double")


def multiplex(members: DataFrame, sizes: DataFrame, links: DataFrame, triplets: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Unitigs with several separate ways as one copy for each; members, sizes, links, and how many were split.

    ``sizes``: uid, n, cov; ``links``: v, w, ln, cov, both directions. Copies get new ids
    above all others, and their part of the coverage by score.
    """
    groups, n = materialize(way_groups(kept_ways(links, sizes, triplets, k)))
    if not n:
        return members, sizes, links, 0
    base = sizes.agg(F.max("uid")).first()[0] + 1
    copies = groups.select((F.col("u") / 2).cast("bigint").alias("uid"), "grp", "share").distinct()
    from braidwork.operators.ordered import numbered

    copies, _ = materialize(numbered(copies, ["uid", "grp"], "_i").withColumn("new", F.col("_i") + base).drop("_i"))
    split = copies.select("uid").distinct()
    new_sizes = sizes.join(split, "uid", "left_anti").unionByName(
        sizes.join(copies, "uid").select(F.col("new").alias("uid"), "n", F.greatest(F.round(F.col("cov") * F.col("share")), F.lit(1)).cast("bigint").alias("cov"))
    )
    new_members = members.join(split, "uid", "left_anti").unionByName(members.join(copies, "uid").select(F.col("new").alias("uid"), "pos", "v"))
    # Which copy an end of a link belongs to is said by the link's other end.
    at = groups.join(copies.select((F.col("uid") * 2).alias("u"), "grp", "new"), ["u", "grp"])
    tails = at.where("side = 'out'").select(F.col("u").alias("v"), F.col("x").alias("w"), (F.col("new") * 2).alias("nv"))
    tails = tails.unionByName(at.where("side = 'in'").select(turned("u").alias("v"), turned("x").alias("w"), (F.col("new") * 2 + 1).alias("nv")))
    heads = at.where("side = 'in'").select(F.col("x").alias("v"), F.col("u").alias("w"), (F.col("new") * 2).alias("nw"))
    heads = heads.unionByName(at.where("side = 'out'").select(turned("x").alias("v"), turned("u").alias("w"), (F.col("new") * 2 + 1).alias("nw")))
    moved = links.join(tails, ["v", "w"], "left").join(heads, ["v", "w"], "left")
    moved = moved.select(F.coalesce("nv", "v").alias("v"), F.coalesce("nw", "w").alias("w"), "ln", "cov")
    return materialize(new_members)[0], materialize(new_sizes)[0], materialize(moved)[0], split.count()


def demultiplex(members: DataFrame, links: DataFrame) -> DataFrame:
    """``v, w, ls, cov``: arcs between single k-mers again: within unitigs, and over links that share none. Coverage is 0 until counted."""
    along = Window.partitionBy("uid").orderBy("pos")
    inner = members.select("v", F.lead("v").over(along).alias("w")).where("w is not null")
    n = members.groupBy("uid").agg(F.min_by("v", "pos").alias("first"), F.max_by("v", "pos").alias("last"))
    tail = n.select((F.col("uid") * 2).alias("v"), F.col("last").alias("nv")).unionByName(n.select((F.col("uid") * 2 + 1).alias("v"), turned("first").alias("nv")))
    head = n.select((F.col("uid") * 2).alias("w"), F.col("first").alias("nw")).unionByName(n.select((F.col("uid") * 2 + 1).alias("w"), turned("last").alias("nw")))
    outer = links.where("ln = 0").join(tail, "v").join(head, "w").select(F.col("nv").alias("v"), F.col("nw").alias("w"))
    arcs = inner.unionByName(outer)
    return arcs.unionByName(twins(arcs)).distinct().select("v", "w", F.lit(0).cast("bigint").alias("ls"), F.lit(0).cast("bigint").alias("cov"))
