"""Cleaning of assembly graphs: tips, bubbles and weak cross-links, as operations on whole tables.

Each works on unbranched paths, which :mod:`chains` finds in log rounds, so what a step
decides doesn't depend on the order in which vertices are visited.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.operators.chains import unitigs
from braidwork.operators.graph import live_arcs, turned, vertex, without_weak_crosslinks
from braidwork.storage import materialize

MAX_ROUNDS = 50


def _oriented(vertices: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members, oriented unitigs ``o, uid, len, mass`` and arcs between them."""
    members, table, links = unitigs(vertices, arcs)
    mass = members.select("uid", vertex("v").alias("vid")).join(vertices.select("vid", F.col("len").alias("_l"), "cov"), "vid")
    mass = mass.groupBy("uid").agg(F.sum(F.col("_l") * F.col("cov")).alias("mass"))
    table = table.where("not circ").join(mass, "uid")
    both = table.select(F.explode(F.array(F.col("uid") * 2, F.col("uid") * 2 + 1)).alias("o"), "uid", "len", "mass")
    return members, materialize(both)[0], materialize(links)[0]


def _without(vertices: DataFrame, arcs: DataFrame, members: DataFrame, dead: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    gone, n = materialize(members.join(dead, "uid", "left_semi").select(vertex("v").alias("vid")).distinct())
    kept, _ = materialize(vertices.join(gone, "vid", "left_anti"))
    left, _ = materialize(live_arcs(kept, arcs))
    return kept, left, n


def drop_tips(vertices: DataFrame, arcs: DataFrame, tip_len: int = 10_000, protect: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """The graph without dead ends of at most ``tip_len`` bases, and how many vertices went.

    A dead end is an unbranched path with nothing behind it that leaves a vertex with another
    way on. ``protect`` keeps those that weigh more (bases times coverage) than every other way.
    """
    members, o, links = _oriented(vertices, arcs)
    out = links.groupBy("v").agg(F.count(F.lit(1)).alias("ways"))
    ends = o.join(out.select(F.col("v").alias("o")), "o", "left_anti").where(F.col("len") <= tip_len)
    # Arcs p -> tip where p has other ways.
    into = links.join(ends.select(F.col("o").alias("w"), "uid", "mass"), "w").join(out.where("ways > 1"), "v")
    if protect:
        others = links.select("v", F.col("w").alias("x")).join(o.select(F.col("o").alias("x"), F.col("mass").alias("rival")), "x")
        best = into.join(others, "v").where("x <> w").groupBy("uid").agg(F.max("rival").alias("rival"), F.max("mass").alias("mass"))
        dead = best.where("mass <= rival").select("uid")
    else:
        dead = into.select("uid").distinct()
    return _without(vertices, arcs, members, dead)


def pop_bubbles(vertices: DataFrame, arcs: DataFrame, max_len: int = 100_000) -> tuple[DataFrame, DataFrame, int]:
    """The graph with one path left of several unbranched ones between the same two ends.

    Paths of at most ``max_len`` bases with one arc in and one out are compared by bases
    times coverage; the heaviest stays (the smaller id, if equal). Nested bubbles need another round,
    in which the inner ones have become unbranched.
    """
    members, o, links = _oriented(vertices, arcs)
    single = links.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("end")).where("n = 1")
    fore = single.select(F.col("v").alias("o"), "end")
    back = single.select(turned("v").alias("o"), turned("end").alias("start"))
    ways = o.where(F.col("len") <= max_len).join(fore, "o").join(back, "o").where("start <> end and (start >> 1) <> uid and (end >> 1) <> uid")
    # Read from the smaller of the two ends, each path once.
    ways = ways.where((F.col("start") < turned("end")) | ((F.col("start") == turned("end")) & (F.col("o") % 2 == 0)))
    best = ways.groupBy("start", "end").agg(F.max(F.struct("mass", (-F.col("uid")).alias("u"))).alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    dead = ways.join(best, ["start", "end"]).where(F.col("uid") != -F.col("b.u")).select("uid").distinct()
    return _without(vertices, arcs, members, dead)


def cleaned(
    vertices: DataFrame, arcs: DataFrame, tip_len: int = 10_000, bubble_len: int = 100_000, weak: float = 0.3, bubbles: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Tips, bubbles and weak cross-links taken away until a round finds none."""
    for _ in range(MAX_ROUNDS):
        vertices, arcs, gone = drop_tips(vertices, arcs, tip_len)
        if bubbles:
            vertices, arcs, popped = pop_bubbles(vertices, arcs, bubble_len)
            before = materialize(arcs)[1]
            arcs, after = materialize(without_weak_crosslinks(arcs, weak))
            gone += popped + before - after
        if not gone:
            break
    return vertices, arcs
