"""Operators on bidirected graphs: vertices ``vid, len, cov`` and arcs ``v, w, ls, cov``.

An oriented vertex is ``vid * 2 + strand``; the arc v -> w says the same as its twin
``w^1 -> v^1``. All operators are joins and aggregations over whole tables; those that need
rounds keep each round in a written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.operators.chains import rank_chains
from braidwork.operators.onetask import TASK_ROWS, in_one_task, spanning_stars, strong_roots
from braidwork.operators.ordered import numbered
from braidwork.storage import discard, materialize

MAX_ROUNDS = 200


def turned(v: str | Column) -> Column:
    """The same vertex on its other strand."""
    return (F.col(v) if isinstance(v, str) else v).bitwiseXOR(F.lit(1).cast("bigint"))


def vertex(v: str) -> Column:
    return F.shiftright(v, 1)


def twins(arcs: DataFrame) -> DataFrame:
    """Every arc as its twin; a self-complementary arc is its own and is left out."""
    rest = [c for c in arcs.columns if c not in ("v", "w")]
    return arcs.where(F.col("w") != turned("v")).select(turned("w").alias("v"), turned("v").alias("w"), *rest)


def missing_twins(arcs: DataFrame) -> DataFrame:
    """Arcs that ought to be there because their twin is."""
    return twins(arcs).join(arcs.select("v", "w").distinct(), ["v", "w"], "left_anti")


def symmetric(arcs: DataFrame) -> DataFrame:
    """Both directions of every link once, with the smaller overlap and the larger coverage of the two."""
    both = arcs.select("v", "w", "ls", "cov")
    both = both.unionByName(twins(both))
    return both.groupBy("v", "w").agg(F.min("ls").alias("ls"), F.max("cov").alias("cov"))


def with_link_ids(arcs: DataFrame) -> DataFrame:
    """A symmetric graph with ``link_id``, shared by an arc and its twin, and ``comp`` on the twin."""
    own = (F.col("v") < turned("w")) | ((F.col("v") == turned("w")) & (F.col("w") <= turned("v")))
    ids = numbered(arcs.where(own).select("v", "w"), ["v", "w"], "link_id")
    both = ids.withColumn("comp", F.lit(False)).unionByName(twins(ids).withColumn("comp", F.lit(True)))
    return arcs.join(both, ["v", "w"])


def degrees(vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    """``v, outdeg, indeg`` of both strands of every vertex; what goes out of v^1 comes into v."""
    out = arcs.select("v", "w").distinct().groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    both = vertices.select(F.explode(F.array(F.col("vid") * 2, F.col("vid") * 2 + 1)).alias("v"))
    both = both.join(out, "v", "left").join(out.select(turned("v").alias("v"), F.col("n").alias("m")), "v", "left")
    return both.select("v", F.coalesce("n", F.lit(0)).alias("outdeg"), F.coalesce("m", F.lit(0)).alias("indeg"))


def live_arcs(vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    """Arcs whose both ends are there."""
    ids = vertices.select("vid")
    kept = arcs.join(ids, vertex("v") == F.col("vid"), "left_semi")
    return kept.join(ids, vertex("w") == F.col("vid"), "left_semi")


def capped_coverage(vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    """Arcs whose coverage is no more than that of either end."""
    c = vertices.select("vid", F.col("cov").alias("_c"))
    at = lambda x, n: c.withColumnsRenamed({"vid": x, "_c": n})
    both = arcs.withColumns({"_v": vertex("v"), "_w": vertex("w")}).join(at("_v", "_cv"), "_v").join(at("_w", "_cw"), "_w")
    return both.withColumn("cov", F.least("cov", "_cv", "_cw")).select(*arcs.columns)


def without_weak_crosslinks(arcs: DataFrame, fraction: float = 0.3, enough: int = 10) -> DataFrame:
    """A symmetric graph without the arcs that are weak on both ends.

    Weak on an end: below ``fraction`` of an arc of that end with coverage ``enough`` or more.
    """
    strong = arcs.where(F.col("cov") >= enough).groupBy("v").agg(F.max("cov").alias("_max"))
    here = strong.select("v", F.col("_max").alias("_a"))
    there = strong.select(turned("v").alias("w"), F.col("_max").alias("_b"))
    both = arcs.join(here, "v", "left").join(there, "w", "left")
    weak = (F.col("cov") < fraction * F.col("_a")) & (F.col("cov") < fraction * F.col("_b"))
    return both.where(~F.coalesce(weak, F.lit(False))).select(*arcs.columns)


def graph_stats(vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    """One row: vertices, bases, coverage-weighted mean, arcs, links, ends without arc, highest degree."""
    one = F.lit(1).alias("one")
    a = vertices.agg(F.count(F.lit(1)).alias("vertices"), F.sum("len").alias("bases"), (F.sum(F.col("len") * F.col("cov")) / F.nullif(F.sum("len"), F.lit(0))).alias("mean_cov"), F.max("len").alias("longest"))
    d = degrees(vertices, arcs).agg(F.sum("outdeg").alias("arcs"), F.count_if(F.col("outdeg") == 0).alias("dead_ends"), F.max("outdeg").alias("max_degree"))
    return a.select("*", one).join(d.select("*", one), "one").drop("one")


def components(vertices: DataFrame, arcs: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """``vid, cid``: every vertex with the smallest vertex of its weakly connected component.

    Each round hangs vertices below their smallest neighbour, shortens the paths and
    contracts the graph to what is left; links only shrink, and a hub is combined before
    the shuffle. The last ``task_rows`` links are joined in one task.
    """
    edges = arcs.select(vertex("v").alias("a"), vertex("w").alias("b")).where("a <> b")
    edges, n = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    place, _ = materialize(vertices.select("vid", F.col("vid").alias("cid")))
    for _ in range(MAX_ROUNDS):
        if n <= task_rows:
            stars = in_one_task(edges, lambda a, b: dict(zip(("cid", "_up"), spanning_stars(a, b))), "cid bigint, _up bigint")
            return materialize(place.join(stars, "cid", "left").select("vid", F.coalesce("_up", "cid").alias("cid")))[0]
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("up"))
        first, _ = materialize(up)
        above = first.select(F.col("a").alias("up"), F.col("up").alias("top"))
        up, _ = materialize(first.join(above, "up", "left").select("a", F.coalesce("top", "up").alias("up")))
        to = lambda old, new: up.withColumnsRenamed({"a": old, "up": new})
        moved = edges.join(to("a", "x"), "a").join(to("b", "y"), "b").where("x <> y")
        old = edges, place, first, up
        edges, n = materialize(moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
        place, _ = materialize(place.join(to("cid", "_up"), "cid", "left").select("vid", F.coalesce("_up", "cid").alias("cid")))
        discard(*old)
    raise RuntimeError(f"components didn't settle in {MAX_ROUNDS} rounds")


def component_stats(vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    """``cid, nv, len, cov, links`` of every component."""
    place = components(vertices, arcs)
    here = vertices.join(place, "vid").groupBy("cid").agg(
        F.count(F.lit(1)).alias("nv"), F.sum("len").alias("len"), F.sum(F.col("len") * F.col("cov")).alias("mass")
    )
    ends = arcs.select(vertex("v").alias("vid")).groupBy("vid").agg(F.count(F.lit(1)).alias("n"))
    links = ends.join(place, "vid").groupBy("cid").agg(F.sum("n").alias("arcs"))
    return here.join(links, "cid", "left").select("cid", "nv", "len", "mass", F.coalesce("arcs", F.lit(0)).alias("arcs"))


def neighbourhood(vertices: DataFrame, arcs: DataFrame, seeds: DataFrame, steps: int, radius: int | None = None) -> DataFrame:
    """``vid, step, dist``: vertices within ``steps`` arcs, and ``radius`` bases, of the seeds (``vid``).

    Both strands are walked. A step onto w adds the bases of w less the overlap; of several
    ways the shortest counts. Where ``radius`` is null only steps bound the walk.
    """
    size = vertices.select(F.col("vid").alias("_w"), "len")
    links = arcs.withColumn("_w", vertex("w")).join(size, "_w").select(vertex("v").alias("vid"), F.col("_w").alias("to"), (F.col("len") - F.col("ls")).alias("cost")).where("vid <> to")
    links, _ = materialize(links.groupBy("vid", "to").agg(F.greatest(F.min("cost"), F.lit(0)).alias("cost")))
    zero = F.lit(0).cast("bigint")
    reached, _ = materialize(seeds.select("vid").distinct().select("vid", F.lit(0).alias("step"), zero.alias("dist")))
    front, n = reached, 1
    for step in range(1, steps + 1):
        new = front.join(links, "vid").select(F.col("to").alias("vid"), (F.col("dist") + F.col("cost")).alias("dist"))
        if radius is not None:
            new = new.where(F.col("dist") <= radius)
        new = new.groupBy("vid").agg(F.min("dist").alias("dist"))
        known = reached.select("vid", F.col("step").alias("_s"), F.col("dist").alias("_d"))
        new = new.join(known, "vid", "left").where("_d is null or dist < _d").select("vid", F.coalesce("_s", F.lit(step)).alias("step"), "dist")
        front, n = materialize(new)
        if not n:
            break
        reached, _ = materialize(reached.join(front.select("vid"), "vid", "left_anti").unionByName(front))
    return reached


def shortest_walks(vertices: DataFrame, arcs: DataFrame, sources: DataFrame, steps: int) -> DataFrame:
    """``source, v, step``: oriented vertices that can be walked to in at most ``steps`` arcs.

    The first step at which each is met; a source meets itself at 0.
    """
    reached, _ = materialize(sources.select(F.col("v").alias("source"), "v").distinct().withColumn("step", F.lit(0)))
    front = reached
    pairs, _ = materialize(arcs.select("v", F.col("w").alias("to")).distinct())
    for step in range(1, steps + 1):
        new = front.join(pairs, "v").select("source", F.col("to").alias("v")).distinct()
        front, n = materialize(new.join(reached, ["source", "v"], "left_anti").withColumn("step", F.lit(step)))
        if not n:
            break
        reached = reached.unionByName(front)
    return reached


def path_exists(vertices: DataFrame, arcs: DataFrame, pairs: DataFrame, steps: int) -> DataFrame:
    """``source, sink, step`` of the asked pairs of oriented vertices; null where no walk is short enough."""
    walks = shortest_walks(vertices, arcs, pairs.select(F.col("source").alias("v")), steps)
    return pairs.join(walks.withColumnRenamed("v", "sink"), ["source", "sink"], "left")


def strong_components(vertices: DataFrame, arcs: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """``v, scc``: oriented vertices with the largest member of their strongly connected component.

    Unbranched paths are contracted first. While more than ``task_rows`` arcs are left,
    vertices without a way in or out are peeled off, each of the rest takes the largest
    vertex that reaches it as its colour, and those of a colour that reach that vertex form its
    component; the others go into the next round.
    """
    both = vertices.select(F.explode(F.array(F.col("vid") * 2, F.col("vid") * 2 + 1)).alias("v"))
    pairs, _ = materialize(arcs.select("v", "w").distinct())
    out = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("w")).where("n = 1")
    into = pairs.groupBy("w").agg(F.count(F.lit(1)).alias("m")).where("m = 1")
    links = out.join(into, "w").where("v <> w").select(F.col("v").alias("node"), F.col("w").alias("next"))
    ranks, _ = materialize(rank_chains(links, task_rows))
    heads = ranks.select("node", "head", "circular")
    at = lambda c, h: heads.select(F.col("node").alias(c), F.col("head").alias(h))
    # An arc inside a path is needed only where it closes it.
    outer = pairs.join(links.select(F.col("node").alias("v"), F.col("next").alias("w")), ["v", "w"], "left_anti")
    outer = outer.join(at("v", "hv"), "v", "left").join(at("w", "hw"), "w", "left")
    outer, n = materialize(outer.select(F.coalesce("hv", "v").alias("v"), F.coalesce("hw", "w").alias("w")).distinct())
    closed = outer.where("v = w").select(F.col("v").alias("node")).unionByName(ranks.where("circular").select(F.col("head").alias("node"))).distinct()
    found: list[DataFrame] = []
    rest = outer.where("v <> w")
    for _ in range(MAX_ROUNDS):
        if n <= task_rows:
            found.append(in_one_task(rest, strong_roots, "v bigint, scc bigint"))
            break
        rest, n = _peeled(rest)
        nodes = rest.select("v").unionByName(rest.select(F.col("w").alias("v"))).distinct()
        colour = _spread_maximum(nodes.withColumn("c", F.col("v")), rest)
        same = rest.join(colour.withColumnRenamed("c", "cv"), "v").join(colour.select(F.col("v").alias("w"), F.col("c").alias("cw")), "w").where("cv = cw")
        same, _ = materialize(same.select("v", "w"))
        reached, _ = materialize(colour.where("v = c").select("v", "c"))
        front, m = reached, 1
        while m:  # within a colour, backwards from its root
            back = front.select(F.col("v").alias("w"), "c").join(same, "w").select("v", "c").distinct()
            front, m = materialize(back.join(reached.select("v"), "v", "left_anti"))
            reached, _ = materialize(reached.unionByName(front))
        found.append(reached.select("v", F.col("c").alias("scc")))
        gone = reached.select("v")
        rest, n = materialize(rest.join(gone, "v", "left_anti").join(gone.withColumnRenamed("v", "w"), "w", "left_anti").select("v", "w"))
    else:
        raise RuntimeError(f"strong components didn't settle in {MAX_ROUNDS} rounds")
    groups = found[0]
    for f in found[1:]:
        groups = groups.unionByName(f)
    many = groups.groupBy("scc").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    joint = groups.join(many, "scc").select(F.col("v").alias("node"), "scc")
    joint = joint.unionByName(closed.join(joint, "node", "left_anti").select("node", F.col("node").alias("scc")))
    joint, _ = materialize(joint)
    # Every vertex of a path takes part if the path does; the largest names the component.
    own = both.join(heads.select(F.col("node").alias("v"), "head"), "v", "left").withColumn("node", F.coalesce("head", "v"))
    own = own.join(joint, "node", "left")
    name = own.where("scc is not null").groupBy("scc").agg(F.max("v").alias("name"))
    return own.join(name, "scc", "left").select("v", F.coalesce("name", "v").alias("scc"))


def _peeled(pairs: DataFrame) -> tuple[DataFrame, int]:
    """Arcs left when vertices without a way in or out have been taken away again and again."""
    pairs, n = materialize(pairs)
    for _ in range(MAX_ROUNDS):
        src, dst = pairs.select("v").distinct(), pairs.select(F.col("w").alias("v")).distinct()
        inner = src.join(dst, "v", "left_semi")
        left, m = materialize(pairs.join(inner, "v", "left_semi").join(inner.withColumnRenamed("v", "w"), "w", "left_semi").select("v", "w"))
        if m == n:
            break
        pairs, n = left, m
    return pairs, n


def _spread_maximum(colour: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every node with the largest ``c`` of those that reach it."""
    colour, _ = materialize(colour)
    while True:
        sent = colour.join(pairs, "v").groupBy("w").agg(F.max("c").alias("m")).withColumnRenamed("w", "v")
        next_ = colour.join(sent, "v", "left").select("v", F.greatest("c", F.coalesce("m", "c")).alias("c"), (F.coalesce("m", "c") > F.col("c")).alias("new"))
        next_, _ = materialize(next_)
        if next_.where("new").isEmpty():
            return next_.drop("new")
        colour = next_.drop("new")


def merged_graphs(parts: list[tuple[DataFrame, DataFrame]], vertices: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The union of graphs: coverages add up, but to no more than in the original."""
    vs, es = parts[0]
    for v, e in parts[1:]:
        vs, es = vs.unionByName(v), es.unionByName(e)
    vs = vs.groupBy("vid").agg(F.sum("cov").alias("_s")).join(vertices, "vid")
    es = es.groupBy("v", "w").agg(F.sum("cov").alias("_s")).join(arcs, ["v", "w"])
    cap = F.least("_s", "cov")
    return vs.withColumn("cov", cap).select(*vertices.columns), es.withColumn("cov", cap).select(*arcs.columns)


def left_over(vertices: DataFrame, taken: DataFrame, least: int) -> DataFrame:
    """Vertices on none of the taken paths (``vid``), if at least ``least`` bases long."""
    return vertices.join(taken.select("vid").distinct(), "vid", "left_anti").where(F.col("len") >= least)


def well_covered(vertices: DataFrame, arcs: DataFrame, fraction: float) -> tuple[DataFrame, DataFrame]:
    """Vertices with at least ``fraction`` of the length-weighted mean coverage of their component, and the arcs left."""
    place = components(vertices, arcs)
    placed = vertices.join(place, "vid")
    mean = placed.groupBy("cid").agg((F.sum(F.col("len") * F.col("cov")) / F.nullif(F.sum("len"), F.lit(0))).alias("_mean"))
    kept = placed.join(mean, "cid").where(F.col("cov") >= fraction * F.coalesce("_mean", F.lit(0.0))).select(*vertices.columns)
    return kept, live_arcs(kept, arcs)


def duplicated(vertices: DataFrame, arcs: DataFrame, copies: DataFrame, allow_deletion: bool = False) -> tuple[DataFrame, DataFrame]:
    """Vertices as often as ``copies (vid, copy)`` says, each with its part of the coverage.

    Clone 0 keeps the id; ``vid, clone`` name the rows. Arcs go between all clones, with
    coverage divided by the product of copies (whole numbers). Copy 0 deletes if allowed, and counts as 1 otherwise.
    """
    lowest = 0 if allow_deletion else 1
    n = copies.select("vid", F.greatest(F.col("copy"), F.lit(lowest)).alias("_n"))
    vs = vertices.join(n, "vid", "left").withColumn("_n", F.coalesce("_n", F.lit(1))).where("_n > 0")
    clones = vs.select("vid", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("clone"), *[c for c in vertices.columns if c not in ("vid", "cov")], F.expr("cov div _n").alias("cov"))
    end = vs.select("vid", "_n")
    es = arcs.withColumns({"_v": vertex("v"), "_w": vertex("w")})
    es = es.join(end.withColumnsRenamed({"vid": "_v", "_n": "_nv"}), "_v").join(end.withColumnsRenamed({"vid": "_w", "_n": "_nw"}), "_w")
    es = es.withColumn("v_clone", F.explode(F.sequence(F.lit(0), F.col("_nv") - 1))).withColumn("w_clone", F.explode(F.sequence(F.lit(0), F.col("_nw") - 1)))
    return clones, es.select("v", "v_clone", "w", "w_clone", "ls", F.expr("cov div (_nv * _nw)").alias("cov"))
