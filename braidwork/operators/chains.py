"""Ranking of linked lists by pointer doubling, and what follows from it on graphs.

Everything runs on tables: a chain of n nodes takes log2(n) rounds, whatever its length,
and no chain is ever brought into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.operators.onetask import TASK_ROWS, in_one_task, list_ranks
from braidwork.storage import materialize

MAX_ROUNDS = 64


def rank_chains(links: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """``node, head, pos, circular`` of every node of ``links (node, next)``.

    A node has at most one next and one previous node. ``head`` is the first node of the
    chain and ``pos`` the number of steps from it; a circle begins at its smallest node.
    Up to ``task_rows`` links are ranked in one task.
    """
    links, n = materialize(links.select("node", "next").distinct())
    if n <= task_rows:
        return in_one_task(links, list_ranks, "node bigint, head bigint, pos bigint, circular boolean")
    ranked, circles = _rank(links)
    if circles is None:
        return ranked.withColumn("circular", F.lit(False))
    low = circles.select(F.col("low").alias("next")).distinct()
    inside = links.join(circles.select("node"), "node", "left_semi")
    opened, _ = _rank(inside.join(low, "next", "left_anti").select("node", "next"))
    alone = low.join(opened.select(F.col("node").alias("next")), "next", "left_anti")  # circles of one node
    alone = alone.select(F.col("next").alias("node"), F.col("next").alias("head"), F.lit(0).cast("bigint").alias("pos"))
    round_ = opened.unionByName(alone).withColumn("circular", F.lit(True))
    return ranked.withColumn("circular", F.lit(False)).unionByName(round_)


def _rank(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    before = links.select(F.col("next").alias("node"), F.col("node").alias("up"))
    one = F.lit(1).cast("bigint")
    open_ = before.select("node", "up", one.alias("hops"), F.least("node", "up").alias("low"))
    heads = links.select("node").join(before.select("node"), "node", "left_anti")
    done = [heads.select("node", F.col("node").alias("head"), F.lit(0).cast("bigint").alias("pos"))]
    ends, _ = materialize(done[0])
    open_, n = materialize(open_)
    settled = [ends]
    for _ in range(MAX_ROUNDS):
        if not n:
            break
        # Places of the nodes above: those settled so far, or those still open.
        above = ends.select(F.col("node").alias("up"), F.col("head").alias("up2"), F.col("pos").alias("more"), F.lit(True).alias("sure"), F.lit(None).cast("bigint").alias("low2"))
        above = above.unionByName(open_.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("more"), F.lit(False).alias("sure"), F.col("low").alias("low2")))
        step = open_.join(above, "up").select(
            "node", F.col("up2").alias("up"), (F.col("hops") + F.col("more")).alias("hops"),
            F.least("low", F.coalesce("low2", "low")).alias("low"), "sure", (F.col("low2") < F.col("low")).alias("lower"),
        )
        step, total = materialize(step)
        new = step.where("sure").select("node", F.col("up").alias("head"), F.col("hops").alias("pos"))
        settled.append(new)
        ends = ends.unionByName(new)
        seen = step.agg(F.count_if("sure").alias("sure"), F.count_if("lower").alias("lower")).first()
        open_ = step.where("not sure").drop("sure", "lower")
        if not seen["sure"] and not seen["lower"]:  # only circles are left, and all know their smallest node
            return ends, open_
        n = total - seen["sure"]
    if n:
        raise RuntimeError(f"chains didn't settle in {MAX_ROUNDS} rounds")
    return ends, None


def through_links(arcs: DataFrame) -> DataFrame:
    """Arcs ``node -> next`` at which two vertices can be joined: the only one out of v and the only one into w.

    ``arcs`` has both directions of each link. A vertex isn't joined to itself or to its own other strand.
    """
    pairs = arcs.select("v", "w").distinct()
    single = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("w")).where("n = 1")
    into = single.select(F.col("v").bitwiseXOR(F.lit(1).cast("bigint")).alias("w"))
    links = single.join(into, "w", "left_semi").where("(v >> 1) <> (w >> 1)")
    return links.select(F.col("v").alias("node"), F.col("w").alias("next"))


def unitigs(vertices: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Maximal unbranched paths: members, unitigs and the arcs between them.

    ``vertices`` has ``vid, len``, ``arcs`` both directions as ``v, w, ls, cov``. Of the two
    readings of a path that of the smaller first vertex is kept. Returns
    ``uid, pos, v`` (``uid`` is the vid of the first member), ``uid, n, len, circ``, and
    ``v, w, ls, cov`` between oriented unitigs. A single vertex with an arc onto itself is circular.
    """
    one = F.lit(1).cast("bigint")
    ranks, _ = materialize(rank_chains(through_links(arcs)))
    ends = ranks.groupBy("head").agg(F.max_by("node", "pos").alias("tail"), F.min("node").alias("low"), F.max("circular").alias("circular"))
    # The other reading begins at the turned tail; that of a circle at its own smallest node.
    first = F.when(F.col("circular"), (F.col("head").bitwiseAND(one)) == 0).otherwise(F.col("head") < F.col("tail").bitwiseXOR(one))
    kept = ranks.join(ends.where(first).select("head", "circular"), ["head", "circular"])
    alone = vertices.select((F.col("vid") * 2).alias("node")).join(ranks.select((F.shiftright("node", 1) * 2).alias("node")).distinct(), "node", "left_anti")
    alone = alone.select("node", F.col("node").alias("head"), F.lit(0).cast("bigint").alias("pos"), F.lit(False).alias("circular"))
    members = kept.select("node", "head", "pos", "circular").unionByName(alone)
    members, _ = materialize(members.select(F.shiftright("head", 1).alias("uid"), "pos", F.col("node").alias("v"), "circular"))

    own = arcs.groupBy("v", "w").agg(F.max("ls").alias("ls"), F.max("cov").alias("cov"))
    loops = own.where("v = w").select(F.shiftright("v", 1).alias("uid")).distinct().withColumn("loop", F.lit(True))
    after = members.select("uid", (F.col("pos") + 1).alias("pos"), F.col("v").alias("from"))
    inner = members.join(after, ["uid", "pos"], "left")
    inner = inner.join(own.select(F.col("v").alias("from"), F.col("w").alias("v"), "ls"), ["from", "v"], "left")
    inner = inner.join(vertices.select((F.col("vid")).alias("vid"), "len"), F.shiftright("v", 1) == F.col("vid"), "left")
    table = inner.groupBy("uid").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce("len", F.lit(0)) - F.coalesce("ls", F.lit(0))).alias("len"),
        F.max("circular").alias("circular"),
    )
    table = table.join(loops, "uid", "left")
    table = table.select("uid", "n", "len", (F.col("circular") | ((F.col("n") == 1) & F.coalesce("loop", F.lit(False)))).alias("circ"))

    # An arc goes from the last member of a reading to the first of another.
    size = members.groupBy("uid").agg(F.min_by("v", "pos").alias("first"), F.max_by("v", "pos").alias("last"))
    start = size.select(F.col("first").alias("at"), (F.col("uid") * 2).alias("u")).unionByName(
        size.select(F.col("last").bitwiseXOR(one).alias("at"), (F.col("uid") * 2 + 1).alias("u"))
    )
    stop = size.select(F.col("last").alias("at"), (F.col("uid") * 2).alias("u")).unionByName(
        size.select(F.col("first").bitwiseXOR(one).alias("at"), (F.col("uid") * 2 + 1).alias("u"))
    )
    outer = own.join(stop.select(F.col("at").alias("v"), F.col("u").alias("uv")), "v").join(
        start.select(F.col("at").alias("w"), F.col("u").alias("uw")), "w"
    )
    links = outer.select(F.col("uv").alias("v"), F.col("uw").alias("w"), "ls", "cov")
    return members.drop("circular"), table, links


def end_probe(vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    """``v, steps, tail, kind`` of every oriented vertex: where the unbranched walk from it ends, and why.

    ``kind``: 'tip' (nothing goes out of the tail), 'multi_out' (several arcs do), 'multi_nei'
    (one, into a vertex with others), 'circle' (the walk comes round), 'turn' (it would
    go to its own other strand or itself).
    """
    one = F.lit(1).cast("bigint")
    ranks, _ = materialize(rank_chains(through_links(arcs)))
    ends = ranks.groupBy("head").agg(F.max_by("node", "pos").alias("tail"), F.max("pos").alias("last"))
    walked = ranks.join(ends, "head").select(F.col("node").alias("v"), (F.col("last") - F.col("pos")).alias("steps"), "tail", "circular")
    both = vertices.select(F.explode(F.array(F.col("vid") * 2, F.col("vid") * 2 + 1)).alias("v"))
    walked = both.join(walked, "v", "left").select(
        "v", F.coalesce("steps", F.lit(0)).alias("steps"), F.coalesce("tail", "v").alias("tail"), F.coalesce("circular", F.lit(False)).alias("circular")
    )
    out = arcs.select("v", "w").distinct().groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("w"))
    back = out.select(F.col("v").bitwiseXOR(one).alias("w"), F.col("n").alias("others"))
    fate = out.join(back, "w", "left").select(F.col("v").alias("tail"), "n", "others")
    kind = (
        F.when(F.col("circular"), "circle").when(F.col("n").isNull(), "tip").when(F.col("n") > 1, "multi_out")
        .when(F.coalesce("others", F.lit(0)) > 1, "multi_nei").otherwise("turn")
    )
    return walked.join(fate, "tail", "left").select("v", "steps", "tail", kind.alias("kind"))


def arc_groups(arcs: DataFrame) -> DataFrame:
    """``v, w, head_v, head_w``: arcs that follow each other through unbranched vertices share a head arc; a circle's is its smallest."""
    from braidwork.operators.ordered import numbered

    one = F.lit(1).cast("bigint")
    pairs, _ = materialize(numbered(arcs.select("v", "w").distinct(), ["v", "w"], "key"))
    out = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    simple = out.where("n = 1").select("v").join(out.where("n = 1").select(F.col("v").bitwiseXOR(one).alias("v")), "v", "left_semi")
    into = pairs.select(F.col("w").alias("v"), F.col("key").alias("node"))
    follow = into.join(simple, "v", "left_semi").join(pairs.select("v", F.col("key").alias("next")), "v").where("node <> next")
    heads = rank_chains(follow).select(F.col("node").alias("key"), "head")
    named = pairs.join(heads, "key", "left").withColumn("head", F.coalesce("head", "key"))
    return named.join(pairs.select(F.col("key").alias("head"), F.col("v").alias("head_v"), F.col("w").alias("head_w")), "head").select("v", "w", "head_v", "head_w")
