import random
from collections import defaultdict

import pytest

from braidwork.operators import chains, clean, graph


def make(spark, n, links, cov=10):
    vs = spark.createDataFrame([(i, 100, cov) for i in range(n)], "vid bigint, len bigint, cov bigint")
    rows = {}
    for v, w, *rest in links:
        c = rest[0] if rest else cov
        rows[v, w] = rows[w ^ 1, v ^ 1] = c
    return vs, spark.createDataFrame([(v, w, 10, c) for (v, w), c in rows.items()], "v bigint, w bigint, ls bigint, cov bigint")


def random_links(seed, n, m):
    rng = random.Random(seed)
    return [(rng.randrange(2 * n), rng.randrange(2 * n)) for _ in range(m)]


def closure(n, arcs):
    reach = {v: {v} for v in range(2 * n)}
    changed = True
    while changed:
        changed = False
        for v, w in arcs:
            if not reach[w] <= reach[v]:
                reach[v] |= reach[w]
                changed = True
    return reach


@pytest.mark.parametrize("task_rows", [1, 10**6])
@pytest.mark.parametrize("seed,n,m", [(1, 12, 8), (2, 10, 14), (3, 12, 20), (4, 6, 0)])
def test_components_and_strong_components(spark, seed, n, m, task_rows):
    vs, es = make(spark, n, random_links(seed, n, m))
    arcs = [(r["v"], r["w"]) for r in es.collect()]
    label = list(range(n))
    for _ in range(n):
        for v, w in arcs:
            label[v >> 1] = label[w >> 1] = min(label[v >> 1], label[w >> 1])
    assert {tuple(r) for r in graph.components(vs, es, task_rows).select("vid", "cid").collect()} == set(enumerate(label))
    reach = closure(n, arcs)
    want = {(v, max(w for w in reach[v] if v in reach[w])) for v in range(2 * n)}
    assert {tuple(r) for r in graph.strong_components(vs, es, task_rows).select("v", "scc").collect()} == want


@pytest.mark.parametrize("task_rows", [1, 10**6])
def test_rank_chains(spark, task_rows):
    rng = random.Random(5)
    ids = rng.sample(range(10**9), 100)
    links, want = [], set()
    at = 0
    for size, circle in ((1, False), (2, False), (37, False), (3, True), (8, True), (20, True)):
        part = ids[at : at + size]
        at += size
        if circle:
            part = part[part.index(min(part)) :] + part[: part.index(min(part))]
            links.append((part[-1], part[0]))
        links += zip(part, part[1:])
        if size > 1:
            want |= {(x, part[0], i, circle) for i, x in enumerate(part)}
    rng.shuffle(links)
    got = chains.rank_chains(spark.createDataFrame(links, "node bigint, next bigint"), task_rows)
    assert {tuple(r) for r in got.select("node", "head", "pos", "circular").collect()} == want


def unitigs(spark, n, links):
    vs, es = make(spark, n, links)
    members, table, arcs = chains.unitigs(vs, es)
    paths = defaultdict(list)
    for r in members.orderBy("pos").collect():
        paths[r["uid"]].append(r["v"])
    return dict(paths), {r["uid"]: r for r in table.collect()}, {(r["v"], r["w"]) for r in arcs.collect()}


def test_unitigs_linear_circle_and_hairpin(spark):
    paths, table, arcs = unitigs(spark, 7, [(0, 2), (2, 5), (6, 8), (8, 6), (10, 11), (12, 12)])
    assert paths[0] == [0, 2, 5] and table[0]["n"] == 3 and table[0]["len"] == 280 and not table[0]["circ"]
    assert paths[3] == [6, 8] and table[3]["circ"] and table[6]["circ"] and not table[5]["circ"]
    assert (10, 11) in arcs and (12, 12) in arcs and (6, 6) in arcs


@pytest.mark.parametrize("seed", range(4))
def test_unitigs_keep_every_vertex_once_and_are_stable(spark, seed):
    links = random_links(seed, 15, 12)
    paths, table, arcs = unitigs(spark, 15, links)
    assert sorted(v >> 1 for p in paths.values() for v in p) == list(range(15))
    have = {(v, w) for v, w in links} | {(w ^ 1, v ^ 1) for v, w in links}
    out = defaultdict(set)
    for v, w in have:
        out[v].add(w)
    for p in paths.values():
        for x, y in zip(p, p[1:]):
            assert out[x] == {y} and len(out[y ^ 1]) == 1
    # No two ends could still be joined.
    for v, w in arcs:
        if sum(a == v for a, _ in arcs) == 1 and sum(b == w for _, b in arcs) == 1:
            assert v >> 1 == w >> 1
    assert {(w ^ 1, v ^ 1) for v, w in arcs} == arcs


def test_end_probe_and_groups(spark):
    vs, es = make(spark, 6, [(0, 2), (2, 4), (4, 6), (4, 8), (10, 10)])
    got = {r["v"]: (r["steps"], r["tail"], r["kind"]) for r in chains.end_probe(vs, es).collect()}
    assert got[0] == (2, 4, "multi_out") and got[5] == (2, 1, "tip") and got[6] == (0, 6, "tip")
    assert got[7] == (0, 7, "multi_nei") and got[10][2] == "turn"
    groups = {(r["v"], r["w"]): (r["head_v"], r["head_w"]) for r in chains.arc_groups(es).collect()}
    assert groups[0, 2] == groups[2, 4] != groups[4, 6]


def test_tips(spark):
    # A path of heavy vertices with a short dead end at vertex 2.
    vs, es = make(spark, 6, [(0, 2), (2, 4), (4, 6), (6, 8), (4, 10)])
    kept, left, gone = clean.drop_tips(vs, es, 100)
    assert gone == 1 and 5 not in {r["vid"] for r in kept.collect()} and left.count() == 8
    assert clean.drop_tips(vs, es, 50)[2] == 0


def test_bubble_keeps_the_heavier_side(spark):
    vs, es = make(spark, 8, [(0, 2), (2, 4), (4, 8), (2, 6), (6, 8), (8, 10)])
    vs = vs.selectExpr("vid", "len", "case when vid = 3 then 30 else cov end as cov")
    kept, left, gone = clean.pop_bubbles(vs, es)
    assert gone == 1 and {r["vid"] for r in kept.collect()} == {0, 1, 3, 4, 5, 6, 7}


def test_crosslinks_and_order(spark):
    vs, es = make(spark, 4, [(0, 2, 50), (4, 6, 40), (0, 6, 3)])
    got = {(r["v"], r["w"]) for r in graph.without_weak_crosslinks(es).collect()}
    assert (0, 6) not in got and (7, 1) not in got and len(got) == 4
    assert {tuple(r) for r in graph.without_weak_crosslinks(es.repartition(5)).collect()} == {tuple(r) for r in graph.without_weak_crosslinks(es).collect()}


def test_empty_graph(spark):
    vs, es = make(spark, 3, [])
    es = spark.createDataFrame([], "v bigint, w bigint, ls bigint, cov bigint")
    assert graph.components(vs, es).count() == 3 and graph.degrees(vs, es).where("outdeg > 0").count() == 0
    members, table, arcs = chains.unitigs(vs, es)
    assert members.count() == 3 and arcs.count() == 0
    none = vs.limit(0)
    assert graph.components(none, es).count() == 0 and chains.unitigs(none, es)[1].count() == 0
    assert clean.cleaned(vs, es)[0].count() == 3 and graph.with_link_ids(es).count() == 0


def test_neighbourhood_and_paths(spark):
    vs, es = make(spark, 6, [(0, 2), (2, 4), (4, 6), (6, 0)])
    got = {r["vid"]: (r["step"], r["dist"]) for r in graph.neighbourhood(vs, es, vs.where("vid = 0"), 2).collect()}
    assert got == {0: (0, 0), 1: (1, 90), 3: (1, 90), 2: (2, 180)}
    got = graph.neighbourhood(vs, es, vs.where("vid = 0"), 9, 100)
    assert {r["vid"] for r in got.collect()} == {0, 1, 3}
    ask = spark.createDataFrame([(0, 6), (0, 10), (0, 1)], "source bigint, sink bigint")
    assert {r["sink"]: r["step"] for r in graph.path_exists(vs, es, ask, 5).collect()} == {6: 3, 10: None, 1: None}
