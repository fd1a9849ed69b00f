"""Queries and SQL of the operators on graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork import adapters as a
from braidwork.operators import chains, clean, coverage, graph
from braidwork.storage import materialize


def sym(spark, sf_dir):
    """The live arcs between known segments, in both directions, as a written table."""
    return materialize(graph.live_arcs(a.vertices(spark, sf_dir), graph.symmetric(a.arcs(spark, sf_dir))))[0]


def _place(spark, sf_dir):
    return graph.components(a.vertices(spark, sf_dir), sym(spark, sf_dir))


def _with(op):
    return lambda s, d: op(a.vertices(s, d), sym(s, d))


def _neighbourhood(s, d):
    v = a.vertices(s, d)
    return graph.neighbourhood(v, sym(s, d), v.where("vid % 50 = 0"), 4)


def _radius(s, d):
    v = a.vertices(s, d)
    return graph.neighbourhood(v, sym(s, d), v.where("vid % 50 = 0"), 6, 5000)


def _walks(s, d):
    v = a.vertices(s, d)
    pairs = v.where("vid % 50 = 0").select((F.col("vid") * 2).alias("source"), (F.col("vid") * 2 + 7).alias("sink"))
    return graph.path_exists(v, sym(s, d), pairs, 5)


def _unitig(part):
    return lambda s, d: chains.unitigs(a.vertices(s, d), sym(s, d))[part]


def _merged(s, d):
    v, e = a.vertices(s, d), sym(s, d)
    strong = v.where("cov >= 10"), e.where("cov >= 10")
    return graph.merged_graphs([strong, (v, e)], v, e)[1].select("v", "w", "cov")


def _duplicated(part):
    def run(s, d):
        v, e = a.vertices(s, d), sym(s, d)
        copies = v.select("vid", F.expr("least(cov div 30, 4)").cast("int").alias("copy"))
        got = graph.duplicated(v.select("vid", "len", "cov"), e, copies)[part]
        return got

    return run


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


_V = "v AS (SELECT vid, name, coalesce(len, length(seq), 0)::BIGINT AS len, coalesce(cov, 1)::BIGINT AS cov FROM segments)"
_E = f"""{_V}, raw AS (SELECT v, w, coalesce(max(ls), 0)::BIGINT AS ls, coalesce(max(cov), 0)::BIGINT AS cov FROM arcs WHERE del = false AND v IS NOT NULL AND w IS NOT NULL GROUP BY v, w),
two AS (SELECT * FROM raw UNION ALL SELECT xor(w, 1), xor(v, 1), ls, cov FROM raw WHERE w <> xor(v, 1)),
e AS (SELECT v, w, min(ls) AS ls, max(cov) AS cov FROM two WHERE v >> 1 IN (SELECT vid FROM v) AND w >> 1 IN (SELECT vid FROM v) GROUP BY v, w)"""
_CC = f"""{_E}, links AS (SELECT DISTINCT v >> 1 AS a, w >> 1 AS b FROM e),
cc(vid, cid) USING KEY (vid) AS (
  SELECT vid, vid AS cid FROM v
  UNION
  SELECT l.b AS vid, min(cc.cid) AS cid FROM cc JOIN links l ON l.a = cc.vid JOIN recurring.cc AS old ON old.vid = l.b WHERE cc.cid < old.cid GROUP BY l.b)"""
_SUMS = f"""{_CC}, s AS (SELECT cid, cov, sum(len) AS len, count(*) AS n FROM v JOIN cc USING (vid) GROUP BY ALL),
u AS (SELECT *, sum(len) OVER (PARTITION BY cid ORDER BY cov) AS upto, sum(len) OVER (PARTITION BY cid) AS total, sum(len * cov) OVER (PARTITION BY cid) AS mass FROM s)"""
_BOTH = "both_ways AS (SELECT vid * 2 AS v FROM v UNION ALL SELECT vid * 2 + 1 FROM v)"

QUERIES = {
    "g2_symmetric_arcs": lambda s, d: sym(s, d),
    "g2_link_ids": lambda s, d: graph.with_link_ids(sym(s, d)).select("v", "w", "link_id", "comp"),
    "j5_missing_twins": lambda s, d: graph.missing_twins(a.arcs(s, d).select("v", "w")).distinct(),
    "g3_degrees": _with(graph.degrees),
    "a15_capped_coverage": _with(graph.capped_coverage),
    "g10_without_weak_crosslinks": lambda s, d: graph.without_weak_crosslinks(sym(s, d)),
    "a19_graph_stats": lambda s, d: _rounded(graph.graph_stats(a.vertices(s, d), sym(s, d)), "mean_cov"),
    "g12_components": _place,
    "g12_component_stats": _with(graph.component_stats),
    "g11_neighbourhood": _neighbourhood,
    "g11_neighbourhood_radius": _radius,
    "g13_path_exists": _walks,
    "g14_strong_components": _with(graph.strong_components),
    "g4_unitigs": _unitig(1),
    "g4_unitig_members": _unitig(0),
    "g4_unitig_arcs": _unitig(2),
    "g5_end_probe": _with(chains.end_probe),
    "g6_arc_groups": lambda s, d: chains.arc_groups(sym(s, d)),
    "g8_bubbles_popped": lambda s, d: clean.pop_bubbles(a.vertices(s, d), sym(s, d))[0].select("vid"),
    "g9_tips_dropped": lambda s, d: clean.drop_tips(a.vertices(s, d), sym(s, d))[0].select("vid"),
    "g9_cleaned": lambda s, d: clean.cleaned(a.vertices(s, d), sym(s, d))[0].select("vid"),
    "g18_clones": _duplicated(0),
    "g18_clone_arcs": _duplicated(1),
    "g19_well_covered": lambda s, d: graph.well_covered(a.vertices(s, d), sym(s, d), 0.2)[0].select("vid"),
    "u3_merged_arcs": _merged,
    "u5_left_over": lambda s, d: graph.left_over(a.vertices(s, d), chains.unitigs(a.vertices(s, d), sym(s, d))[0].where("pos > 0").select(F.shiftright("v", 1).alias("vid")), 1000).select("vid"),
    "a20_coverage_bound": lambda s, d: _rounded(coverage.coverage_bound(a.vertices(s, d), _place(s, d)), "bound"),
    "a21_rough_coverage": lambda s, d: coverage.rough_coverage(a.vertices(s, d), _place(s, d)),
    "w5_coverage_clusters": lambda s, d: coverage.coverage_clusters(a.vertices(s, d), _place(s, d)),
    "a25_cluster_summary": lambda s, d: _rounded(coverage.cluster_summary(coverage.coverage_clusters(a.vertices(s, d), _place(s, d)), a.vertices(s, d)), "mean"),
    "a10_fenced_mean": lambda s, d: _rounded(coverage.fenced_mean(a.occurrences(s, d).select("kid", "idx"), "kid", "idx"), "mean"),
    "a11_unitig_coverage": lambda s, d: _rounded(coverage.unitig_coverage(chains.unitigs(a.vertices(s, d), sym(s, d))[0], a.vertices(s, d)), "cov"),
    "a22_covered_fraction": lambda s, d: _rounded(coverage.covered_fraction(chains.unitigs(a.vertices(s, d), sym(s, d))[0].withColumnRenamed("uid", "path_id"), a.vertices(s, d)), "fraction"),
}

SQL = {
    "g2_symmetric_arcs": f"WITH {_E} SELECT * FROM e",
    "g2_link_ids": f"""WITH {_E}, c AS (SELECT v, w, least({{'v': v, 'w': w}}, {{'v': xor(w, 1), 'w': xor(v, 1)}}) AS k FROM e)
SELECT v, w, dense_rank() OVER (ORDER BY k) - 1 AS link_id, (k.v, k.w) <> (v, w) AS comp FROM c""",
    "j5_missing_twins": "WITH r AS (SELECT DISTINCT v, w FROM arcs WHERE del = false AND v IS NOT NULL AND w IS NOT NULL) SELECT DISTINCT xor(w, 1) AS v, xor(v, 1) AS w FROM r WHERE w <> xor(v, 1) AND (xor(w, 1), xor(v, 1)) NOT IN (SELECT (v, w) FROM r)",
    "g3_degrees": f"WITH {_E}, {_BOTH}, o AS (SELECT v, count(*) AS n FROM e GROUP BY v) SELECT b.v, coalesce(o.n, 0) AS outdeg, coalesce(i.n, 0) AS indeg FROM both_ways b LEFT JOIN o ON o.v = b.v LEFT JOIN o i ON i.v = xor(b.v, 1)",
    "a15_capped_coverage": f"WITH {_E} SELECT e.v, e.w, ls, least(e.cov, x.cov, y.cov) AS cov FROM e JOIN v x ON x.vid = e.v >> 1 JOIN v y ON y.vid = e.w >> 1",
    "g10_without_weak_crosslinks": f"WITH {_E}, m AS (SELECT v, max(cov) AS top FROM e WHERE cov >= 10 GROUP BY v) SELECT e.* FROM e LEFT JOIN m x ON x.v = e.v LEFT JOIN m y ON y.v = xor(e.w, 1) WHERE NOT coalesce(e.cov < 0.3 * x.top AND e.cov < 0.3 * y.top, false)",
    "a19_graph_stats": f"""WITH {_E}, {_BOTH}, o AS (SELECT b.v, count(e.w) AS n FROM both_ways b LEFT JOIN e ON e.v = b.v GROUP BY b.v)
SELECT count(*) AS vertices, sum(len)::BIGINT AS bases, round(sum(len * cov) / sum(len), 6) AS mean_cov, max(len) AS longest, (SELECT sum(n)::BIGINT FROM o) AS arcs, (SELECT count(*) FROM o WHERE n = 0) AS dead_ends, (SELECT max(n) FROM o) AS max_degree FROM v""",
    "g12_components": f"WITH RECURSIVE {_CC} SELECT vid, cid FROM cc",
    "g12_component_stats": f"""WITH RECURSIVE {_CC}, l AS (SELECT cid, count(*) AS arcs FROM e JOIN cc ON cc.vid = e.v >> 1 GROUP BY cid)
SELECT cid, count(*) AS nv, sum(len)::BIGINT AS len, sum(len * cov)::BIGINT AS mass, coalesce(any_value(arcs), 0) AS arcs FROM v JOIN cc USING (vid) LEFT JOIN l USING (cid) GROUP BY cid""",
    "g11_neighbourhood": f"""WITH RECURSIVE {_E}, l AS (SELECT e.v >> 1 AS a, e.w >> 1 AS b, greatest(min(v.len - e.ls), 0)::BIGINT AS cost FROM e JOIN v ON v.vid = e.w >> 1 WHERE e.v >> 1 <> e.w >> 1 GROUP BY 1, 2),
r AS (SELECT vid, 0 AS step, 0::BIGINT AS dist FROM v WHERE vid % 50 = 0 UNION SELECT b, step + 1, dist + cost FROM r JOIN l ON l.a = r.vid WHERE step < 4)
SELECT vid, min(step)::INT AS step, min(dist)::BIGINT AS dist FROM r GROUP BY vid""",
    "g13_path_exists": f"""WITH RECURSIVE {_E}, q AS (SELECT vid * 2 AS source, vid * 2 + 7 AS sink FROM v WHERE vid % 50 = 0),
r AS (SELECT source, source AS at, 0 AS step FROM q UNION SELECT source, e.w, step + 1 FROM r JOIN e ON e.v = r.at WHERE step < 5)
SELECT q.source, q.sink, min(step)::INT AS step FROM q LEFT JOIN r ON r.source = q.source AND r.at = q.sink GROUP BY ALL""",
    "g18_clones": f"WITH {_V} SELECT vid, c::INT AS clone, len, cov // greatest(least(cov // 30, 4), 1) AS cov FROM v, range(0, greatest(least(cov // 30, 4), 1)) t(c)",
    "g18_clone_arcs": f"""WITH {_E}, c AS (SELECT vid, greatest(least(cov // 30, 4), 1) AS n FROM v), x AS (SELECT e.*, p.n AS pn, q.n AS qn FROM e JOIN c p ON p.vid = e.v >> 1 JOIN c q ON q.vid = e.w >> 1)
SELECT v, a::INT AS v_clone, w, b::INT AS w_clone, ls, cov // (pn * qn) AS cov FROM x, range(0, pn) t(a), range(0, qn) u(b)""",
    "g19_well_covered": f"WITH RECURSIVE {_CC}, m AS (SELECT cid, sum(len * cov) / nullif(sum(len), 0) AS mean FROM v JOIN cc USING (vid) GROUP BY cid) SELECT vid FROM v JOIN cc USING (vid) JOIN m USING (cid) WHERE cov >= 0.2::DOUBLE * coalesce(mean, 0)",
    "u3_merged_arcs": f"WITH {_E}, t AS (SELECT v, w, cov FROM e WHERE cov >= 10 UNION ALL SELECT v, w, cov FROM e), s AS (SELECT v, w, sum(cov) AS s FROM t GROUP BY ALL) SELECT e.v, e.w, least(s, cov)::BIGINT AS cov FROM s JOIN e USING (v, w)",
    "a20_coverage_bound": f"""WITH RECURSIVE {_SUMS}
SELECT cid, round(0.7::DOUBLE * sum(greatest(0, least(upto::DOUBLE, 0.3::DOUBLE * total) - (upto - len)) * cov) / (0.3::DOUBLE * max(total)), 6) AS bound FROM u WHERE total > 0 GROUP BY cid""",
    "a21_rough_coverage": f"""WITH RECURSIVE {_SUMS}, x AS (SELECT *, min(CASE WHEN upto > 0.7::DOUBLE * total THEN cov END) OVER (PARTITION BY cid) AS edge FROM u WHERE total > 0)
SELECT cid, cov AS rough FROM x WHERE cov > 0 AND 0.2::DOUBLE * cov <= edge QUALIFY row_number() OVER (PARTITION BY cid ORDER BY abs(mass::DOUBLE / cov - total), cov) = 1""",
    "a10_fenced_mean": """WITH o AS (SELECT DISTINCT rec_id, sid, idx, coalesce(rev, 0), h AS kid, s FROM syncmers WHERE del = false AND sid IS NOT NULL AND idx IS NOT NULL AND h IS NOT NULL),
q AS (SELECT kid, quantile_cont(idx::DOUBLE, 0.25) AS a, quantile_cont(idx::DOUBLE, 0.75) AS b FROM o GROUP BY kid)
SELECT kid, round(avg(idx), 6) AS mean FROM o JOIN q USING (kid) WHERE idx >= a - 1.5::DOUBLE * (b - a) AND idx <= b + 1.5::DOUBLE * (b - a) GROUP BY kid""",
}
