"""Queries and SQL of the operators on annotation hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork import adapters as a
from braidwork.operators import annotation as n
from braidwork.operators import chains, graph
from braidwork.plans.graphs import _CC, _V, sym
from braidwork.storage import materialize

RULES = n.ClassRules(core_genes=5, min_score=100.0)


def _best(s, d):
    return n.best_genes(n.of_segments(n.considered(a.hits(s, d), RULES), a.vertices(s, d)), "vid")


def _classes(s, d):
    place, _ = materialize(graph.components(a.vertices(s, d), sym(s, d)))
    found, genes = n.component_classes(a.hits(s, d), a.vertices(s, d), place, RULES)
    return materialize(found)[0], materialize(genes)[0]


def _two_best(s, d):
    scores = n.type_scores(_best(s, d), "vid", RULES.core_genes)
    each = [F.max(F.when(F.col("og_type") == t, F.col("score"))).alias(f"s{t}") for t in range(4)]
    wide = scores.groupBy("vid").agg(*each)
    return wide.select("vid", n.two_best([F.col(f"s{t}") for t in range(4)]).alias("b")).select("vid", "b.best", F.round("b.score", 6).alias("score"), "b.next", F.round("b.sscore", 6).alias("sscore"))


def path_steps(s, d):
    """Unitigs as paths over named segments, with what each step cuts off and where it begins."""
    v, e = a.vertices(s, d), sym(s, d)
    members = chains.unitigs(v, e)[0]
    return n_steps(members, v, e)


def n_steps(members, vertices, arcs):
    from braidwork.operators.paths import placed_steps

    return placed_steps(members.withColumnRenamed("uid", "path_id"), vertices, arcs)


def _lifted(s, d):
    return n.lifted(n.in_order(a.hits(s, d)), path_steps(s, d))


def _lifted_alone(s, d):
    """Hits of segments read backwards after 100 bases: the lift without a path."""
    v = a.vertices(s, d)
    steps = v.select(F.col("vid").alias("path_id"), F.col("name").alias("sname"), F.col("len").alias("slen"), F.lit(1).alias("rev"), F.lit(100).alias("trim"), F.lit(7).alias("offset"))
    return n.lifted(n.in_order(a.hits(s, d)), steps, n.MITO, 1e-3)


_H = """hits AS (SELECT DISTINCT hit_id, gname, sname, hmmfrom, hmmto, alifrom, alito, envfrom, envto, modlen, strand, evalue, score, bias, og_type FROM annot
  WHERE gname IS NOT NULL AND sname IS NOT NULL AND score IS NOT NULL AND NOT isnan(score))"""
_USED = "used AS (SELECT * FROM hits WHERE evalue <= 1e-6 AND NOT starts_with(gname, 'trn') AND NOT starts_with(gname, 'rrn'))"
_BEST = f"{_H}, {_V}, {_USED}, best AS (SELECT vid, og_type, gname, max(score) AS score FROM used JOIN v ON v.name = used.sname GROUP BY ALL)"
_SCORES = """scores AS (SELECT {0}, og_type, sum(greatest(score, 0)) AS score FROM (SELECT *, row_number() OVER (PARTITION BY {0}, og_type ORDER BY greatest(score, 0) DESC, gname) AS r FROM best) WHERE r <= 5 GROUP BY ALL),
wide AS (SELECT {0}, list_sort([{{'n': -coalesce(max(score) FILTER (og_type = 0), 0), 'i': 0}}, {{'n': -coalesce(max(score) FILTER (og_type = 1), 0), 'i': 1}}, {{'n': -coalesce(max(score) FILTER (og_type = 2), 0), 'i': 2}}, {{'n': -coalesce(max(score) FILTER (og_type = 3), 0), 'i': 3}}]) AS b FROM scores GROUP BY {0})"""
_CLASS = "CASE WHEN coalesce(-b[1].n, 0) >= 100 {0} THEN CASE WHEN b IS NOT NULL AND b[1].n <> b[2].n THEN b[1].i ELSE 0 END ELSE 0 END"
_COMP = f"""{_CC}, {_H}, {_USED},
best AS (SELECT cid, og_type, gname, max(score) AS score FROM used JOIN v ON v.name = used.sname JOIN cc USING (vid) GROUP BY ALL), {_SCORES.format("cid")},
sizes AS (SELECT cid, sum(len)::BIGINT AS len FROM v JOIN cc USING (vid) GROUP BY cid),
found AS (SELECT cid, {_CLASS.format("OR len >= 10000")} AS og_type, coalesce(-b[1].n, 0) AS score, coalesce(-b[2].n, 0) AS sscore, len FROM sizes LEFT JOIN wide USING (cid)),
genes AS (SELECT cid, og_type, gname, floor(score)::BIGINT AS score FROM best)"""
_OWN = """own AS (SELECT cid, count(*) FILTER (og_type = 1) AS m, count(*) FILTER (og_type = 2) AS p FROM (
  SELECT g.og_type, g.gname, min(g.cid) AS cid FROM genes g JOIN (SELECT og_type, gname, max(score) AS top FROM genes GROUP BY ALL) t ON t.og_type = g.og_type AND t.gname = g.gname
  WHERE g.score >= 0.8::DOUBLE * top GROUP BY ALL HAVING count(*) = 1) GROUP BY cid)"""
_R = lambda *c: ", ".join(f"round({x}, 6) AS {x}" for x in c)


def _round(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


QUERIES = {
    "f6_considered_hits": lambda s, d: n.considered(a.hits(s, d), RULES).select("hit_id", "gname", "sname"),
    "j8_hits_on_segments": lambda s, d: n.of_segments(a.hits(s, d), a.vertices(s, d)).select("hit_id", "vid", "slen"),
    "o2_ordered_hits": lambda s, d: n.ordered(a.hits(s, d), "segment_place").select("hit_id", "sname", "alifrom", "alito"),
    "ann_p14_rna_genes": lambda s, d: a.hits(s, d).groupBy("gname").agg(F.count(F.lit(1)).alias("n")).select("gname", n.is_transfer_rna("gname").alias("trn"), n.is_ribosomal_rna("gname").alias("rrn"), "n"),
    "a17_segment_scores": lambda s, d: _round(n.type_scores(_best(s, d), "vid", RULES.core_genes), "score"),
    "a18_component_genes": lambda s, d: _classes(s, d)[1],
    "a28_gene_table": lambda s, d: _round(n.gene_table(_classes(s, d)[1]), "score", "total"),
    "o8_two_best_types": _two_best,
    "l1_segment_classes": lambda s, d: _round(n.segment_classes(a.hits(s, d), a.vertices(s, d), RULES), "score", "sscore"),
    "l2_component_classes": lambda s, d: _round(_classes(s, d)[0], "score", "sscore"),
    "l3_own_genes": lambda s, d: n.own_genes(_classes(s, d)[1]),
    "l3_repaired_classes": lambda s, d: _round(n.repaired(*_classes(s, d), RULES), "score", "sscore"),
    "k5_classification_summary": lambda s, d: _round(n.classification_summary(_classes(s, d)[0]), "best"),
    "j9_hits_on_paths": _lifted,
    "f8_hits_lifted": _lifted_alone,
}

SQL = {
    "f6_considered_hits": f"WITH {_H}, {_USED} SELECT hit_id, gname, sname FROM used",
    "j8_hits_on_segments": f"WITH {_H}, {_V} SELECT hit_id, vid, len AS slen FROM hits JOIN v ON v.name = hits.sname",
    "o2_ordered_hits": f"WITH {_H} SELECT hit_id, sname, alifrom, alito FROM hits ORDER BY sname, alifrom NULLS LAST, alito NULLS LAST, hit_id",
    "ann_p14_rna_genes": f"WITH {_H} SELECT gname, starts_with(gname, 'trn') AS trn, starts_with(gname, 'rrn') AS rrn, count(*) AS n FROM hits GROUP BY gname",
    "a17_segment_scores": f"WITH {_BEST}, {_SCORES.format('vid')} SELECT vid, og_type, round(score, 6) AS score FROM scores",
    "a18_component_genes": f"WITH RECURSIVE {_COMP} SELECT * FROM genes",
    "a28_gene_table": f"WITH RECURSIVE {_COMP}, t AS (SELECT og_type, gname, max(score) AS score FROM genes GROUP BY ALL) SELECT og_type, gname, score, sum(score) OVER (PARTITION BY og_type)::BIGINT AS total FROM t",
    "o8_two_best_types": f"WITH {_BEST}, {_SCORES.format('vid')} SELECT vid, b[1].i AS best, round(-b[1].n, 6) AS score, b[2].i AS next, round(-b[2].n, 6) AS sscore FROM wide",
    "l1_segment_classes": f"WITH {_BEST}, {_SCORES.format('vid')}, x AS (SELECT vid, {_CLASS.format('')} AS og_type, coalesce(-b[1].n, 0) AS score, coalesce(-b[2].n, 0) AS sscore, len FROM v LEFT JOIN wide USING (vid)) SELECT vid, og_type, {_R('score', 'sscore')}, len FROM x",
    "l2_component_classes": f"WITH RECURSIVE {_COMP} SELECT cid, og_type, {_R('score', 'sscore')}, len FROM found",
    "l3_own_genes": f"WITH RECURSIVE {_COMP}, {_OWN} SELECT cid, m AS mito_genes, p AS pltd_genes FROM own",
    "l3_repaired_classes": f"""WITH RECURSIVE {_COMP}, {_OWN},
b AS (SELECT cid AS best FROM found WHERE og_type = 2 AND len >= 80000 ORDER BY len <= 250000 DESC, score DESC, cid LIMIT 1),
x AS (SELECT f.*, coalesce(best IS NOT NULL AND f.cid <> best AND og_type = 2 AND NOT (coalesce(p, 0) > 5 * coalesce(m, 0) OR score > 5 * sscore) AND (score < 3 * sscore OR len NOT BETWEEN 80000 AND 250000), false) AS c FROM found f LEFT JOIN b ON true LEFT JOIN own USING (cid))
SELECT cid, CASE WHEN c THEN CASE WHEN sscore > 0 THEN 1 ELSE 0 END ELSE og_type END AS og_type, round(CASE WHEN c THEN sscore ELSE score END, 6) AS score, round(CASE WHEN c THEN score ELSE sscore END, 6) AS sscore, len FROM x""",
    "k5_classification_summary": f"WITH RECURSIVE {_COMP} SELECT og_type, count(*) AS components, sum(len)::BIGINT AS bases, round(max(score), 6) AS best FROM found GROUP BY og_type",
    "f8_hits_lifted": f"""WITH {_H}, {_V}, x AS (SELECT vid, gname, strand, score, least(alifrom, alito) AS lo, greatest(alifrom, alito) AS hi, greatest(len - greatest(alifrom, alito), 100) - 100 AS b, greatest(len - least(alifrom, alito), 100) - 100 AS e
  FROM hits JOIN v ON v.name = hits.sname WHERE og_type = 1 AND evalue <= 1e-3 AND alifrom IS NOT NULL AND alito IS NOT NULL)
SELECT vid AS seq, gname, CASE WHEN (coalesce(strand, 0) <> 0) <> true THEN '-' ELSE '+' END AS strand, b + 7 AS start, e + 7 AS "end", least(round(score), 1000)::INT AS score FROM x WHERE 2 * (e - b) >= hi - lo""",
}
