"""SQL for DuckDB of queries on unbranched paths, written from what they are, not from how they are computed here.

Lists are walked node by node in recursive tables; the operators rank them by doubling.
"""

from __future__ import annotations

from braidwork.plans.annotations import _H
from braidwork.plans.graphs import _BOTH, _CC, _E, _SUMS, _V
from braidwork.plans.sequences import _OCC, _RC


def walked(name: str, links: str) -> str:
    """Lists of ``links (node, next)`` as ``name(head, node, pos, circular)``; a circle begins at its smallest node."""
    return f"""{name}_line(head, node, pos) AS (
  SELECT node, node, 0::BIGINT FROM {links} WHERE node NOT IN (SELECT next FROM {links})
  UNION ALL SELECT c.head, t.next, c.pos + 1 FROM {name}_line c JOIN {links} t ON t.node = c.node),
{name}_round(head, node, pos) AS (
  SELECT node, node, 0::BIGINT FROM {links} WHERE node NOT IN (SELECT node FROM {name}_line)
  UNION ALL SELECT c.head, t.next, c.pos + 1 FROM {name}_round c JOIN {links} t ON t.node = c.node WHERE t.next <> c.head),
{name}(head, node, pos, circular) AS (
  SELECT head, node, pos, false FROM {name}_line
  UNION ALL SELECT head, node, pos, true FROM {name}_round WHERE head IN (SELECT head FROM {name}_round GROUP BY head HAVING min(node) = head))"""


def unbranched(arcs: str = "e", vertices: str = "v") -> str:
    """Unitigs of a symmetric graph: ``member (uid, pos, v)``, ``ends (uid, first, last)``, ``utg``, ``link``."""
    return f"""own AS (SELECT v, w, max(ls) AS ls, max(cov) AS cov FROM {arcs} GROUP BY v, w),
outs AS (SELECT v, count(*) AS n, min(w) AS w FROM own GROUP BY v),
thr AS (SELECT o.v AS node, o.w AS next FROM outs o JOIN outs i ON i.v = xor(o.w, 1) WHERE o.n = 1 AND i.n = 1 AND o.v >> 1 <> o.w >> 1),
{walked("ch", "thr")},
tails AS (SELECT head, max_by(node, pos) AS tail, max(pos) AS last, any_value(circular) AS circular FROM ch GROUP BY head),
member AS (
  SELECT ch.head >> 1 AS uid, pos, node AS v, ch.circular FROM ch JOIN tails t ON t.head = ch.head
  WHERE CASE WHEN ch.circular THEN ch.head % 2 = 0 ELSE ch.head < xor(t.tail, 1) END
  UNION ALL SELECT vid, 0, vid * 2, false FROM {vertices} WHERE vid NOT IN (SELECT node >> 1 FROM ch)),
ends AS (SELECT uid, min_by(v, pos) AS first, max_by(v, pos) AS last, count(*) AS n, bool_or(circular) AS circular FROM member GROUP BY uid),
utg AS (
  SELECT uid, ends.n, len, circular OR (ends.n = 1 AND uid IN (SELECT v >> 1 FROM own WHERE v = w)) AS circ
  FROM ends JOIN (SELECT m.uid, sum(x.len - coalesce(a.ls, 0))::BIGINT AS len FROM member m JOIN {vertices} x ON x.vid = m.v >> 1
    LEFT JOIN member b ON b.uid = m.uid AND b.pos = m.pos - 1 LEFT JOIN own a ON a.v = b.v AND a.w = m.v GROUP BY m.uid) USING (uid)),
stops AS (SELECT last AS at, uid * 2 AS u FROM ends UNION ALL SELECT xor(first, 1), uid * 2 + 1 FROM ends),
starts AS (SELECT first AS at, uid * 2 AS u FROM ends UNION ALL SELECT xor(last, 1), uid * 2 + 1 FROM ends),
link AS (SELECT x.u AS v, y.u AS w, ls, cov FROM own JOIN stops x ON x.at = own.v JOIN starts y ON y.at = own.w)"""


_U = f"WITH RECURSIVE {_E}, {unbranched()}"

#: Steps of unitigs as paths, in a row before their first place on it: what is cut off and where it begins.
_PLACED = """joined AS (SELECT m.uid AS path_id, m.pos, m.v, b.v AS before, x.name AS sname, x.len AS slen, x.cov, (m.v % 2)::INT AS rev, a.ls
  FROM member m JOIN v x ON x.vid = m.v >> 1 LEFT JOIN member b ON b.uid = m.uid AND b.pos = m.pos - 1 LEFT JOIN own a ON a.v = b.v AND a.w = m.v),
cut AS (SELECT *, CASE WHEN before IS NULL THEN 0 ELSE greatest(least(coalesce(ls, 0), slen), 0) END AS trim,
  CASE WHEN before IS NULL THEN 0 WHEN ls IS NULL THEN 100 ELSE greatest(-ls, 0) END AS gap FROM joined),
placed AS (SELECT *, (sum(slen - trim + gap) OVER (PARTITION BY path_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - slen + trim)::BIGINT AS "offset" FROM cut)"""
_LIFTED = f"""{_H}, {_PLACED}, good AS (SELECT *, least(alifrom, alito) AS lo, greatest(alifrom, alito) AS hi FROM hits WHERE evalue <= 1e-6 AND alifrom IS NOT NULL AND alito IS NOT NULL),
there AS (SELECT p.path_id, gname, score, strand, rev, "offset", lo, hi,
  greatest(CASE WHEN rev = 1 THEN slen - hi ELSE lo END, trim) - trim AS b, greatest(CASE WHEN rev = 1 THEN slen - lo ELSE hi END, trim) - trim AS f FROM good JOIN placed p USING (sname)),
lifted AS (SELECT path_id AS seq, gname, CASE WHEN (coalesce(strand, 0) <> 0) <> (rev = 1) THEN '-' ELSE '+' END AS strand,
  (b + "offset")::BIGINT AS start, (f + "offset")::BIGINT AS "end", least(round(score), 1000)::INT AS score FROM there WHERE 2 * (f - b) >= hi - lo)"""
_METRICS = """closing AS (SELECT p.uid AS path_id, a.ls FROM ends p JOIN own a ON a.v = p.last AND a.w = p.first),
metric AS (SELECT j.path_id, count(*) AS nv, sum(slen - coalesce(CASE WHEN before IS NULL THEN c.ls ELSE j.ls END, 0))::BIGINT AS len,
  sum((slen - coalesce(CASE WHEN before IS NULL THEN c.ls ELSE j.ls END, 0)) * cov)::DOUBLE AS wlen, any_value(c.path_id) IS NOT NULL AS circ
  FROM joined j LEFT JOIN closing c ON c.path_id = j.path_id GROUP BY j.path_id)"""
_CLUSTERS = f"""{_CC}, vals AS (SELECT cid, cov::DOUBLE AS cov, count(*) AS n, row_number() OVER (PARTITION BY cid ORDER BY cov) AS r FROM v JOIN cc USING (vid) GROUP BY cid, cov),
fold(cid, r, cov, clust, total, n) AS (
  SELECT cid, r, cov, 0, cov * n, n FROM vals WHERE r = 1
  UNION ALL SELECT x.cid, x.r, x.cov, CASE WHEN fits THEN clust ELSE clust + 1 END, CASE WHEN fits THEN total ELSE 0 END + x.cov * x.n, CASE WHEN fits THEN old ELSE 0 END + x.n
  FROM (SELECT y.cid, y.r, y.cov, y.n, f.clust, f.total, f.n AS old, y.cov <= f.cov * 1.25::DOUBLE AND y.cov <= f.total / f.n * 1.5::DOUBLE AS fits FROM fold f JOIN vals y ON y.cid = f.cid AND y.r = f.r + 1) x),
clustered AS (SELECT vid, cid, clust FROM v JOIN cc USING (vid) JOIN fold f USING (cid) WHERE f.cov = v.cov)"""
#: K-mers numbered in the order of their names, and their graph: arcs with a tenth of the smaller coverage.
_KGRAPH = f"""{_OCC}, known AS (SELECT kid, count(*) AS cov, row_number() OVER (ORDER BY kid) - 1 AS vid FROM occ GROUP BY kid),
v AS (SELECT vid, 1::BIGINT AS len, cov FROM known),
seen AS (SELECT sid, idx::BIGINT AS idx, vid * 2 + rev AS v FROM occ JOIN known USING (kid)),
steps AS (SELECT v, lead(v) OVER (PARTITION BY sid ORDER BY idx, v >> 1, v & 1) AS w FROM seen),
canon AS (SELECT CASE WHEN (v >> 1, v & 1, w >> 1, w & 1) <= (w >> 1, 1 - (w & 1), v >> 1, 1 - (v & 1)) THEN {{'v': v, 'w': w}} ELSE {{'v': xor(w, 1), 'w': xor(v, 1)}} END AS k FROM steps WHERE w IS NOT NULL),
counted AS (SELECT k.v AS v, k.w AS w, count(*) AS cov FROM canon GROUP BY ALL),
good AS (SELECT c.v, c.w, c.cov FROM counted c JOIN v a ON a.vid = c.v >> 1 JOIN v b ON b.vid = c.w >> 1 WHERE c.cov >= 0.1::DOUBLE * least(a.cov, b.cov)),
e AS (SELECT v, w, 0::BIGINT AS ls, cov FROM good UNION ALL SELECT xor(w, 1), xor(v, 1), 0, cov FROM good WHERE w <> xor(v, 1))"""
_INDEX = """sized AS (SELECT uid, count(*) AS n FROM member GROUP BY uid),
idx AS (SELECT m.v >> 1 AS vid, uid, m.v & 1 AS rev, pos, n, count(*) OVER (PARTITION BY m.v >> 1) AS times FROM member m JOIN sized USING (uid))"""
#: Tips and bubbles in terms of unitigs: those that aren't circles, on both strands, with what they weigh.
_PARTS = """weigh AS (SELECT m.uid, sum(x.len * x.cov) AS mass FROM member m JOIN v x ON x.vid = m.v >> 1 GROUP BY m.uid),
part AS (SELECT u.uid * 2 + s AS o, u.uid, u.len, mass FROM utg u JOIN weigh USING (uid), (VALUES (0), (1)) t(s) WHERE NOT circ),
ways AS (SELECT v, count(*) AS n, min(w) AS w FROM link GROUP BY v)"""

SQL = {
    "g4_unitig_members": f"{_U} SELECT uid, pos, v FROM member",
    "g4_unitigs": f"{_U} SELECT * FROM utg",
    "g4_unitig_arcs": f"{_U} SELECT * FROM link",
    "g5_end_probe": f"""{_U}, {_BOTH},
walk AS (SELECT b.v, coalesce(last - pos, 0) AS steps, coalesce(tail, b.v) AS tail, coalesce(ch.circular, false) AS circular FROM both_ways b LEFT JOIN ch ON ch.node = b.v LEFT JOIN tails t ON t.head = ch.head)
SELECT walk.v, steps, walk.tail, CASE WHEN circular THEN 'circle' WHEN o.n IS NULL THEN 'tip' WHEN o.n > 1 THEN 'multi_out' WHEN coalesce(i.n, 0) > 1 THEN 'multi_nei' ELSE 'turn' END AS kind
FROM walk LEFT JOIN outs o ON o.v = walk.tail LEFT JOIN outs i ON i.v = xor(o.w, 1)""",
    "g6_arc_groups": f"""WITH RECURSIVE {_E}, p AS (SELECT DISTINCT v, w FROM e), k AS (SELECT v, w, row_number() OVER (ORDER BY v, w) AS i FROM p),
o AS (SELECT v FROM p GROUP BY v HAVING count(*) = 1), simple AS (SELECT v FROM o WHERE xor(v, 1) IN (SELECT v FROM o)),
follow AS (SELECT a.i AS node, b.i AS next FROM k a JOIN simple s ON s.v = a.w JOIN k b ON b.v = s.v WHERE a.i <> b.i), {walked("run", "follow")}
SELECT k.v, k.w, h.v AS head_v, h.w AS head_w FROM k LEFT JOIN run ON run.node = k.i JOIN k h ON h.i = coalesce(run.head, k.i)""",
    "g8_bubbles_popped": f"""{_U}, {_PARTS},
way AS (SELECT p.o, p.uid, p.mass, xor(y.w, 1) AS start, x.w AS fin FROM part p JOIN ways x ON x.v = p.o AND x.n = 1 JOIN ways y ON y.v = xor(p.o, 1) AND y.n = 1 WHERE p.len <= 100000),
one AS (SELECT * FROM way WHERE start <> fin AND start >> 1 <> uid AND fin >> 1 <> uid AND (start < xor(fin, 1) OR (start = xor(fin, 1) AND o % 2 = 0))),
lost AS (SELECT uid FROM one QUALIFY row_number() OVER (PARTITION BY start, fin ORDER BY mass DESC, uid) > 1)
SELECT vid FROM v WHERE vid NOT IN (SELECT m.v >> 1 FROM member m JOIN lost USING (uid))""",
    "g9_tips_dropped": f"""{_U}, {_PARTS},
lost AS (SELECT DISTINCT p.uid FROM part p JOIN link l ON l.w = p.o JOIN ways f ON f.v = l.v AND f.n > 1 WHERE p.len <= 10000 AND p.o NOT IN (SELECT v FROM ways))
SELECT vid FROM v WHERE vid NOT IN (SELECT m.v >> 1 FROM member m JOIN lost USING (uid))""",
    "u5_left_over": f"{_U} SELECT vid FROM v WHERE len >= 1000 AND vid NOT IN (SELECT v >> 1 FROM member WHERE pos > 0)",
    "g17_member_index": f"{_U}, {_INDEX} SELECT * FROM idx",
    "a11_unitig_coverage": f"""{_U}, c AS (SELECT uid, x.cov FROM member m JOIN v x ON x.vid = m.v >> 1),
q AS (SELECT uid, quantile_cont(cov::DOUBLE, 0.25) AS a, quantile_cont(cov::DOUBLE, 0.75) AS b FROM c GROUP BY uid)
SELECT uid, round(avg(cov), 6) AS cov FROM c JOIN q USING (uid) WHERE cov >= a - 1.5::DOUBLE * (b - a) AND cov <= b + 1.5::DOUBLE * (b - a) GROUP BY uid""",
    "a22_covered_fraction": f"{_U} SELECT uid AS path_id, round(sum(len) / (SELECT sum(len) FROM v), 6) AS fraction FROM (SELECT DISTINCT uid, v >> 1 AS vid FROM member) JOIN v USING (vid) GROUP BY uid",
    "j9_hits_on_paths": f"{_U}, {_LIFTED} SELECT * FROM lifted",
    "k4_bed_lines": f"""{_U}, {_LIFTED} SELECT concat_ws(chr(9), seq, start, "end", gname, score, strand) AS value FROM lifted""",
    "c4_path_metrics": f"{_U}, {_PLACED}, {_METRICS} SELECT path_id, nv, len, round(wlen, 3) AS wlen, circ FROM metric",
    "c5_path_order": f"""{_U}, {_PLACED}, {_METRICS}, walk AS (SELECT uid AS path_id, list(v ORDER BY pos) AS walk FROM member GROUP BY uid),
r AS (SELECT path_id, circ, row_number() OVER o AS top, row_number() OVER (PARTITION BY circ ORDER BY wlen DESC, len DESC, nv DESC, walk, path_id) AS own FROM metric JOIN walk USING (path_id)
  WINDOW o AS (ORDER BY wlen DESC, len DESC, circ DESC, nv DESC, walk, path_id))
SELECT path_id, own = 1 AND (circ OR top = 1) AS best FROM r""",
    "seq_p12_path_sequences": f"""{_U}, {_PLACED},
piece AS (SELECT path_id, pos, repeat('N', gap) || substr(CASE WHEN rev = 1 THEN {_RC.format("known")} ELSE known END, trim + 1) AS s
  FROM (SELECT p.*, coalesce(g.seq, repeat('N', slen)) AS known FROM placed p JOIN segments g ON g.vid = p.v >> 1))
SELECT path_id, string_agg(s, '' ORDER BY pos) AS seq, sum(length(s))::BIGINT AS len FROM piece GROUP BY path_id""",
    "g14_strong_components": f"""WITH RECURSIVE {_E}, {_BOTH}, p AS (SELECT DISTINCT v, w FROM e),
r(a, b) AS (SELECT v, w FROM p UNION SELECT r.a, p.w FROM r JOIN p ON p.v = r.b)
SELECT x.v, coalesce((SELECT max(f.b) FROM r f JOIN r g ON g.a = f.b AND g.b = f.a WHERE f.a = x.v), x.v) AS scc FROM both_ways x""",
    "g11_neighbourhood_radius": f"""WITH RECURSIVE {_E}, l AS (SELECT e.v >> 1 AS a, e.w >> 1 AS b, greatest(min(v.len - e.ls), 0)::BIGINT AS cost FROM e JOIN v ON v.vid = e.w >> 1 WHERE e.v >> 1 <> e.w >> 1 GROUP BY 1, 2),
r AS (SELECT vid, 0 AS step, 0::BIGINT AS dist FROM v WHERE vid % 50 = 0 UNION SELECT b, step + 1, dist + cost FROM r JOIN l ON l.a = r.vid WHERE step < 6 AND dist + cost <= 5000)
SELECT vid, min(step)::INT AS step, min(dist)::BIGINT AS dist FROM r GROUP BY vid""",
    "w5_coverage_clusters": f"WITH RECURSIVE {_CLUSTERS} SELECT vid, cid, clust::INT AS clust FROM clustered",
    "a25_cluster_summary": f"WITH RECURSIVE {_CLUSTERS} SELECT cid, clust::INT AS clust, count(*) AS n, sum(len)::BIGINT AS size, round(avg(cov), 6) AS mean FROM clustered JOIN v USING (vid) GROUP BY cid, clust",
    "c1_copy_numbers": f"""WITH RECURSIVE {_SUMS},
bound AS (SELECT cid, 0.7::DOUBLE * sum(greatest(0, least(upto::DOUBLE, 0.3::DOUBLE * total) - (upto - len)) * cov) / (0.3::DOUBLE * max(total)) AS least FROM u WHERE total > 0 GROUP BY cid),
x AS (SELECT *, min(CASE WHEN upto > 0.7::DOUBLE * total THEN cov END) OVER (PARTITION BY cid) AS edge FROM u WHERE total > 0),
rough AS (SELECT cid, cov AS rough FROM x WHERE cov > 0 AND 0.2::DOUBLE * cov <= edge QUALIFY row_number() OVER (PARTITION BY cid ORDER BY abs(mass::DOUBLE / cov - total), cov) = 1),
fit(cid, i, average, least) AS (
  SELECT cid, 0, greatest(coalesce(rough::DOUBLE, least), least), least FROM bound LEFT JOIN rough USING (cid)
  UNION ALL SELECT cid, i + 1, now, least FROM (
    SELECT f.cid, f.i, f.average, f.least, greatest(sum(s.len * s.cov)::DOUBLE / nullif(sum(s.len * greatest(1, least(10, coalesce(round(s.cov / nullif(f.average, 0)), 1)))), 0), f.least) AS now
    FROM fit f JOIN s ON s.cid = f.cid WHERE f.i < 1000 GROUP BY f.cid, f.i, f.average, f.least) WHERE abs(now - average) >= 1.1920929e-7),
final AS (SELECT cid, max_by(average, i) AS average FROM fit GROUP BY cid)
SELECT vid, cc.cid, greatest(1, least(10, coalesce(round(cov / nullif(average, 0)), 1)))::INT AS copy, round(average, 6) AS average FROM v JOIN cc USING (vid) LEFT JOIN final ON final.cid = cc.cid""",
    "e2_error_kmers": f"""WITH {_KGRAPH}, side AS (SELECT e.v, bool_or(e.cov >= 2 AND e.cov >= 0.1::DOUBLE * least(a.cov, b.cov)) AS fine FROM e JOIN v a ON a.vid = e.v >> 1 JOIN v b ON b.vid = e.w >> 1 GROUP BY e.v)
SELECT vid, cov, (cov < 3 OR vid IN (SELECT v >> 1 FROM side WHERE NOT fine)) AND cov < 30 AS del FROM v""",
    "j4_seeds": f"""WITH RECURSIVE {_KGRAPH}, {unbranched()}, {_INDEX}
SELECT sid, uid * 2 + xor(s.v & 1, rev) AS uid, s.idx::INT AS s, (CASE WHEN s.v & 1 <> rev THEN n - 1 - pos ELSE pos END)::INT AS u, n::INT AS n FROM seen s JOIN idx ON idx.vid = s.v >> 1""",
    "a14_refined_coverage": f"""WITH RECURSIVE {_KGRAPH}, {unbranched()}, c AS (SELECT uid, x.cov FROM member m JOIN v x ON x.vid = m.v >> 1),
fence AS (SELECT uid, quantile_cont(cov::DOUBLE, 0.25) AS a, quantile_cont(cov::DOUBLE, 0.75) AS b FROM c GROUP BY uid),
cover AS (SELECT uid, floor(avg(cov))::BIGINT AS cov FROM c JOIN fence USING (uid) WHERE cov >= a - 1.5::DOUBLE * (b - a) AND cov <= b + 1.5::DOUBLE * (b - a) GROUP BY uid),
strand AS (SELECT uid * 2 AS u, first AS head, last AS tail, cov FROM ends JOIN cover USING (uid) UNION ALL SELECT uid * 2 + 1, xor(last, 1), xor(first, 1), cov FROM ends JOIN cover USING (uid)),
one AS (SELECT l.v, l.w, l.cov, x.cov AS cv, y.cov AS cw, x.tail AS a, y.head AS b, (x.cov + y.cov) // 2 AS part FROM link l JOIN strand x ON x.u = l.v JOIN strand y ON y.u = l.w WHERE (l.v, l.w) <= (xor(l.w, 1), xor(l.v, 1))),
keyed AS (SELECT *, CASE WHEN a <= b THEN {{'a': a, 'b': b}} ELSE {{'a': xor(b, 1), 'b': xor(a, 1)}} END AS k FROM one),
inside AS (SELECT CASE WHEN m.v <= o.v THEN {{'a': m.v, 'b': o.v}} ELSE {{'a': xor(o.v, 1), 'b': xor(m.v, 1)}} END AS k, cov AS part FROM member m JOIN member o ON o.uid = m.uid AND o.pos = m.pos + 1 JOIN cover ON cover.uid = m.uid),
whole AS (SELECT k, sum(part) AS total, count(*) AS places FROM (SELECT k, part FROM keyed UNION ALL SELECT k, part FROM inside) GROUP BY k),
new AS (SELECT v, w, least(CASE WHEN places = 1 OR total = 0 THEN cov ELSE round(cov / total * part) END, cv, cw)::BIGINT AS cov FROM keyed JOIN whole USING (k))
SELECT * FROM new UNION ALL SELECT xor(w, 1), xor(v, 1), cov FROM new WHERE w <> xor(v, 1)""",
}
