"""Queries and SQL of readers, writers and smaller operators: files written and read again, paths as text, orders, consensus."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from braidwork import adapters as a
from braidwork.functions import sequence as q
from braidwork.operators import align, annotation, chains, coverage, graph, occurrence, organelle, overlap, paths, skew, syncmer
from braidwork.operators.ordered import numbered
from braidwork.plans import assemble
from braidwork.plans.annotations import _BEST
from braidwork.plans.assembly import _folder, name_pairs
from braidwork.plans.graphs import _E, _V, sym
from braidwork.plans.oracles import _CLUSTERS, _METRICS, _PLACED, _U
from braidwork.plans.sequences import _CODE, _HOCO, _OCC, _RC, _RUNS, compressed
from braidwork.sinks import lines
from braidwork.sources import gfa, hits
from braidwork.storage import materialize
from braidwork.tables import table


def _walks(s, d):
    """Unitigs as paths: path_id, walk (oriented segments)."""
    members = chains.unitigs(a.vertices(s, d), sym(s, d))[0]
    return members.groupBy(F.col("uid").alias("path_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("walk"))


def _path_text(s, d):
    members = chains.unitigs(a.vertices(s, d), sym(s, d))[0]
    named = members.withColumn("vid", F.shiftright("v", 1)).join(a.vertices(s, d).select("vid", "name"), "vid")
    entry = F.concat("name", F.when(F.col("v") % 2 == 1, "-").otherwise("+"))
    parts = named.groupBy(F.col("uid").alias("path_id")).agg(F.sort_array(F.collect_list(F.struct("pos", entry.alias("s")))).alias("p"))
    return parts.select("path_id", F.array_join(F.transform("p", lambda x: x["s"]), ",").alias("path"))


def _parsed(s, d):
    got = _path_text(s, d).select("path_id", F.posexplode(q.path_steps("path")).alias("pos", "x"))
    return got.select("path_id", "pos", "x.name", "x.rev")


def _turned(s, d):
    both = F.arrays_zip(q.reverse_path("walk").alias("back"), q.rotate_left("walk", 2).alias("rotated"))
    got = _walks(s, d).select("path_id", F.posexplode(both).alias("pos", "x"))
    return got.select("path_id", "pos", "x.back", "x.rotated")


def _tags(s, d):
    fields = F.split("value", "\t")
    rest = F.slice(fields, 4, F.size(fields))
    rows = lines.segment_lines(a.vertices(s, d))
    return rows.select("vid", gfa.tag(rest, "LN:i").cast("bigint").alias("len"), gfa.tag(rest, "KC:i").cast("bigint").alias("mass"), gfa.valid_tags(rest).alias("ok"))


_TEXT = ["gname", "sname", "hmmfrom", "hmmto", "alifrom", "alito", "envfrom", "envto", "modlen", "evalue", "score", "bias"]


def _through_table(s, d):
    """Hits with all their columns written as a table of profile hits, where the reverse strand has the larger limit first, and read again."""
    rows = a.hits(s, d).dropna(subset=[*_TEXT, "strand"])
    back = F.col("strand") != 0
    text = {c: F.col(c).cast("string") for c in _TEXT}
    for x, y in (("alifrom", "alito"), ("envfrom", "envto")):
        low, high = F.least(x, y).cast("string"), F.greatest(x, y).cast("string")
        text[x], text[y] = F.when(back, high).otherwise(low), F.when(back, low).otherwise(high)
    text["strand"] = F.when(back, "-").otherwise("+")
    value = F.concat_ws("  ", *[text[c] if c else F.lit("-") for c in hits.COLUMNS])
    path = _folder(s, "hits")
    lines.write_lines(rows.select(value.alias("value")), path)
    return hits.read_hits(s, path, annotation.MITO).select("gname", "sname", "alifrom", "alito", "envfrom", "envto", "strand", "evalue", "score")


def _through_list(s, d):
    rows = a.vertices(s, d).where("len > 0")
    text = F.concat_ws("\t", "name", (F.col("vid") % F.col("len") + 1).cast("string"), F.when(F.col("vid") % 3 == 0, "-").when(F.col("vid") % 3 == 1, "+"))
    path = _folder(s, "rotations")
    lines.write_lines(rows.select(text.alias("value")), path)
    return hits.read_rotations(s, path)


def _genes(s, d):
    return annotation.best_genes(annotation.of_segments(annotation.considered(a.hits(s, d)), a.vertices(s, d)), "vid")


def _cluster_types(s, d):
    v = a.vertices(s, d)
    clusters, _ = materialize(coverage.coverage_clusters(v, materialize(graph.components(v, sym(s, d)))[0]))
    return organelle.cluster_types(clusters, _genes(s, d), v, organelle.gene_counts(_genes(s, d), min_score=100.0))


def _gene_order(s, d):
    """Ranks of the first gene of segments along unitigs; a rank belongs to one segment, the smallest, of a unitig."""
    first = _genes(s, d).groupBy("vid").agg(F.min("gname").alias("gname"))
    members = chains.unitigs(a.vertices(s, d), sym(s, d))[0].withColumn("vid", F.shiftright("v", 1)).join(first, "vid")
    marks = members.groupBy(F.col("uid").alias("path_id"), F.col("gname").alias("rank")).agg(F.min("pos").alias("pos"))
    return paths.order_correlation(marks).withColumn("rho", F.round("rho", 6))


def _consensus(s, d):
    reads = table(s, d, "reads").where("seq is not null").select("sid", q.compress_runs("seq").alias("seq"), q.run_lengths("seq").alias("lengths"))
    reads, _ = materialize(reads)
    occ, _ = materialize(syncmer.closed_syncmers(reads, 15, 5))
    kmers = assemble._kmer_vertices(occ)
    seen = occ.join(kmers.select("kmer", F.col("vid").alias("kid")), "kmer").select("sid", "pos", "rev", "kid")
    got = overlap.run_consensus(seen, reads.select("sid", "lengths"), kmers.select(F.col("vid").alias("kid"), "kmer"), 15)
    return overlap.consensus_sequence(got).join(got.select("kid", "kmer"), "kid").select("kmer", "seq")


def _fasta(s, d):
    v, e = a.vertices(s, d), sym(s, d)
    members, _ = materialize(chains.unitigs(v, e)[0].withColumnRenamed("uid", "path_id"))
    m, _ = materialize(paths.path_metrics(members, v, e))
    own = numbered(m.select("path_id"), ["path_id"], "number")
    named = _path_text(s, d).withColumnRenamed("path", "walk")
    rows = m.join(own, "path_id").join(named, "path_id").join(paths.path_sequences(members, v, e).select("path_id", "seq"), "path_id")
    return paths.fasta_lines(rows)


def _waves(s, d):
    """All pairs of gene names by the own edit distance."""
    pairs, _ = materialize(numbered(name_pairs(s, d), ["a", "b"], "k"))
    return align.edit_alignments(pairs, "a", "b", "k", 1000).select("k", "score").join(pairs, "k").select("a", "b", "score")


def _blocks(s, d):
    """Common blocks of the k-mers of each read and the next one."""
    occ = a.occurrences(s, d).groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "kid", "rev"))), lambda x: x["kid"]).alias("x"))
    pairs = occ.select("sid", "x", (F.col("sid") + 1).alias("other")).join(occ.select(F.col("sid").alias("other"), F.col("x").alias("y")), "other")

    def run(frames):
        for f in frames:
            got = [(sid, *b) for sid, x, y in zip(f["sid"], f["x"], f["y"]) for b in align.common_blocks(list(x), list(y))]
            yield pd.DataFrame(got, columns=["sid", "a_beg", "a_end", "b_beg", "b_end"])

    return pairs.select("sid", "x", "y").mapInPandas(run, "sid bigint, a_beg int, a_end int, b_beg int, b_end int")


QUERIES = {
    "w3_reads_at_least": lambda s, d: occurrence.reads_at_least(a.occurrences(s, d)),
    "w6_gene_order": _gene_order,
    "seq_p9_path_steps": _parsed,
    "seq_p10_turned_paths": _turned,
    "p13_quantiles": lambda s, d: skew.key_quantiles(a.occurrences(s, d), "kid", "idx", [0.25, 0.75]).select("kid", F.round("q0", 6).alias("q1"), F.round("q1", 6).alias("q3")),
    "s7_tags": _tags,
    "s10_hits_through_table": _through_table,
    "s12_rotations_through_list": _through_list,
    "a27_any_kmer": lambda s, d: a.occurrences(s, d).select("kid").limit(1).agg((F.count(F.lit(1)) > 0).alias("some")),
    "l4_gene_counts": lambda s, d: organelle.gene_counts(_genes(s, d), min_score=100.0),
    "l4_cluster_types": _cluster_types,
    "a7_consensus": _consensus,
    "k3_fasta_lines": _fasta,
    "e1_wave_scores": _waves,
    "e8_common_blocks": _blocks,
    "o1_ordered_arcs": lambda s, d: sym(s, d).orderBy("v", "w"),
    "o11_kmers_by_name": lambda s, d: occurrence.kmer_table(a.occurrences(s, d)).select("kid", "cov").orderBy("kid"),
}

_W1 = f"""h AS (SELECT sid, {_HOCO} AS seq, list_transform({_RUNS}, lambda r: length(r)::INT) AS runs FROM reads WHERE seq IS NOT NULL),
w AS (SELECT sid, i::INT AS pos, substr(seq, i + 1, {{s}}) AS f, reverse(translate(substr(seq, i + 1, {{s}}), 'ACGT', 'TGCA')) AS r FROM h, range(0, length(seq) - {{s}} + 1) t(i)),
c AS (SELECT sid, pos, CASE WHEN f <> r THEN {_CODE.format("least(f, r)")} END AS code FROM w),
m1 AS (SELECT *, (((-1 - code) + (code << 21)) & {{m}}) AS a FROM c), m2 AS (SELECT *, xor(a, a >> 24) AS b FROM m1),
m3 AS (SELECT *, (b + (b << 3) + (b << 8)) & {{m}} AS d FROM m2), m4 AS (SELECT *, xor(d, d >> 14) AS e FROM m3),
m5 AS (SELECT *, (e + (e << 2) + (e << 4)) & {{m}} AS g FROM m4), m6 AS (SELECT *, xor(g, g >> 28) AS y FROM m5), m AS (SELECT sid, pos, (y + (y << 31)) & {{m}} AS x FROM m6),
k AS (SELECT sid, pos, x AS head, lead(x, {{q}}) OVER o AS tail, min(x) OVER (PARTITION BY sid ORDER BY pos ROWS BETWEEN CURRENT ROW AND {{q}} FOLLOWING) AS least, lead(pos, {{q}}) OVER o AS there FROM m WINDOW o AS (PARTITION BY sid ORDER BY pos)),
p AS (SELECT sid, pos, least FROM k WHERE there IS NOT NULL AND least IS NOT NULL AND (head IS NOT DISTINCT FROM least) <> (tail IS NOT DISTINCT FROM least)),
z AS (SELECT sid, pos, least, runs, substr(seq, pos + 1, {{k}}) AS f, reverse(translate(substr(seq, pos + 1, {{k}}), 'ACGT', 'TGCA')) AS r FROM p JOIN h USING (sid)),
found AS (SELECT sid, (row_number() OVER (PARTITION BY sid ORDER BY pos) - 1)::INT AS idx, pos, (r < f)::INT AS rev, least(f, r) AS kmer, least AS smer, runs FROM z)"""

SQL = {
    "w1_closed_syncmers": f"WITH {_W1.format(k=31, s=11, q=20, m=(1 << 22) - 1)} SELECT sid, idx, pos, rev, kmer, smer FROM found",
    "a7_consensus": f"""WITH {_W1.format(k=15, s=5, q=10, m=(1 << 10) - 1)},
each AS (SELECT kmer, i, runs[pos + CASE WHEN rev = 1 THEN 16 - i ELSE i END] AS n FROM found, range(1, 16) t(i)),
mean AS (SELECT kmer, i, round(avg(n))::INT AS n FROM each GROUP BY kmer, i)
SELECT kmer, string_agg(repeat(substr(kmer, i::INT, 1), n), '' ORDER BY i) AS seq FROM mean GROUP BY kmer""",
    "w3_reads_at_least": f"WITH {_OCC}, c AS (SELECT count(*) AS m FROM occ GROUP BY sid) SELECT n, (SELECT count(*) FROM c WHERE m >= n) AS reads FROM range(1, (SELECT max(m) FROM c) + 1) t(n)",
    "w6_gene_order": f"""{_U}, {_BEST.replace(f"{_V}, ", "")}, first AS (SELECT vid, min(gname) AS gname FROM best GROUP BY vid),
mark AS (SELECT uid AS path_id, gname, min(pos) AS pos FROM member m JOIN first f ON f.vid = m.v >> 1 GROUP BY uid, gname),
r AS (SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY pos) - row_number() OVER (PARTITION BY path_id ORDER BY gname) AS d FROM mark)
SELECT path_id, count(*) AS n, round(coalesce(1 - 6 * sum(d * d)::DOUBLE / nullif(count(*) * (count(*) * count(*) - 1), 0), 0), 6) AS rho FROM r GROUP BY path_id""",
    "seq_p9_path_steps": f"{_U} SELECT uid AS path_id, pos::INT AS pos, name, (m.v % 2)::INT AS rev FROM member m JOIN v ON v.vid = m.v >> 1",
    "seq_p10_turned_paths": f"""{_U}, n AS (SELECT uid, count(*) AS n FROM member GROUP BY uid)
SELECT m.uid AS path_id, m.pos::INT AS pos, xor(b.v, 1) AS back, r.v AS rotated FROM member m JOIN n USING (uid) JOIN member b ON b.uid = m.uid AND b.pos = n - 1 - m.pos JOIN member r ON r.uid = m.uid AND r.pos = (m.pos + 2) % n""",
    "p13_quantiles": f"WITH {_OCC} SELECT kid, round(quantile_cont(idx::DOUBLE, 0.25), 6) AS q1, round(quantile_cont(idx::DOUBLE, 0.75), 6) AS q3 FROM occ GROUP BY kid",
    "s7_tags": f"WITH {_V} SELECT vid, len, len * cov AS mass, true AS ok FROM v",
    "s10_hits_through_table": """WITH x AS (SELECT DISTINCT * EXCLUDE (run_at, loaded_at) FROM annot WHERE gname IS NOT NULL AND sname IS NOT NULL AND score IS NOT NULL AND NOT isnan(score))
SELECT gname, sname, least(alifrom, alito) AS alifrom, greatest(alifrom, alito) AS alito, least(envfrom, envto) AS envfrom, greatest(envfrom, envto) AS envto, (strand <> 0)::TINYINT AS strand, evalue, score FROM x
WHERE hmmfrom IS NOT NULL AND hmmto IS NOT NULL AND alifrom IS NOT NULL AND alito IS NOT NULL AND envfrom IS NOT NULL AND envto IS NOT NULL AND modlen IS NOT NULL AND evalue IS NOT NULL AND bias IS NOT NULL AND strand IS NOT NULL""",
    "s12_rotations_through_list": f"WITH {_V} SELECT name AS sname, vid % len + 1 AS pos, vid % 3 = 0 AS rev FROM v WHERE len > 0",
    "a27_any_kmer": f"WITH {_OCC} SELECT count(*) > 0 AS some FROM occ",
    "l4_gene_counts": f"WITH {_BEST} SELECT vid, og_type, count(*) AS genes FROM (SELECT *, max(score) OVER (PARTITION BY og_type, gname) AS top FROM best) WHERE score >= 0.85::DOUBLE * top AND score >= 100 GROUP BY ALL",
    "l4_cluster_types": f"""WITH RECURSIVE {_CLUSTERS}, {_BEST.replace(f"{_V}, ", "")},
mito AS (SELECT vid, count(*) AS genes FROM (SELECT *, max(score) OVER (PARTITION BY og_type, gname) AS top FROM best) WHERE score >= 0.85::DOUBLE * top AND score >= 100 AND og_type = 1 GROUP BY vid),
total AS (SELECT cid, clust, sum(len) AS size, coalesce(sum(genes), 0) AS genes FROM clustered JOIN v USING (vid) LEFT JOIN mito USING (vid) GROUP BY ALL),
score AS (SELECT cid, clust, t.t AS og_type, coalesce(sum(greatest(score, 0)) FILTER (og_type = t.t), 0) AS score FROM clustered LEFT JOIN best USING (vid), range(0, 4) t(t) GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY cid, clust ORDER BY score DESC, og_type) AS r FROM score),
first AS (SELECT a.cid, a.clust, a.og_type AS best, a.score, b.og_type AS next, b.score AS second FROM placed a JOIN placed b ON b.cid = a.cid AND b.clust = a.clust AND a.r = 1 AND b.r = 2)
SELECT cid, clust::INT AS clust, (CASE WHEN score = second THEN 0 WHEN best = 2 AND next = 1 AND genes > 0 AND (score < 3 * second OR (score < 5 * second AND size > 250000)) THEN 1 ELSE best END)::INT AS og_type FROM first JOIN total USING (cid, clust)""",
    "k3_fasta_lines": f"""{_U}, {_PLACED}, {_METRICS},
piece AS (SELECT path_id, pos, sname || CASE WHEN rev = 1 THEN '-' ELSE '+' END AS step, repeat('N', gap) || substr(CASE WHEN rev = 1 THEN {_RC.format("known")} ELSE known END, trim + 1) AS s
  FROM (SELECT p.*, coalesce(g.seq, repeat('N', slen)) AS known FROM placed p JOIN segments g ON g.vid = p.v >> 1)),
whole AS (SELECT path_id, string_agg(s, '' ORDER BY pos) AS seq, string_agg(step, ',' ORDER BY pos) AS walk FROM piece GROUP BY path_id)
SELECT printf('>ctg%06d%s length=%d wlength=%.3f nv=%d circular=%s path=%s', row_number() OVER (ORDER BY path_id) - 1, CASE WHEN circ THEN 'c' ELSE 'l' END, len, wlen, nv, circ::VARCHAR, walk)
  || chr(10) || array_to_string(regexp_extract_all(seq, '.{{1,60}}'), chr(10)) AS value FROM metric JOIN whole USING (path_id)""",
    "e1_wave_scores": "WITH g AS (SELECT DISTINCT gname FROM annot WHERE gname IS NOT NULL AND sname IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)) SELECT a.gname AS a, b.gname AS b, levenshtein(a.gname, b.gname)::BIGINT AS score FROM g a JOIN g b ON a.gname < b.gname",
    "e1_all_edit_scores": "WITH g AS (SELECT DISTINCT gname FROM annot WHERE gname IS NOT NULL AND sname IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)) SELECT a.gname AS a, b.gname AS b, levenshtein(a.gname, b.gname)::INT AS score FROM g a JOIN g b ON a.gname < b.gname",
    "o1_ordered_arcs": f"WITH {_E} SELECT * FROM e ORDER BY v, w",
    "o11_kmers_by_name": f"WITH {_OCC} SELECT kid, count(*) AS cov FROM occ GROUP BY kid ORDER BY kid",
}
