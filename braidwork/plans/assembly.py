"""Queries and SQL of consensus, alignment, correction, unzipping, copy numbers and paths.

K-mers of the record table have 64-bit names, so they are numbered first; what a graph of
them gives is compared by those numbers, which follow the order of the names.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork import adapters as a
from braidwork.functions import sequence as q
from braidwork.operators import align, annotation, chains, correct, coverage, estimate, graph, occurrence, organelle, overlap, paths, unzip
from braidwork.operators.ordered import numbered, running_total
from braidwork.operators.skew import join_by_key
from braidwork.plans import assemble
from braidwork.plans.annotations import path_steps
from braidwork.plans.graphs import _E, _V, sym
from braidwork.plans.sequences import _OCC
from braidwork.sinks import lines
from braidwork.sources import gfa, sequences
from braidwork.storage import checkpoint_root, materialize
from braidwork.tables import table

PART = 0.1
RULES = correct.CorrectionRules(min_kmer=3, max_error=30, min_arc=2, arc_part=0.1)


def kmers(s, d):
    """``kid, vid, cov`` of all k-mers, numbered in the order of their names."""
    return materialize(numbered(a.occurrences(s, d).groupBy("kid").agg(F.count(F.lit(1)).alias("cov")), ["kid"], "vid"))[0]


def occurrences(s, d, known):
    total = known.agg(F.sum("cov")).first()[0] or 0
    rows = join_by_key(a.occurrences(s, d), known.select("kid", "vid", F.col("cov").alias("_n")), "kid", "_n", total)
    return materialize(rows.select("sid", F.col("idx").cast("bigint").alias("idx"), (F.col("vid") * 2 + F.col("rev")).alias("v")))[0]


def kmer_graph(s, d):
    """Numbered k-mers with occurrences, and the arcs between them in both directions."""
    known = kmers(s, d)
    occ = occurrences(s, d, known)
    rows = occ.select("sid", "idx", F.shiftright("v", 1).alias("kid"), F.col("v").bitwiseAND(F.lit(1).cast("bigint")).cast("int").alias("rev"))
    one = occurrence.supported_arcs(occurrence.arc_coverage(rows), known.select(F.col("vid").alias("kid"), "cov", F.lit(False).alias("del")), PART)
    one = one.select((F.col("va") * 2 + F.col("vr")).alias("v"), (F.col("wa") * 2 + F.col("wr")).alias("w"), F.lit(0).cast("bigint").alias("ls"), "cov")
    arcs, _ = materialize(one.unionByName(graph.twins(one)))
    return known.select("vid", F.lit(1).cast("bigint").alias("len"), "cov"), occ, arcs


def _kmer_unitigs(s, d):
    vs, occ, arcs = kmer_graph(s, d)
    members, _, links = chains.unitigs(vs, arcs)
    return vs, occ, materialize(members)[0], materialize(links.select("v", "w", F.lit(0).alias("ln"), "cov"))[0]


def _refined(s, d):
    vs, _, members, links = _kmer_unitigs(s, d)
    return coverage.refined_link_coverage(links, members, materialize(_sizes(members, vs))[0])


def _aligned(s, d):
    vs, occ, members, links = _kmer_unitigs(s, d)
    aln, _ = materialize(align.align_reads(occ, members, links, 0.0))
    return vs, occ, members, links, aln


def _sizes(members, vs):
    cov = coverage.unitig_coverage(members, vs)
    return members.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).join(cov, "uid").select("uid", "n", F.floor("cov").cast("bigint").alias("cov"))


def _multiplexed(s, d):
    vs, occ, members, links, aln = _aligned(s, d)
    return unzip.multiplex(members, materialize(_sizes(members, vs))[0], links, align.triplet_scores(aln), 31)[1]


def _demultiplexed(s, d):
    vs, e = a.vertices(s, d), sym(s, d)
    members, _, links = chains.unitigs(vs, e)
    return unzip.demultiplex(members, links.withColumn("ln", F.lit(0))).select("v", "w")


def _errors(s, d):
    vs, _, arcs = kmer_graph(s, d)
    return correct.error_kmers(vs, arcs, RULES)


def _corrected(s, d):
    """The reads themselves corrected by the graph of their k-mers: k-mers, occurrences afterwards, and what became of each block."""
    reads = table(s, d, "reads").where("seq is not null").select("sid", q.compress_runs("seq").alias("seq"), q.run_lengths("seq").alias("lengths"))
    reads, occ, kmers, distances = assemble.read_kmers(materialize(reads)[0], 31, 11)
    arcs = assemble._arcs(occ, kmers, 0.0).join(distances, ["v", "w"], "left")
    return (kmers, *correct.correct_reads(occ, kmers, arcs, reads, 31, RULES))


def _recounted(s, d):
    kmers, occ, _ = _corrected(s, d)
    return correct.recounted(occ, kmers)


def _copies(s, d):
    place, _ = materialize(graph.components(a.vertices(s, d), sym(s, d)))
    return place, materialize(organelle.copy_numbers(a.vertices(s, d), place))[0]


def _paths(s, d):
    place, copies = _copies(s, d)
    return organelle.all_paths(a.vertices(s, d), sym(s, d), place, copies)


def _chosen(s, d):
    place, copies = _copies(s, d)
    found, genes = (materialize(x)[0] for x in annotation.component_classes(a.hits(s, d), a.vertices(s, d), place))
    types, _ = materialize(annotation.repaired(found, genes))
    return organelle.chosen_paths(a.vertices(s, d), sym(s, d), place, copies, types).select("cid", "path_no", "len", "circ")


def _walks(s, d):
    """Unitigs as paths, with the segments and the arcs, which are written once."""
    v, e = a.vertices(s, d), sym(s, d)
    return chains.unitigs(v, e)[0].withColumnRenamed("uid", "path_id"), v, e


def _seeds(s, d):
    v = a.vertices(s, d)
    place, _ = materialize(graph.components(v, sym(s, d)))
    clusters, _ = materialize(coverage.coverage_clusters(v, place))
    best = annotation.best_genes(annotation.of_segments(annotation.considered(a.hits(s, d)), v), "vid")
    counts, _ = materialize(organelle.gene_counts(best))
    kinds = organelle.cluster_types(clusters, best, v, counts)
    return organelle.seed_graphs(v, sym(s, d), place, clusters, kinds, counts, annotation.MITO, 3_000_000).select("cid", "part", "vid", F.round("cov", 6).alias("cov"))


def _folder(s, name):
    import uuid

    return f"{checkpoint_root(s)}/braidwork/{s.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _named(s, d):
    """Segments whose length agrees with their sequence, as a file must have it."""
    v = a.vertices(s, d)
    return v.withColumn("len", F.coalesce(F.length("seq"), "len").cast("bigint"))


def _through_gfa(part):
    def run(s, d):
        path = _folder(s, "gfa")
        lines.write_lines(lines.gfa_lines(_named(s, d), sym(s, d)), path)
        v, e = gfa.read_gfa(s, path)
        if part:
            names = lambda c: v.select(F.col("vid").alias(f"_{c}"), F.col("name").alias(f"{c}n"))
            e = e.withColumns({f"_{c}": F.shiftright(c, 1) for c in "vw"}).join(names("v"), "_v").join(names("w"), "_w")
            return e.select(F.col("vn").alias("a"), (F.col("v") % 2).alias("ar"), F.col("wn").alias("b"), (F.col("w") % 2).alias("br"), "ls", "cov")
        return v.select("name", "seq", "len", "cov")

    return run


def _through_fasta(s, d):
    path = _folder(s, "fasta")
    reads = table(s, d, "reads").select(F.concat(F.col("sid").cast("string"), F.lit(" "), F.coalesce("comment", F.lit(""))).alias("name"), "seq")
    lines.write_lines(lines.sequence_lines(reads), path)
    return sequences.read_fasta(s, path).select(F.col("name").cast("bigint").alias("sid"), "seq")


def _capped(s, d):
    return sequences.capped(table(s, d, "reads"), 100_000).select("sid")


def _batches(s, d):
    return sequences.batches(table(s, d, "reads").where("seq is not null"), 20_000).select("sid", "batch")


def _bed(s, d):
    return lines.bed_lines(annotation.lifted(annotation.in_order(a.hits(s, d)), path_steps(s, d)))


def _cumulative(s, d):
    rows = running_total(a.vertices(s, d), ["vid"], "len", "upto")
    return rows.select("vid", "upto")


def _edit(s, d):
    genes = a.hits(s, d).select("gname").distinct().withColumn("one", F.lit(1))
    pairs = genes.select(F.col("gname").alias("a"), F.substring("gname", 1, 3).alias("p")).join(genes.select(F.col("gname").alias("b"), F.substring("gname", 1, 3).alias("p")), "p").where("a < b")
    return pairs.select("a", "b", F.levenshtein("a", "b").alias("score"))


def name_pairs(s, d):
    """Every gene name with each later one: the names of a gene set, which doesn't grow with the hits, are one array."""
    genes = materialize(a.hits(s, d).select("gname").distinct())[0]
    every = genes.agg(F.collect_list("gname").alias("names")).scalar()
    return genes.select(F.col("gname").alias("a"), F.explode(every).alias("b")).where("a < b")


def _edit_all(s, d):
    return name_pairs(s, d).select("a", "b", F.levenshtein("a", "b").alias("score"))


def _edit_reads(s, d):
    """Each read against the next of the same name, within 60 edits."""
    reads = table(s, d, "reads").where("seq is not null and name is not null")
    from pyspark.sql import Window

    pairs = reads.select("sid", "seq", F.lead("seq").over(Window.partitionBy("name").orderBy("sid")).alias("next"))
    return align.edit_alignments(pairs.where("next is not null"), "seq", "next", "sid", 60, True)


def _metrics(s, d):
    got = paths.path_metrics(*_walks(s, d))
    return got.withColumn("wlen", F.round("wlen", 3))


def _ordered(s, d):
    steps, v, e = _walks(s, d)
    m, _ = materialize(paths.path_metrics(steps, v, e))
    return paths.path_order(m, steps).select("path_id", "best")


def _round(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


QUERIES = {
    "j3_pair_distances": lambda s, d: overlap.pair_distances(a.occurrences(s, d), "idx"),
    "a6_modal_distance": lambda s, d: overlap.modal_distances(overlap.pair_distances(a.occurrences(s, d), "idx")),
    "g17_member_index": lambda s, d: align.member_index(chains.unitigs(a.vertices(s, d), sym(s, d))[0]),
    "e7_alignments": lambda s, d: _aligned(s, d)[4],
    "j4_seeds": lambda s, d: align.seeds(*(lambda x: (x[1], align.member_index(x[2])))(_kmer_unitigs(s, d))),
    "j10_shared_intervals": lambda s, d: align.shared_intervals(_aligned(s, d)[4]),
    "a12_alignment_coverage": lambda s, d: _round((lambda x: estimate.alignment_coverage(x[4], x[2], x[0]))(_aligned(s, d)), "cov"),
    "a13_link_coverage": lambda s, d: _round(align.link_coverage(_aligned(s, d)[4]), "cov"),
    "a14_refined_coverage": _refined,
    "a16_triplet_scores": lambda s, d: _round(align.triplet_scores(_aligned(s, d)[4]), "score"),
    "g15_multiplexed": _multiplexed,
    "g16_demultiplexed": _demultiplexed,
    "e1_edit_scores": _edit,
    "e1_all_edit_scores": _edit_all,
    "e1_edit_alignments": _edit_reads,
    "e2_error_kmers": _errors,
    "e3_corrected_blocks": lambda s, d: _corrected(s, d)[2].select("sid", "beg", "fin", "turned", "status", "path", "edits"),
    "e4_corrected_occurrences": lambda s, d: _corrected(s, d)[1].select("sid", "idx", "v", "pos", "ec"),
    "e5_recounted": _recounted,
    "e6_correction_summary": lambda s, d: correct.correction_summary(_corrected(s, d)[2]),
    "c1_copy_numbers": lambda s, d: _copies(s, d)[1].withColumn("average", F.round("average", 6)),
    "c3_paths": lambda s, d: _paths(s, d).withColumn("wlen", F.round("wlen", 3)),
    "c7_chosen_paths": _chosen,
    "c4_path_metrics": _metrics,
    "c5_path_order": _ordered,
    "w4_cumulative_lengths": _cumulative,
    "seq_p12_path_sequences": lambda s, d: paths.path_sequences(*_walks(s, d)),
    "g21_seed_graphs": _seeds,
    "s1_through_fasta": _through_fasta,
    "s4_capped_reads": _capped,
    "s13_batches": _batches,
    "s5_segments_through_gfa": _through_gfa(0),
    "s6_links_through_gfa": _through_gfa(1),
    "k4_bed_lines": _bed,
}

_STEP = "st AS (SELECT kid, rev, idx, lead(kid) OVER w AS kid2, lead(rev) OVER w AS rev2, lead(idx) OVER w AS idx2 FROM occ WINDOW w AS (PARTITION BY sid ORDER BY idx))"
_PAIR = f"""{_OCC}, {_STEP}, pr AS (SELECT CASE WHEN (kid, rev, kid2, rev2) <= (kid2, 1 - rev2, kid, 1 - rev) THEN {{'va': kid, 'vr': rev, 'wa': kid2, 'wr': rev2}} ELSE {{'va': kid2, 'vr': 1 - rev2, 'wa': kid, 'wr': 1 - rev}} END AS k, (idx2 - idx)::BIGINT AS d FROM st WHERE kid2 IS NOT NULL),
ds AS (SELECT k, d, count(*) AS n FROM pr GROUP BY ALL)"""

SQL = {
    "j3_pair_distances": f"WITH {_PAIR} SELECT k.va AS va, k.vr AS vr, k.wa AS wa, k.wr AS wr, d, n FROM ds",
    "a6_modal_distance": f"""WITH {_PAIR}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, d) AS r, sum(n) OVER (PARTITION BY k) AS total FROM ds)
SELECT k.va AS va, k.vr AS vr, k.wa AS wa, k.wr AS wr, max(d) FILTER (r = 1) AS d, max(n) FILTER (r = 1) AS n, coalesce(max(n) FILTER (r = 2), 0) AS second, any_value(total)::BIGINT AS total FROM r GROUP BY k""",
    "g16_demultiplexed": f"WITH {_E} SELECT v, w FROM e",
    "e1_edit_scores": "WITH g AS (SELECT DISTINCT gname FROM annot WHERE gname IS NOT NULL AND sname IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)) SELECT a.gname AS a, b.gname AS b, levenshtein(a.gname, b.gname)::INT AS score FROM g a JOIN g b ON substr(a.gname, 1, 3) = substr(b.gname, 1, 3) AND a.gname < b.gname",
    "w4_cumulative_lengths": f"WITH {_V} SELECT vid, sum(len) OVER (ORDER BY vid)::BIGINT AS upto FROM v",
    "s1_through_fasta": "SELECT sid, coalesce(seq, '') AS seq FROM reads",
    "s4_capped_reads": "SELECT sid FROM (SELECT sid, sum(coalesce(length(seq), 0)) OVER (ORDER BY sid) - coalesce(length(seq), 0) AS before FROM reads) WHERE before < 100000",
    "s13_batches": """WITH RECURSIVE r AS (SELECT sid, length(seq) AS n, row_number() OVER (ORDER BY sid) AS i FROM reads WHERE seq IS NOT NULL),
f(i, sid, batch, upto) AS (SELECT i, sid, 0::BIGINT, n FROM r WHERE i = 1
  UNION ALL SELECT r.i, r.sid, CASE WHEN upto >= 20000 THEN batch + 1 ELSE batch END, CASE WHEN upto >= 20000 THEN 0 ELSE upto END + r.n FROM f JOIN r ON r.i = f.i + 1)
SELECT sid, batch FROM f""",
    "s5_segments_through_gfa": "SELECT name, seq, coalesce(length(seq), len, 0)::BIGINT AS len, CASE WHEN coalesce(cov, 1) = 0 THEN 1 ELSE coalesce(cov, 1) END AS cov FROM segments",
    "s6_links_through_gfa": f"WITH {_E} SELECT x.name AS a, e.v % 2 AS ar, y.name AS b, e.w % 2 AS br, e.ls, CASE WHEN e.cov = 0 THEN 1 ELSE e.cov END AS cov FROM e JOIN v x ON x.vid = e.v >> 1 JOIN v y ON y.vid = e.w >> 1",
}
