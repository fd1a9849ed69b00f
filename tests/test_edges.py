"""Nulls, repeats, empty tables and clashing names for the general operators."""

import pytest
from pyspark.sql import functions as F

from braidwork.operators import annotation, coverage, occurrence, overlap, paths
from braidwork.operators.correct import CorrectionRules, blocks, correct_reads, error_kmers, recounted, spliced

OCC = "sid bigint, idx int, rev int, kid bigint, smer bigint, cov int"
HIT = "hit_id bigint, gname string, sname string, alifrom int, alito int, strand int, evalue double, score double, og_type int, len int"


def test_occurrences(spark):
    rows = [(1, 0, 0, 5, 1, 9), (1, 1, 1, 6, 2, 9), (1, 2, 0, 5, 1, 9), (2, 0, 0, 6, 2, 9), (2, 1, 1, 5, 3, 9), (3, 0, 0, 7, None, 9)]
    occ = spark.createDataFrame(rows, OCC)
    got = {tuple(r) for r in occurrence.arc_coverage(occ).collect()}
    # 5+ 6- and 6- 5+ ; the second read walks 6+ 5-, the twin of 5+ 6-.
    assert got == {(5, 0, 6, 1, 2), (5, 1, 6, 0, 1)} or got == {(5, 0, 6, 1, 2), (6, 1, 5, 0, 1), (5, 1, 6, 0, 1)}
    table = {r["kid"]: (r["cov"], r["smer"], r["consistent"]) for r in occurrence.kmer_table(occ).collect()}
    assert table == {5: (3, 1, False), 6: (2, 2, True), 7: (1, None, True)}
    assert {r["kid"]: r["del"] for r in occurrence.kept_kmers(occurrence.kmer_table(occ), 2).collect()} == {5: False, 6: False, 7: True}
    assert {(r["mult"], r["n"]) for r in occurrence.count_of_counts(occ, "kid").collect()} == {(1, 1), (2, 1), (3, 1)}
    none = occ.limit(0)
    assert occurrence.arc_coverage(none).count() == occurrence.kmer_table(none).count() == occurrence.count_of_counts(none, "kid").count() == 0
    assert occurrence.occurrence_stats(none, occurrence.kmer_table(none)).count() == 1


def test_strand_symmetry(spark):
    rows = [(1, 0, 0, 5), (1, 1, 1, 6), (1, 2, 0, 8), (2, 0, 1, 8), (2, 1, 0, 6)]
    turned = [(s, 10 - i, 1 - r, k) for s, i, r, k in rows]
    cov = lambda x: {tuple(r) for r in occurrence.arc_coverage(spark.createDataFrame(x, "sid bigint, idx int, rev int, kid bigint")).collect()}
    assert cov(rows) == cov(turned)


def test_peaks():
    hist = [(1, 1000)] + [(i, max(5, 100 - 10 * abs(i - 20))) for i in range(2, 40)]
    assert occurrence.coverage_peaks(hist) == (None, 20) and occurrence.coverage_peaks([]) == (None, None)
    two = [(1, 500)] + [(i, max(2, 60 - 10 * abs(i - 15), 100 - 10 * abs(i - 30))) for i in range(2, 60)]
    assert occurrence.coverage_peaks(two) == (15, 30)
    assert occurrence.automatic_cutoff(15, 30) == 150 and occurrence.automatic_cutoff(None, 20) == 200


def test_modal_distance_ties_and_corrected(spark):
    rows = [(1, 0, 0, 0, 5, False), (1, 1, 7, 0, 6, False), (2, 0, 0, 0, 5, False), (2, 1, 9, 0, 6, False), (3, 0, 0, 0, 5, False), (3, 1, None, 0, 6, True)]
    occ = spark.createDataFrame(rows, "sid bigint, idx int, pos bigint, rev int, kid bigint, ec boolean")
    r = overlap.modal_distances(overlap.pair_distances(occ)).first()
    assert (r["d"], r["n"], r["second"], r["total"]) == (7, 1, 1, 2)
    assert overlap.modal_distances(overlap.pair_distances(occ.limit(0))).count() == 0


def test_run_consensus(spark):
    occ = spark.createDataFrame([(1, 0, 0, 0, 5, False), (2, 0, 1, 1, 5, False), (2, 1, None, 0, 6, True)], "sid bigint, idx int, pos bigint, rev int, kid bigint, ec boolean")
    runs = spark.createDataFrame([(1, [1, 2, 3]), (2, [9, 4, 3, 1])], "sid bigint, lengths array<int>")
    kmers = spark.createDataFrame([(5, "ACG"), (6, "TGA")], "kid bigint, kmer string")
    got = {r["kid"]: r["lengths"] for r in overlap.run_consensus(occ, runs, kmers, 3).collect()}
    assert got == {5: [1, 3, 4], 6: None}  # 1 and 1; 2 and 3 give 2.5, rounded up; 3 and 4 likewise
    seqs = {r["kid"]: r["seq"] for r in overlap.consensus_sequence(overlap.run_consensus(occ, runs, kmers, 3)).collect()}
    assert seqs == {5: "ACCCGGGG", 6: "NNN"}


def hits(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], HIT)


def test_classes(spark):
    vs = spark.createDataFrame([(0, "a", 100), (1, "b", 100), (2, "c", 20_000)], "vid bigint, name string, len bigint")
    h = hits(spark, [
        (1, "cox1", "a", 1, 9, 0, 1e-9, 400.0, 1), (2, "cox1", "a", 1, 9, 0, 1e-9, 390.0, 1), (3, "rbcL", "b", 1, 9, 0, 1e-9, 500.0, 2), (4, "nad1", "b", 1, 9, 0, 1e-9, 500.0, 1),
        (5, "trnA", "a", 1, 9, 0, 1e-9, 900.0, 2), (6, "rrn1", "a", 1, 9, 0, 1e-9, 900.0, 2), (7, "rbcL", "a", 1, 9, 0, 1.0, 900.0, 2), (8, "x", "nowhere", 1, 9, 0, 1e-9, 900.0, 2),
        (9, "y", "a", 1, 9, 0, None, 900.0, 2), (10, "z", "c", 1, 9, 0, 1e-9, -5.0, 2),
    ])
    got = {r["vid"]: (r["og_type"], r["score"]) for r in annotation.segment_classes(h, vs).collect()}
    assert got == {0: (1, 400.0), 1: (0, 500.0), 2: (0, 0.0)}  # equal best scores and a bad score are unclassified
    more = {r["vid"]: r["og_type"] for r in annotation.segment_classes(h, vs, annotation.ClassRules(transfer_rna=True, ribosomal_rna=True)).collect()}
    assert more[0] == 2
    assert annotation.segment_classes(h.limit(0), vs).where("og_type <> 0").count() == 0


def test_repair(spark):
    rows = [(0, 2, 900.0, 100.0, 150_000), (1, 2, 300.0, 200.0, 120_000), (2, 2, 300.0, 20.0, 5_000), (3, 2, 50.0, 0.0, 1_000), (4, 1, 90.0, 10.0, 9)]
    found = spark.createDataFrame(rows, "cid bigint, og_type int, score double, sscore double, len bigint")
    genes = spark.createDataFrame([(0, 2, "rbcL", 900), (1, 2, "rbcL", 100)], "cid bigint, og_type int, gname string, score bigint")
    got = {r["cid"]: (r["og_type"], r["score"]) for r in annotation.repaired(found, genes).collect()}
    assert got == {0: (2, 900.0), 1: (1, 200.0), 2: (2, 300.0), 3: (2, 50.0), 4: (1, 90.0)}
    assert annotation.repaired(found.limit(0), genes).count() == 0


def test_lift(spark):
    steps = spark.createDataFrame([("p", "a", 100, 0, 10, 50), ("p", "b", 100, 1, 0, 0)], "path_id string, sname string, slen bigint, rev int, trim int, offset bigint")
    h = hits(spark, [(1, "g", "a", 5, 45, 0, 1e-9, 2000.4, 1), (2, "g", "a", 5, 14, 0, 1e-9, 5.0, 1), (3, "g", "b", 10, 30, 0, 1e-9, 7.5, 1), (4, "g", "a", 30, 20, 0, 1e-9, 5.0, 1)])
    got = {tuple(r) for r in annotation.lifted(h, steps).select("seq", "gname", "strand", "start", "end", "score").collect()}
    assert got == {("p", "g", "+", 50, 85, 1000), ("p", "g", "-", 70, 90, 8)}


def test_coverage(spark):
    vs = spark.createDataFrame([(i, n, c) for i, (n, c) in enumerate([(100, 10), (100, 12), (100, 20), (50, 100)])], "vid bigint, len bigint, cov bigint")
    place = vs.select("vid", F.lit(0).cast("bigint").alias("cid"))
    clusters = {r["vid"]: r["clust"] for r in coverage.coverage_clusters(vs, place).collect()}
    assert clusters == {0: 0, 1: 0, 2: 1, 3: 2}
    bound = coverage.coverage_bound(vs, place).first()["bound"]
    assert bound == pytest.approx(0.7 * (100 * 10 + 5 * 12) / 105)
    assert coverage.rough_coverage(vs, place).first()["rough"] == 20
    none = vs.limit(0)
    assert coverage.coverage_clusters(none, place).count() == coverage.coverage_bound(none, place).count() == 0
    values = spark.createDataFrame([(1, x) for x in [10, 11, 12, 11, 1000]] + [(2, None)], "k bigint, _value bigint")
    assert {r["k"]: r["mean"] for r in coverage.fenced_mean(values, "k", "_value").collect()} == {1: 11.0}


def test_path_places_and_sequences(spark):
    vs = spark.createDataFrame([(0, "a", "AACCC", 5, 1), (1, "b", "CCCTT", 5, 1), (2, "c", None, 3, 1)], "vid bigint, name string, seq string, len bigint, cov bigint")
    es = spark.createDataFrame([(0, 2, 3, 1), (3, 1, 3, 1), (2, 4, -2, 1)], "v bigint, w bigint, ls bigint, cov bigint")
    steps = spark.createDataFrame([("x", 0, 0), ("x", 1, 2), ("x", 2, 4), ("y", 0, 3), ("y", 1, 1), ("z", 0, 4)], "path_id string, pos int, v bigint")
    got = {r["path_id"]: r["seq"] for r in paths.path_sequences(steps, vs, es).collect()}
    assert got == {"x": "AACCCTTNNNNN", "y": "AAGGGTT", "z": "NNN"}
    metrics = {r["path_id"]: (r["nv"], r["len"], r["circ"]) for r in paths.path_metrics(steps, vs, es).collect()}
    assert metrics["x"] == (3, 5 + 2 + 5, False) and metrics["z"] == (1, 3, False)
    assert paths.path_sequences(steps.limit(0), vs, es).count() == 0


def test_correction_by_hand(spark):
    k = 5
    good = ["AACGT", "CGTCA", "TCAGG", "AGGAT"]  # on the read AACGTCAGGAT at 0, 2, 4, 6
    kmers = [(i, s, 50) for i, s in enumerate(good)] + [(9, "CGTTA", 1)]
    one = [(0, 2, 2, 40), (2, 4, 2, 40), (4, 6, 2, 40), (0, 18, 2, 1), (18, 4, 2, 1)]
    arcs = [(v, w, d, c) for v, w, d, c in one] + [(w ^ 1, v ^ 1, d, c) for v, w, d, c in one]
    ks = spark.createDataFrame(kmers, "vid bigint, kmer string, cov bigint")
    es = spark.createDataFrame(arcs, "v bigint, w bigint, d bigint, cov bigint")
    occ = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 2, 18), (0, 2, 4, 4), (0, 3, 6, 6), (1, 0, 0, 18), (1, 1, 2, 4), (1, 2, 4, 6)], "sid bigint, idx bigint, pos bigint, v bigint")
    reads = spark.createDataFrame([(0, "AACGTTAGGAT"), (1, "CGTTAGGAT")], "sid bigint, seq string")
    rules = CorrectionRules(min_kmer=3, max_error=30, min_block=2, min_edits=2)
    marked = error_kmers(ks, es, rules)
    assert {r["vid"] for r in marked.where("del").collect()} == {9}
    b = {r["sid"]: r for r in blocks(occ, marked, reads, k).collect()}
    assert (b[0]["source"], b[0]["sink"], b[0]["seq"], b[0]["turned"]) == (0, 4, "TAGG"[:4], False)
    assert b[1]["turned"] and b[1]["source"] == 5 and b[1]["sink"] is None and b[1]["seq"] == "CG"
    fixed_occ, fixed = correct_reads(occ, ks, es, reads, k, rules)
    assert {r["sid"]: r["status"] for r in fixed.collect()}[0] == "success"
    walk = [(r["v"], r["ec"]) for r in fixed_occ.where("sid = 0").orderBy("idx").collect()]
    assert walk == [(0, False), (2, True), (4, False), (6, False)]
    counts = {r["vid"]: (r["cov"], r["own"], r["del"]) for r in recounted(fixed_occ, ks).collect()}
    assert counts[1][1] == 0 and counts[1][2] and counts[0] == (1, 1, False)
    empty = correct_reads(occ.limit(0), ks, es, reads, k, rules)
    assert empty[0].count() == 0 and empty[1].count() == 0
    assert spliced(occ, fixed.limit(0)).count() == 7
