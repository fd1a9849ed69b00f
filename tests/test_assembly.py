import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from braidwork.functions.editing import align, cigar_text, render
from braidwork.operators.align import align_reads, best_chains, chain_seeds, common_blocks, link_coverage, shared_intervals, triplet_scores
from braidwork.operators.annotation import MITO, PLTD
from braidwork.operators.localgraph import LocalGraph, choose, rank_correlation, rotated_by_genes
from braidwork.operators.organelle import all_paths, choose_seeds, chosen, chosen_paths, minicircles, recalled, repeat_unit, seed_graphs
from braidwork.operators.pathsets import Coded, path_set
from braidwork.operators.syncmer import closed_syncmers, closed_syncmers_sql, select
from braidwork.operators.unzip import demultiplex, multiplex
from braidwork.plans import assembly
from braidwork.plans.assemble import AssemblyConfig, PathConfig, assemble, contigs, find_paths

DNA = st.text(alphabet="ACGT", max_size=30)


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(DNA, DNA)
def test_edit_distance_and_trace(a, b):
    got = align(a, b, trace=True)
    assert got.score == edit(a, b) == sum(n for n, op in got.cigar if op != "=")
    assert sum(n for n, op in got.cigar if op != "I") == len(a) and sum(n for n, op in got.cigar if op != "D") == len(b)
    i = j = 0
    for n, op in got.cigar:
        if op in "=X":
            assert all((a[i + t] == b[j + t]) == (op == "=") for t in range(n))
        i, j = i + n * (op != "I"), j + n * (op != "D")
    assert align(a, b, band=got.score).score == got.score and (not got.score or align(a, b, band=got.score - 1) is None)


def test_all_gene_names_are_scored(spark, sf_dir):
    got = assembly.QUERIES["e1_all_edit_scores"](spark, sf_dir).collect()
    names = {r["a"] for r in got} | {r["b"] for r in got}
    assert len(got) == len({(r["a"], r["b"]) for r in got}) == len(names) * (len(names) - 1) // 2
    assert any(r["a"][:3] != r["b"][:3] for r in got) and all(r["score"] == edit(r["a"], r["b"]) for r in got)


def test_extension_and_rendering():
    got = align("ACGTACGT", "ACGT", extend=True)
    assert (got.score, got.target_end, got.query_end) == (0, 4, 4)
    assert align("", "", trace=True).cigar == [] and cigar_text([(3, "="), (1, "X")]) == "3=1X"
    assert render("ACG", "AG", [(1, "="), (1, "D"), (1, "=")]) == "ACG\n| |\nA-G"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_common_blocks(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    blocks = common_blocks(a, b)
    assert sum(e - s + 1 for s, e, _, _ in blocks) == table[-1][-1]
    assert all(a[s : e + 1] == b[t : f + 1] for s, e, t, f in blocks)
    assert all(x[1] < y[0] and x[3] < y[2] for x, y in zip(blocks, blocks[1:]))


def test_chains():
    assert chain_seeds([(0, 5), (1, 6), (2, 9), (3, 1)]) == [(5, 9, 0, 2, 1), (1, 1, 3, 3, 1)]
    assert best_chains([2, 1, 3, 3], {0: [2, 3], 1: [2]}) == (5, [[0, 2], [0, 3]])
    assert best_chains([], {}) == (0, [])


def test_syncmers_agree(spark):
    rng = random.Random(3)
    seqs = []
    for _ in range(30):
        s = rng.choice("ACGT")
        while len(s) < 80:
            s += rng.choice([x for x in "ACGT" if x != s[-1]])
        seqs.append(s)
    seqs += ["", "ACGT", "ACGTNACGTACAGTCATCG" * 2]
    df = spark.createDataFrame(list(enumerate(seqs)), "sid bigint, seq string")
    a = {(r["sid"], r["pos"], r["kmer"]) for r in closed_syncmers(df, 15, 5).collect()}
    b = {(r["sid"], r["pos"], r["kmer"]) for r in closed_syncmers_sql(df, 15, 5).collect()}
    assert a == b and len(a) > 100
    back = seqs[0][::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert sorted(x[2] for x in select(seqs[0], 15, 5)) == sorted(x[2] for x in select(back, 15, 5))


def test_syncmers_of_a_long_read(spark):
    # One row for a window would carry the whole read: 120,000 bases squared.
    rng = random.Random(4)
    bases = "".join(rng.choice("ACGTacgu") for _ in range(120_000))
    seqs = [bases, bases[:14], bases[:15], "é" * 20 + bases[:300], None, bases[500:900] + "N" + bases[:40], bases[:60_000]]
    want = [(sid, p, kmer) for sid, t in enumerate(seqs) if t for p, _, kmer, _ in select(t, 15, 5)]
    df = spark.createDataFrame(list(enumerate(seqs)), "sid bigint, seq string").coalesce(1)
    plan = closed_syncmers_sql(df, 15, 5)
    assert "Generate" not in plan._jdf.queryExecution().toString()
    assert [tuple(r) for r in plan.collect()] == want


def occ_of(spark, walks):
    rows = [(sid, i, v) for sid, w in enumerate(walks) for i, v in enumerate(w)]
    return spark.createDataFrame(rows, "sid bigint, idx bigint, v bigint")


def test_alignment_through_a_repeat(spark):
    # Unitigs 0: k-mers 0 1, 1: k-mer 2, 2: k-mers 3 4, 3: k-mers 5 6, 4: 7 8; 0 and 2 lead into 1, 1 into 3 and 4.
    members = spark.createDataFrame([(0, 0, 0), (0, 1, 2), (1, 0, 4), (2, 0, 6), (2, 1, 8), (3, 0, 10), (3, 1, 12), (4, 0, 14), (4, 1, 16)], "uid bigint, pos bigint, v bigint")
    one = [(0, 2), (4, 2), (2, 6), (2, 8)]
    links = spark.createDataFrame([(v, w, 0, 5) for a, b in one for v, w in ((a, b), (b ^ 1, a ^ 1))], "v bigint, w bigint, ln int, cov bigint")
    fwd = [0, 2, 4, 10, 12]
    other = [6, 8, 4, 14, 16]
    walks = [fwd] * 12 + [[v ^ 1 for v in reversed(other)]] * 11 + [[4]]
    aln = align_reads(occ_of(spark, walks), members, links)
    rows = aln.where("sid = 0").orderBy("frag").collect()
    assert [r["uid"] for r in rows] == [0, 2, 6] and {r["n_aln"] for r in rows} == {1} and rows[0]["score"] == 5
    cov = {(r["v"], r["w"]): r["cov"] for r in link_coverage(aln).collect()}
    assert cov[0, 2] == cov[3, 1] == 12 and cov[4, 2] == 11
    tri = triplet_scores(aln)
    assert {(r["a"], r["u"], r["b"]): r["score"] for r in tri.where("u = 2").collect()} == {(0, 2, 6): 12, (4, 2, 8): 11}
    assert {tuple(r["uids"]) for r in shared_intervals(aln).where("sid = 0").collect()} == {(0,), (1,), (3,)}
    sizes = spark.createDataFrame([(u, n, 20) for u, n in [(0, 2), (1, 1), (2, 2), (3, 2), (4, 2)]], "uid bigint, n bigint, cov bigint")
    m, s, e, n = multiplex(members, sizes, links, tri, 1001)
    assert n == 1 and {r["uid"] for r in s.collect()} == {0, 2, 3, 4, 5, 6} and m.where("v = 4").count() == 2
    edges = {(r["v"], r["w"]) for r in e.collect()}
    mids = {w for v, w in edges if v == 0}
    assert len(mids) == 1 and {w for v, w in edges if v == min(mids)} == {6} and len(edges) == 8
    arcs = {(r["v"], r["w"]) for r in demultiplex(m, e).collect()}
    assert {(0, 2), (2, 4), (4, 10), (8, 4), (4, 14)} <= arcs and all((w ^ 1, v ^ 1) in arcs for v, w in arcs)


def ring(*sizes):
    g = LocalGraph(dict(enumerate(sizes)), dict.fromkeys(range(len(sizes)), 10.0))
    return g


def test_bubbles_and_extension():
    g = ring(100, 50, 60, 100)
    for v, w in ((0, 2), (0, 4), (2, 6), (4, 6)):
        g.add(v, w)
    assert g.extension(0, 1000)[0] == 6 and g.extension(0, 50)[0] is None
    assert g.pop_bubbles(1000) == 1 and set(g.length) == {0, 2, 3}


def test_paths_of_a_ring_with_inverted_repeat():
    # Large single copy 0, repeat 1 (twice), small single copy 2: the classic plastid.
    g = ring(80_000, 25_000, 18_000)
    g.cov[1] = 20.0
    for v, w in ((0, 2), (2, 4), (4, 3), (3, 0), (2, 5)):
        g.add(v, w)
    cn, average = g.copies(10.0)
    assert cn == {0: 1, 1: 2, 2: 1} and average == pytest.approx(10.0)
    paths, over = g.paths(cn)
    assert not over and any(g.closed(p) and g.metrics(p)[0] == 148_000 for p in paths)
    assert g.paths(cn, 1) == ([], True)
    assert LocalGraph({}, {}).paths({}) == ([], False)
    assert g.balanced_copies(10.0, {0: 1, 1: 2, 2: 1})[1] == 2


def test_long_rings_and_chains_are_enumerated(spark):
    n, m = 5100, 30
    one = [(2 * i, 2 * ((i + 1) % n)) for i in range(n)] + [(2 * i, 2 * i + 2) for i in range(n, n + m - 1)]
    vs = spark.createDataFrame([(i, 100, 10) for i in range(n + m)], "vid bigint, len bigint, cov bigint")
    es = spark.createDataFrame([(v, w, 10, 5) for a, b in one for v, w in ((a, b), (b ^ 1, a ^ 1))], "v bigint, w bigint, ls bigint, cov bigint")
    place = vs.select("vid", F.when(F.col("vid") < n, 0).otherwise(1).cast("bigint").alias("cid"))
    got = all_paths(vs, es, place, vs.select("vid", F.lit(1).alias("copy"))).orderBy("cid").collect()
    assert [(r["cid"], r["status"], len(r["v"]), r["len"], r["circ"]) for r in got] == [(0, "ok", n, 90 * n, True), (1, "ok", m, 90 * m + 10, False)]
    g = LocalGraph({i: 10 for i in range(4)}, dict.fromkeys(range(4), 1.0))
    for v, w in ((0, 2), (2, 4), (4, 2), (4, 6)):
        g.add(v, w, 1)
    assert g.best_circle_within([0, 2, 4, 2, 4, 6], 0.5) == [2, 4, 2, 4] and g.best_circle_within([0, 2, 4, 6], 0.9) is None


def tangled(n, copies, seed=1):
    rng = random.Random(seed)
    g = LocalGraph({i: rng.randrange(50, 900) for i in range(n)}, {i: rng.randrange(1, 60) / 4 for i in range(n)})
    for _ in range(2 * n):
        g.add(rng.randrange(2 * n), rng.randrange(2 * n), rng.randrange(40), 1.0)
    return g, {i: rng.randint(1, copies) for i in range(n)}


def test_too_many_paths_are_counted_without_walking_them(monkeypatch):
    g, cn = tangled(8, 6)
    want = sum(1 for _ in g._both_ways(g.heaviest(), {i: 1 for i in g.length}))
    assert g.count_ways({i: 1 for i in g.length}, 10**6) == want
    monkeypatch.setattr(LocalGraph, "_extended", None)
    g, cn = LocalGraph(dict.fromkeys(range(6), 100), dict.fromkeys(range(6), 9.0)), dict.fromkeys(range(6), 9)
    for v in range(0, 12, 2):
        for w in range(0, 12, 2):
            g.add(v, w)
    assert g.paths(cn) == ([], True)


@pytest.mark.parametrize("seed", range(12))
def test_sets_of_paths_are_those_found_one_by_one(seed):
    g, cn = tangled(5 + seed % 3, 2 + seed % 2, seed)
    if g.count_ways(cn, 30_000) > 30_000:
        cn = dict.fromkeys(cn, 1)
    paths, over = g.paths(cn)
    extra = [q for p in paths if not g.closed(p) and (q := g.best_circle_within(p))]
    every = paths + [list(q) for q in sorted({g.canonical(q) for q in extra} - {tuple(p) for p in paths})]
    want = [(p, *g.metrics(p)) for p in every]
    for got in (path_set(g, cn, 10**6), Coded(g, cn).path_set()):
        assert not over and want == [(got.path(i), got.bases[i], got.weight[i], got.circ[i]) for i in range(len(got.steps))]
    i = got.chosen(0.9)
    assert i == choose([(n, w, c, 0.0) for _, n, w, c in want])
    assert [r for b in got.row(7, i) for r in b.to_pylist()] == [b for x in got.batches(7) for b in x.to_pylist()][i : i + 1]


def test_paths_chosen_in_the_task_are_those_chosen_from_the_table(spark):
    rows, arcs = [], set()
    for cid, seed in enumerate((2, 5, 9)):
        g, _ = tangled(5, 2, seed)
        rows += [(100 * cid + v, 1000 * n, int(4 * g.cov[v]), cid) for v, n in g.length.items()]
        arcs |= {(200 * cid + v, 200 * cid + w, ls, 1) for v, ws in g.out.items() for w, (ls, _) in ws.items()}
    vs = spark.createDataFrame(rows, "vid bigint, len bigint, cov bigint, cid bigint")
    es = spark.createDataFrame(sorted(arcs), "v bigint, w bigint, ls bigint, cov bigint")
    place, copies = vs.select("vid", "cid"), vs.select("vid", F.lit(2).alias("copy"))
    types = spark.createDataFrame([(0, PLTD), (1, MITO)], "cid bigint, og_type int")
    every = all_paths(vs.drop("cid"), es, place, copies)
    want = sorted(chosen(every, types).select(every.columns).collect())
    got = chosen_paths(vs.drop("cid"), es, place, copies, types).collect()
    assert len(want) == 3 and sorted(got) == want


def test_path_queries_leave_no_component_out(spark, sf_dir):
    _, copies = assembly._copies(spark, sf_dir)
    got = assembly.QUERIES["c3_paths"](spark, sf_dir).cache()
    assert got.select("cid").distinct().count() == copies.select("cid").distinct().count() and not got.where("status = 'too_large'").count()


def test_choice_and_gene_order():
    assert choose([(100, 1.0, False, 0.0), (95, 1.0, True, 0.0)]) == 1 and choose([(100, 1.0, False, 0.0), (80, 1.0, True, 0.0)]) == 0 and choose([]) is None
    assert rank_correlation([0, 1, 2], [5, 6, 9]) == 1 and rank_correlation([0, 1, 2], [9, 6, 5]) == -1
    assert rotated_by_genes([0, 2, 4, 6], {1: 10, 2: 20, 3: 30}, {1, 2, 3}) == ([2, 4, 6, 0], 1.0)
    assert rotated_by_genes([7, 5, 3, 1], {1: 10, 2: 20, 3: 30}, {1, 2, 3}) == ([2, 4, 6, 0], 1.0)


def test_seeds_and_recall():
    row = lambda vid, cov, n, clust, kind, genes, others=0: {"vid": vid, "cov": cov, "len": n, "clust": clust, "clust_type": kind, "genes": genes, "others": others}
    rows = [row(0, 10, 50_000, 0, 1, 5), row(1, 11, 20_000, 0, 1, 2), row(2, 300, 90_000, 1, 2, 0, 9), row(3, 21, 3000, 0, 1, 0)]
    assert choose_seeds(rows, 1, 10**6)[0] == {0, 1, 3}
    assert choose_seeds(rows, 2, 10**6)[0] == set()
    g = LocalGraph({0: 50_000, 1: 20_000, 2: 90_000, 3: 3000}, {0: 10.0, 1: 11.0, 2: 300.0, 3: 21.0})
    for v, w in ((0, 6), (6, 2), (2, 4)):
        g.add(v, w)
    assert recalled(g, {0, 1}) == {0, 1, 3}


def test_seeds_of_a_large_component_with_many_clusters(spark):
    # Every segment is a cluster of its own; 4,095 and 4,199 must stay two. Segment 4,199 has genes, its neighbour 4,095 has none.
    n = 5100
    vs = spark.createDataFrame([(i, 20_000, 10) for i in range(n)], "vid bigint, len bigint, cov bigint")
    es = spark.createDataFrame([(v, w, 0, 5) for i in range(n - 1) for v, w in ((2 * i, 2 * i + 2), (2 * i + 3, 2 * i + 1))], "v bigint, w bigint, ls bigint, cov bigint")
    place = vs.select("vid", F.lit(0).cast("bigint").alias("cid"))
    clusters = place.withColumn("clust", F.col("vid"))
    kinds = clusters.select("cid", "clust", F.when(F.col("clust") == 4199, MITO).otherwise(PLTD).alias("og_type"))
    counts = spark.createDataFrame([(4199, MITO, 5000)], "vid bigint, og_type int, genes bigint")
    got = seed_graphs(vs, es, place, clusters, kinds, counts, MITO, 30_000).collect()
    assert [(r["cid"], r["part"], r["vid"], r["cov"]) for r in got] == [(0, 0, 4199, 10.0)]


def test_minicircle_units(spark):
    assert repeat_unit([2, 4, 0, 2, 4, 0, 2], 0) == [0, 2, 4] and repeat_unit([0, 2, 0, 4], 0) is None
    assert repeat_unit([5, 3, 1, 5, 3, 1], 0) == [0, 2, 4]
    rows = [(0, 0, i, u) for i, u in enumerate([0, 2, 0, 2])] + [(1, 0, i, u) for i, u in enumerate([3, 1, 3, 1])] + [(2, 0, 0, 0)]
    aln = spark.createDataFrame(rows, "sid bigint, aln_id int, frag int, uid bigint")
    assert [(r["v"], r["reads"]) for r in minicircles(aln, 0).collect()] == [([0, 2], 2)]


def genome(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def tiled(circle, size, step, errors=0.0, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(0, len(circle), step):
        r = (circle * 2)[i : i + size]
        r = "".join(rng.choice("ACGT") if errors and rng.random() < errors else b for b in r)
        if rng.random() < 0.5:
            r = r[::-1].translate(str.maketrans("ACGT", "TGCA"))
        out.append(r)
    return out


@pytest.mark.parametrize("errors,correct", [(0.0, False), (0.003, True)])
def test_circle_from_reads_to_contig(spark, errors, correct):
    circle = genome(11, 3000)
    reads = spark.createDataFrame([(i, f"r{i}", s) for i, s in enumerate(tiled(circle, 900, 40, errors))], "sid bigint, name string, seq string")
    made = assemble(reads, AssemblyConfig(k=61, s=11, min_kmer=4, unzip_rounds=1, correct=correct, tip=300, bubble=600))
    assert made.unitigs.count() == 1
    row = made.unitigs.first()
    vs = made.unitigs.select(F.col("uid").alias("vid"), F.concat(F.lit("u"), F.col("uid").cast("string")).alias("name"), "seq", "len", "cov")
    gene = spark.createDataFrame([(1, "cox1", f"u{row['uid']}", 100, 900, 0, 1e-50, 900.0, 1)], "hit_id bigint, gname string, sname string, alifrom int, alito int, strand int, evalue double, score double, og_type int")
    found = find_paths(vs, made.links.select("v", "w", "ls", "cov"), gene, PathConfig())
    got = contigs(found, vs, made.links).first()
    assert got["circ"] and abs(got["len"] - 3000) <= (0 if not errors else 30)
    if not errors:
        both = circle * 2, (circle * 2)[::-1].translate(str.maketrans("ACGT", "TGCA"))
        assert any(got["seq"] in b for b in both)
    place = found.places.first()
    assert (place["gname"], place["score"], place["seq"]) == ("cox1", 900, row["uid"])
