import gzip

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from braidwork.functions import sequence as q
from braidwork.operators.ordered import numbered, running_total
from braidwork.sinks import lines
from braidwork.sources import gfa, hits, sequences


def test_records_of_all_kinds(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">seq1 optional comment\nACGTAG\nATGA\n>empty\n>x\ttab\nAC\n")
    (tmp_path / "none.fa").write_text("")
    (tmp_path / "none2.fa").write_text("")
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write("@r1 c\nACGT\nAC\n+\n@III\nII\n@r2\nA\n+r2\n>\n")
    got = sequences.read_sequences(spark, [str(tmp_path / n) for n in ("a.fa", "none.fa", "none2.fa", "b.fq.gz")]).orderBy("sid").collect()
    assert [tuple(r) for r in got] == [
        (0, "seq1", "optional comment", "ACGTAGATGA", None), (1, "empty", None, "", None), (2, "x", "tab", "AC", None),
        (3, "r1", "c", "ACGTAC", "@IIIII"[:4] + "II"), (4, "r2", None, "A", ">"),
    ]
    split = sequences.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("sid").collect()
    assert [(r["sid"], r["name"], r["comment"], r["seq"]) for r in split] == [(0, "seq1", "optional comment", "ACGTAGATGA"), (1, "empty", None, ""), (2, "x", "tab", "AC")]


def test_truncated_quality(spark, tmp_path):
    (tmp_path / "t.fq").write_text("@r\nACGT\n+\nII\n")
    with pytest.raises(PySparkException):
        sequences.read_sequences(spark, [str(tmp_path / "t.fq")]).collect()


def test_cap_and_batches(spark):
    reads = spark.createDataFrame([(i, "A" * n) for i, n in enumerate([5, 3, 4, 0, 9])], "sid bigint, seq string").repartition(3)
    assert {r["sid"] for r in sequences.capped(reads, 8).collect()} == {0, 1}
    assert {r["sid"] for r in sequences.capped(reads, 9).collect()} == {0, 1, 2}
    assert sequences.capped(reads, 0).count() == 5
    assert {r["sid"]: r["batch"] for r in sequences.batches(reads, 8).collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1}
    assert (sequences.size_of("2K"), sequences.size_of("7"), sequences.size_of("1g")) == (2048, 7, 1 << 30)
    with pytest.raises(PySparkException):
        sequences.batches(spark.createDataFrame([(0, None)], "sid bigint, seq string"), 8).collect()


def test_numbers_and_totals(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("k")).repartition(7)
    keys = sorted(r["k"] for r in df.collect())
    assert {r["k"]: r["n"] for r in numbered(df, ["k"], "n").collect()} == {k: i for i, k in enumerate(keys)}
    assert {r["k"]: r["n"] for r in running_total(df, ["k"], "k", "n").collect()} == {k: sum(keys[: i + 1]) for i, k in enumerate(keys)}
    assert numbered(df.limit(0), ["k"], "n").count() == 0 and running_total(df.limit(0), ["k"], "k", "n").count() == 0


GFA = "H\tVN:Z:1.0\nS\tu0\tACGTACGT\tLN:i:8\tKC:i:80\tSC:f:10.000\nS\tu1\t*\tLN:i:20\tKC:i:100\nS\tu2\tACGT\nL\tu0\t+\tu1\t-\t4M\tEC:i:7\n"


def test_gfa(spark, tmp_path):
    (tmp_path / "g.gfa").write_text(GFA + "L\tu0\t+\tu0\t-\t3M1D2I\nL\tnew\t+\tu2\t+\t*\nL\tu2\t+\tu1\t+\t6:5\n")
    v, e = gfa.read_gfa(spark, str(tmp_path / "g.gfa"))
    assert [tuple(r) for r in v.orderBy("vid").collect()] == [
        (0, "u0", "ACGTACGT", 8, 10), (1, "u1", None, 20, 5), (2, "u2", "ACGT", 4, 1), (3, "new", None, 0, 1),
    ]
    want = {(0, 3, 4, 7), (2, 1, 4, 7), (0, 1, 4, 1), (6, 4, 0, 1), (5, 7, 0, 1), (4, 2, 6, 1), (3, 5, 6, 1)}
    assert {tuple(r) for r in e.select("v", "w", "ls", "cov").collect()} == want
    lines.write_lines(lines.gfa_lines(v, e), str(tmp_path / "out"), one_file=True)
    v2, e2 = gfa.read_graph(spark, str(tmp_path / "out"))
    assert {tuple(r) for r in v2.collect()} == {tuple(r) for r in v.collect()}
    assert {tuple(r) for r in e2.select("v", "w", "ls", "cov").collect()} == want


@pytest.mark.parametrize("text", [GFA + "S\tu0\tA\n", "S\tu0\n", "S\tu0\tA\tbad\n", "L\ta\t?\tb\t+\t*\n"])
def test_broken_gfa(spark, tmp_path, text):
    (tmp_path / "g.gfa").write_text(text)
    with pytest.raises((ValueError, PySparkException)):
        v, e = gfa.read_gfa(spark, str(tmp_path / "g.gfa"))
        v.collect(), e.collect()


def test_sequences_as_graph_and_back(spark, tmp_path):
    (tmp_path / "s.fa").write_text(">a\nACGT\n>b\n\n")
    v, e = gfa.read_graph(spark, str(tmp_path / "s.fa"))
    assert {(r["name"], r["len"]) for r in v.collect()} == {("a", 4), ("b", 0)} and e.count() == 0
    long = spark.createDataFrame([("x", "ACGTA" * 30), ("y", None)], "name string, seq string")
    lines.write_lines(lines.sequence_lines(long), str(tmp_path / "o"))
    got = {r["name"]: r["seq"] for r in sequences.read_sequences(spark, [str(p) for p in sorted((tmp_path / "o").glob("part*"))]).collect()}
    assert got == {"x": "ACGTA" * 30, "y": ""}


def test_hits(spark, tmp_path):
    (tmp_path / "h.txt").write_text(
        "# comment\n\nrbcL - u0 - 1 1428 2500 1073 2501 1072 1428 - 1e-300 1510.7 20.1 - more words\npsbA - u1 - 1 10 5 15 4 16 10 + 0.5 -3 0\n"
    )
    got = hits.all_hits(spark, [(str(tmp_path / "h.txt"), 2), (str(tmp_path / "h.txt"), 1)]).orderBy("hit_id").collect()
    r = got[0]
    assert (r["strand"], r["alifrom"], r["alito"], r["envfrom"], r["envto"]) == (1, 1073, 2500, 1072, 2501)
    assert (r["gname"], r["evalue"], r["score"], r["og_type"]) == ("rbcL", 1e-300, 1510.7, 2)
    assert [x["hit_id"] for x in got] == [0, 1, 2, 3] and got[1]["strand"] == 0 and got[3]["og_type"] == 1
    (tmp_path / "bad.txt").write_text("a b c\n")
    with pytest.raises(PySparkException):
        hits.read_hits(spark, str(tmp_path / "bad.txt"), 1).collect()


def test_lists_and_rotation(spark, tmp_path):
    (tmp_path / "p").write_text("p1\tu1+,u2-,u3-,u2+\n")
    (tmp_path / "r").write_text("seq1\t6\t-\nseq2\t2\n")
    p = hits.read_paths(spark, str(tmp_path / "p")).select(q.path_steps("path").alias("s")).first()["s"]
    assert [(x["name"], x["rev"]) for x in p] == [("u1", 0), ("u2", 1), ("u3", 1), ("u2", 0)]
    seqs = spark.createDataFrame([("seq1", "ACGTAGATGA"), ("seq2", "ACGTAGATGA"), ("seq3", "A")], "sname string, seq string")
    rot = seqs.join(hits.read_rotations(spark, str(tmp_path / "r")), "sname", "left")
    got = {r["sname"]: r["s"] for r in rot.select("sname", F.when(F.col("pos").isNull(), F.col("seq")).otherwise(q.rotate_sequence("seq", "pos", "rev")).alias("s")).collect()}
    assert got == {"seq1": "CTACGTTCAT", "seq2": "CGTAGATGAA", "seq3": "A"}


def test_array_functions(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5], "ACCGNNTa")], "a array<bigint>, s string")
    r = df.select(
        q.rotate_left("a", 2).alias("l"), q.rotate_left("a", 12).alias("l2"), q.reverse_path("a").alias("p"), q.compress_runs("s").alias("h"),
        q.run_lengths("s").alias("n"), q.expand_runs(q.compress_runs("s"), q.run_lengths("s")).alias("x"), q.windows("s", 9).alias("w"), q.reverse_complement("s", True).alias("rc"),
    ).first()
    assert r["l"] == [3, 4, 5, 1, 2] == r["l2"] and r["p"] == [4, 5, 2, 3, 0]
    assert (r["h"], r["n"], r["x"], r["w"], r["rc"]) == ("ACGAATA", [1, 2, 1, 1, 1, 1, 1], "ACCGAATA", [], "tANNCGGT")
