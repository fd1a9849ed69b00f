import random

from pyspark.sql import functions as F

from braidwork import cli
from braidwork.operators.annotation import exact_sums
from braidwork.plans import tools
from braidwork.sources import search
from braidwork.storage import checkpoint_root, materialize, release
from braidwork.streaming.counts import kmer_counts


def text(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part*"))).strip()


def test_rotate_and_paths(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">seq1\nACGTAGATGA\n>other\nAC\n")
    (tmp_path / "r.txt").write_text("seq1\t6\t-\nmissing\t1\n")
    cli.main(["rotate", "-s", str(tmp_path / "r.txt"), "-o", str(tmp_path / "rot"), str(tmp_path / "a.fa")], spark)
    assert text(tmp_path / "rot.fasta").split() == [">seq1", "CTACGTTCAT", ">other", "AC"]
    (tmp_path / "g.gfa").write_text("S\ta\tAACCC\nS\tb\tCCCTT\nS\tc\tTTAA\nL\ta\t+\tb\t+\t3M\nL\tb\t+\tc\t+\t2M\nL\tc\t+\ta\t+\t2M\n")
    (tmp_path / "p.txt").write_text("ring\ta+,b+,c+\nback\tb-,a-\ngap\ta+,c-\n")
    cli.main(["path-to-fasta", "-p", str(tmp_path / "p.txt"), "-n", "3", "-o", str(tmp_path / "out"), str(tmp_path / "g.gfa")], spark)
    got = dict(x.split("\n") for x in text(tmp_path / "out.fasta").lstrip(">").split("\n>"))
    assert got == {"ring": "CCCTTAA", "back": "AAGGGTT", "gap": "AACCCNNNTTAA"}


def test_defaults():
    a = cli.parser().parse_args(["all", "-m", "x", "reads"])
    assert (a.k, a.s, a.min_kmer, a.max_bubble, a.max_copy, a.policy, a.circle_part) == (1001, 31, 30, 100_000, 10, "longest", 0.9)


def test_external_search(spark):
    rows = spark.createDataFrame([(i, f"s{i}", "ACGT" * 5) for i in range(5)], "sid bigint, name string, seq string")
    got = search.search(rows, "none", 40, "grep -c -e > -e {database}").collect()
    assert sum(int(r["value"]) for r in got) == 5 and len(got) == 3


def test_stream_counts_equal_batch(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/syncmers.parquet")
    folder = str(tmp_path / "records")
    rows.coalesce(1).write.parquet(folder)
    source = spark.readStream.schema(rows.schema).parquet(folder)
    query = kmer_counts(source, "1 day", "1 second").writeStream.outputMode("append").format("memory").queryName("stream_counts").start()
    query.processAllAvailable()
    query.stop()
    live = rows.where("del = false and h is not null and rec_id is not null and seen_at is not null").select("rec_id", "h", F.col("seen_at").cast("timestamp").alias("seen_at")).distinct()
    day = live.groupBy(F.window("seen_at", "1 day").alias("w"), "h").agg(F.count(F.lit(1)).alias("n"))
    last = live.agg(F.max("seen_at").alias("m")).first()["m"]
    want = {(r["w"]["start"], r["h"]): r["n"] for r in day.collect() if (last - r["w"]["end"]).total_seconds() > 2}
    got = {(r["beg"], r["h"]): r["n"] for r in spark.table("stream_counts").collect()}
    assert got == want and want


def test_tables_in_the_shared_folder(spark):
    table, n = materialize(spark.range(10))
    assert n == 10 and table.count() == 10 and table.inputFiles()[0].removeprefix("file://").startswith(checkpoint_root(spark).removeprefix("file://"))
    assert materialize(spark.range(0))[1] == 0
    release(spark)


def test_cluster_types_with_equal_sums_in_any_order(spark, sf_dir, tmp_path):
    # Two segments a component, one cluster; types 1 and 3 have the same scores on other genes, in every component in another order. Every
    # fourth component has a tenth more for type 3. Doubles added one by one took many of the equal sums for unequal.
    rng, n, scores = random.Random(7), 60, [473.3, 473.3, 504.9, 504.9, 473.3, 473.3, 104.3]
    rows = {"segments": [], "arcs": [], "annot": []}
    for c in range(n):
        for v in (2 * c, 2 * c + 1):
            rows["segments"].append({"vid": v, "name": f"s{v}", "len": 1000, "cov": 10})
        for v, w in ((4 * c, 4 * c + 2), (4 * c + 3, 4 * c + 1)):
            rows["arcs"].append({"v": v, "w": w, "ln": 0, "ls": 0, "cov": 10, "del": False})
        for t in (1, 3):
            mine = rng.sample(scores, len(scores))
            if t == 3 and c % 4 == 0:
                mine[0] += 0.1
            for g, x in enumerate(mine):
                rows["annot"].append({"hit_id": len(rows["annot"]), "gname": f"g{t}{g}", "sname": f"s{2 * c + rng.randrange(2)}", "evalue": 1e-9, "score": x, "og_type": t})
    for name, own in rows.items():
        schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
        spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in own], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {r["cid"]: r["og_type"] for r in tools.QUERIES["l4_cluster_types"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [2 * c for c in range(n)] and got == {2 * c: 0 if c % 4 else 3 for c in range(n)}
    assert [exact_sums(spark.createDataFrame([(0, x) for x in xs], "k int, x double"), ["k"], "x").first()["x"] for xs in ([1e300, 1.0, 5e-324], [1e308] * 3, [float("inf"), 1.0], [0.0])] == [1e300, float("inf"), float("inf"), 0.0]
