"""Command line: ``python -m braidwork.cli COMMAND ...``; every number has the default of the configurations."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.functions import sequence as q
from braidwork.operators import annotation, paths
from braidwork.plans.assemble import AssemblyConfig, PathConfig, assemble, contigs, find_paths
from braidwork.sinks import lines
from braidwork.sources import gfa, hits, search, sequences
from braidwork.storage import materialize

KINDS = {annotation.MITO: "mito", annotation.PLTD: "pltd", annotation.MINI: "mini"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="braidwork", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        c.add_argument("-o", "--prefix", default="./braidwork", help="where results are written")
        return c

    def assembly(c: argparse.ArgumentParser) -> None:
        d = AssemblyConfig()
        c.add_argument("-k", type=int, default=d.k)
        c.add_argument("-s", type=int, default=d.s)
        c.add_argument("-c", "--min-kmer", type=int, default=d.min_kmer, help="least coverage of a k-mer; 0: from the histogram")
        c.add_argument("-a", "--arc-part", type=float, default=d.arc_part, help="least coverage of an arc, as a part of its ends'")
        c.add_argument("-D", "--max-bases", type=sequences.size_of, default=0, help="bases to read, with K, M or G; 0: all")
        c.add_argument("--unzip-round", type=int, default=d.unzip_rounds)
        c.add_argument("--no-read-ec", action="store_true")

    def cleaning(c: argparse.ArgumentParser) -> None:
        d = PathConfig()
        c.add_argument("--max-bubble", type=int, default=d.bubble)
        c.add_argument("--max-tip", type=int, default=d.tip)
        c.add_argument("--weak-cross", type=float, default=d.weak)

    def finding(c: argparse.ArgumentParser) -> None:
        d, r = PathConfig(), annotation.ClassRules()
        c.add_argument("-m", "--mito", help="annotation table, mitochondrial")
        c.add_argument("-p", "--pltd", help="annotation table, plastid")
        c.add_argument("-f", "--circle-part", type=float, default=d.circle_part)
        c.add_argument("-S", "--min-score", type=float, default=r.min_score)
        c.add_argument("-e", "--max-evalue", type=float, default=r.max_evalue)
        c.add_argument("-g", "--gene-gain", type=lambda x: [int(n) for n in x.split(",")], default=list(d.gains), help="genes that a further component must bring, plastid[,mitochondrial]")
        c.add_argument("-l", "--min-len", type=int, default=r.min_len)
        c.add_argument("-q", "--min-fraction", type=float, default=d.min_fraction)
        c.add_argument("-C", "--max-copy", type=int, default=d.max_copy)
        c.add_argument("-N", "--max-path", type=int, default=d.max_paths)
        c.add_argument("--include-trn", action="store_true")
        c.add_argument("--include-rrn", action="store_true")
        c.add_argument("--no-graph-clean", action="store_true")
        c.add_argument("--edge-c-tag", default="EC:i")
        c.add_argument("--kmer-c-tag")
        c.add_argument("--seq-c-tag", default="SC:f")
        g = c.add_mutually_exclusive_group()
        for policy in ("longest", "circular", "all"):
            g.add_argument(f"--{policy}", dest="policy", action="store_const", const=policy)
        c.set_defaults(policy="longest")

    c = command("assemble", "reads to an assembly graph")
    assembly(c), cleaning(c)
    c.add_argument("reads", nargs="+")
    c = command("annotate", "search sequences with an installed program")
    c.add_argument("database")
    c.add_argument("files", nargs="+")
    c.add_argument("-b", "--batch", type=sequences.size_of, default=1_000_000)
    c.add_argument("--program", default=search.COMMAND)
    c = command("paths", "a graph and annotation tables to organelle paths")
    cleaning(c), finding(c)
    c.add_argument("graph")
    c = command("all", "reads and annotation tables to organelle paths")
    assembly(c), cleaning(c), finding(c)
    c.add_argument("reads", nargs="+")
    c = command("path-to-fasta", "paths over a graph to sequences")
    c.add_argument("graph")
    c.add_argument("-p", "--path-file", required=True)
    c.add_argument("-l", "--line-width", type=int, default=60)
    c.add_argument("-n", "--gap-size", type=int, default=paths.GAP)
    c.add_argument("--linear", action="store_true")
    c = command("rotate", "circular sequences begun elsewhere")
    c.add_argument("files", nargs="+")
    c.add_argument("-s", "--rotation-file", required=True)
    c.add_argument("-l", "--line-width", type=int, default=60)
    return p


def _assembly(a: argparse.Namespace) -> AssemblyConfig:
    return AssemblyConfig(a.k, a.s, a.min_kmer, a.arc_part, a.max_bases, a.max_bubble, a.max_tip, a.weak_cross, a.unzip_round, not a.no_read_ec)


def _paths(a: argparse.Namespace) -> PathConfig:
    rules = annotation.ClassRules(a.max_evalue, a.include_trn, a.include_rrn, 0, a.min_score, a.min_len)
    return PathConfig(rules, a.circle_part, a.min_fraction, a.max_copy, a.max_path, a.policy, not a.no_graph_clean, a.max_bubble, a.max_tip, a.weak_cross, tuple((a.gene_gain * 2)[:2]), a.min_len)


def write_assembly(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    made = assemble(sequences.read_sequences(spark, a.reads), _assembly(a))
    name = F.concat(F.lit("u"), F.col("uid").cast("string"))
    vertices = made.unitigs.select(F.col("uid").alias("vid"), name.alias("name"), "seq", "len", "cov")
    arcs = made.links.select("v", "w", "ls", "cov")
    lines.write_lines(lines.gfa_lines(vertices, arcs, both=True), lines.output_names(a.prefix)["final"])
    return vertices, arcs


def write_paths(spark: SparkSession, a: argparse.Namespace, vertices: DataFrame, arcs: DataFrame) -> None:
    tables = [(path, kind) for path, kind in ((a.mito, annotation.MITO), (a.pltd, annotation.PLTD)) if path]
    if not tables:
        raise SystemExit("an annotation table is needed: -m or -p")
    found = find_paths(vertices, arcs, hits.all_hits(spark, tables), _paths(a))
    names = lines.output_names(a.prefix)
    seqs, _ = materialize(contigs(found, vertices, arcs).join(found.classes.select("cid", "og_type"), "cid"))
    for kind, label in KINDS.items():
        own = seqs.where(F.col("og_type") == kind)
        label_of = lambda c: F.format_string("ctg%06d", F.col(c))
        rest = found.rest.where(F.col("og_type") == kind).join(vertices.select("vid", "name", "seq"), "vid")
        written = own.select(label_of("cid").alias("name"), "seq").unionByName(rest.select(F.concat_ws("_", label_of("cid"), "name").alias("name"), "seq"))
        lines.write_lines(lines.sequence_lines(written), names[f"{label}_contigs"])
        placed = found.places.join(own.select("cid"), F.col("seq") == F.col("cid"), "left_semi").withColumn("seq", label_of("seq"))
        lines.write_lines(lines.bed_lines(placed), names[f"{label}_contig_bed"], lines.BED_HEADER, one_file=True)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    tags = lambda: {"kmer_tag": a.kmer_c_tag, "seq_tag": a.seq_c_tag, "arc_tag": a.edge_c_tag}
    if a.command == "assemble":
        write_assembly(spark, a)
    elif a.command == "all":
        write_paths(spark, a, *write_assembly(spark, a))
    elif a.command == "paths":
        write_paths(spark, a, *gfa.read_graph(spark, a.graph, **tags()))
    elif a.command == "annotate":
        rows = sequences.read_sequences(spark, a.files)
        lines.write_lines(search.as_table(search.search(rows, a.database, a.batch, a.program)), f"{a.prefix}.annot.txt")
    elif a.command == "path-to-fasta":
        vertices, arcs = gfa.read_graph(spark, a.graph)
        listed = hits.read_paths(spark, a.path_file).select("path_id", F.posexplode(q.path_steps("path")).alias("pos", "x"))
        known = listed.join(vertices.select(F.col("name").alias("_n"), "vid"), F.col("x.name") == F.col("_n"), "left")
        bad = F.col("vid").isNull() | F.col("x.rev").isNull()
        v = F.when(bad, F.raise_error(F.concat(F.lit("unknown segment: "), "x.name"))).otherwise(F.col("vid") * 2 + F.col("x.rev"))
        steps, _ = materialize(known.select("path_id", "pos", v.cast("bigint").alias("v")))
        closed = paths.path_metrics(steps, vertices, arcs).where("circ").select("path_id")
        ring = steps.join(closed, "path_id", "left_semi") if not a.linear else steps.limit(0)
        line = steps.join(closed, "path_id", "left_anti") if not a.linear else steps
        seqs = paths.path_sequences(ring, vertices, arcs, True, a.gap_size).unionByName(paths.path_sequences(line, vertices, arcs, False, a.gap_size))
        lines.write_lines(lines.sequence_lines(seqs, "path_id", "seq", a.line_width), f"{a.prefix}.fasta")
    elif a.command == "rotate":
        rows = sequences.read_sequences(spark, a.files).withColumnRenamed("name", "sname")
        turn = rows.join(hits.read_rotations(spark, a.rotation_file), "sname", "left")
        far = F.col("pos") > F.length("seq")
        new = F.when(F.col("pos").isNull(), F.col("seq")).when(far, F.raise_error(F.concat(F.lit("position beyond the end of "), "sname"))).otherwise(q.rotate_sequence("seq", "pos", "rev"))
        lines.write_lines(lines.sequence_lines(turn.orderBy("sid").select("sname", new.alias("seq")), "sname", "seq", a.line_width), f"{a.prefix}.fasta")


if __name__ == "__main__":
    main()
