"""Lines of GFA, BED and FASTA as DataFrames with one column ``value``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.functions.sequence import wrap
from braidwork.operators.graph import turned

#: Fixed value: the first line of a BED file.
BED_HEADER = "#seq_name\tstart\tend\tgene\tscore\tstrand"


def segment_lines(vertices: DataFrame, with_seq: bool = True) -> DataFrame:
    """S-lines with length, k-mer count (length times coverage) and coverage."""
    seq = F.coalesce("seq", F.lit("*")) if with_seq else F.lit("*")
    text = F.format_string(
        "S\t%s\t%s\tLN:i:%d\tKC:i:%d\tSC:f:%.3f", F.col("name"), seq, F.col("len"), (F.col("len") * F.col("cov")).cast("bigint"), F.col("cov").cast("double")
    )
    return vertices.select("vid", text.alias("value"))


def link_lines(vertices: DataFrame, arcs: DataFrame, both: bool = False) -> DataFrame:
    """L-lines with overlap and coverage; of a link and its twin only one unless ``both``."""
    if not both:
        own = (F.col("v") < turned("w")) | ((F.col("v") == turned("w")) & (F.col("w") <= turned("v")))
        arcs = arcs.where(own)
    name = lambda a, b: vertices.select(F.col("vid").alias(a), F.col("name").alias(b))
    rows = arcs.withColumns({"_a": F.shiftright("v", 1), "_b": F.shiftright("w", 1)}).join(name("_a", "an"), "_a").join(name("_b", "bn"), "_b")
    sign = lambda c: F.when(F.col(c) % 2 != 0, "-").otherwise("+")
    text = F.format_string("L\t%s\t%s\t%s\t%s\t%dM\tEC:i:%d", F.col("an"), sign("v"), F.col("bn"), sign("w"), F.col("ls"), F.col("cov"))
    return rows.select("v", "w", text.alias("value"))


def gfa_lines(vertices: DataFrame, arcs: DataFrame, both: bool = False, with_seq: bool = True) -> DataFrame:
    """Header, segments in the order of their number, links in that of their ends; sorted by ranges."""
    spark = vertices.sparkSession
    zero = F.lit(0).cast("bigint")
    head = spark.createDataFrame([("H\tVN:Z:1.0",)], "value string").select(F.lit(0).alias("k"), zero.alias("a"), zero.alias("b"), "value")
    s = segment_lines(vertices, with_seq).select(F.lit(1).alias("k"), F.col("vid").alias("a"), zero.alias("b"), "value")
    k = link_lines(vertices, arcs, both).select(F.lit(2).alias("k"), F.col("v").alias("a"), F.col("w").alias("b"), "value")
    return head.unionByName(s).unionByName(k).orderBy("k", "a", "b").select("value")


def bed_lines(places: DataFrame) -> DataFrame:
    """The rows of a BED file below its header, by sequence, start and end."""
    rows = places.orderBy("seq", "start", "end", "gene" if "gene" in places.columns else "gname", "strand")
    gene = "gene" if "gene" in places.columns else "gname"
    return rows.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("seq", "start", "end", gene, "score", "strand")]).alias("value"))


def sequence_lines(rows: DataFrame, name: str = "name", seq: str = "seq", width: int = 60) -> DataFrame:
    """FASTA records of a name and a sequence; a null sequence is written empty."""
    return rows.select(F.concat_ws("\n", F.concat(F.lit(">"), name), wrap(F.coalesce(F.col(seq), F.lit("")), width)).alias("value"))


def write_lines(lines: DataFrame, path: str, header: str | None = None, one_file: bool = False) -> None:
    """Write text; ``one_file`` brings all lines into one task, for results meant for a person. A header needs one file."""
    if header is not None:
        head = lines.sparkSession.createDataFrame([(header,)], "value string")
        lines, one_file = head.unionByName(lines.select("value")), True
    (lines.coalesce(1) if one_file else lines).write.mode("overwrite").text(path)


def output_names(prefix: str) -> dict[str, str]:
    """Where a run writes: assembly graphs, and for each type the graph, annotation, contigs and their annotation."""
    names = {"unitigs": f"{prefix}.utg.gfa", "final": f"{prefix}.utg.final.gfa"}
    for kind in ("mito", "pltd", "mini"):
        names |= {f"{kind}_{what}": f"{prefix}.{kind}.{ext}" for what, ext in (("graph", "gfa"), ("bed", "bed"), ("contigs", "ctg.fasta"), ("contig_bed", "ctg.bed"))}
    return names
