"""Reading annotation tables, and lists of paths and rotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.operators.ordered import numbered
from braidwork.sources.gfa import read_lines

#: The columns of a table of profile hits, with those not kept as None.
COLUMNS = [
    "gname", None, "sname", None, "hmmfrom", "hmmto", "alifrom", "alito", "envfrom", "envto", "modlen", "strand", "evalue", "score", "bias",
]
_INT = {"hmmfrom", "hmmto", "alifrom", "alito", "envfrom", "envto", "modlen"}


def read_hits(spark: SparkSession, path: str, og_type: int) -> DataFrame:
    """Hits of a white-space separated table of profile hits, with ``hit_id`` in the order of lines.

    Lines of white space and those that begin with '#' are skipped. On the reverse strand, where the table has the
    larger limit first, alignment and envelope limits change places. A line with fewer columns is an error.
    """
    rows = read_lines(spark, path).where(~F.col("value").rlike(r"^\s*(#|$)")).withColumn("x", F.split(F.trim("value"), r"\s+"))
    rows = rows.withColumn("x", F.when(F.size("x") >= len(COLUMNS), F.col("x")).otherwise(F.raise_error(F.concat(F.lit("broken hit: "), "value"))))
    rows = numbered(rows, ["f", "b", "i"], "hit_id")
    kind = lambda c: "int" if c in _INT else "double" if c in ("evalue", "score", "bias") else "string"
    rows = rows.select("hit_id", *[F.col("x")[i].cast(kind(c)).alias(c) for i, c in enumerate(COLUMNS) if c])
    back = F.col("strand") == "-"
    turned = {}
    for a, b in (("alifrom", "alito"), ("envfrom", "envto")):
        turned[a] = F.when(back, F.col(b)).otherwise(F.col(a))
        turned[b] = F.when(back, F.col(a)).otherwise(F.col(b))
    return rows.withColumns(turned).withColumn("strand", back.cast("tinyint")).withColumn("og_type", F.lit(og_type))


def all_hits(spark: SparkSession, tables: list[tuple[str, int]]) -> DataFrame:
    """Several tables one after the other, each with its type; hits are numbered through."""
    out = None
    for part, (path, og_type) in enumerate(tables):
        rows = read_hits(spark, path, og_type).withColumn("_part", F.lit(part))
        out = rows if out is None else out.unionByName(rows)
    return numbered(out.withColumnRenamed("hit_id", "_row"), ["_part", "_row"], "hit_id").drop("_part", "_row")


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """``path_id, path`` of a two-column list."""
    return spark.read.csv(path, sep="\t", schema="path_id string, path string")


def read_rotations(spark: SparkSession, path: str) -> DataFrame:
    """``sname, pos, rev`` of a list with a name, a position from 1, and an optional strand."""
    rows = spark.read.csv(path, sep="\t", schema="sname string, pos bigint, strand string", mode="PERMISSIVE")
    return rows.select("sname", "pos", F.coalesce(F.col("strand") == "-", F.lit(False)).alias("rev"))
