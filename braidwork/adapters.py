"""Clean views of the project's tables: what the graph operators take as input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.tables import table


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sid, idx, rev, kid, smer``: the live records with a read and a k-mer, each delivered once."""
    rows = table(spark, sf_dir, "syncmers").where("del = false and sid is not null and idx is not null and h is not null")
    rows = rows.select("rec_id", "sid", "idx", F.coalesce("rev", F.lit(0)).cast("int").alias("rev"), "h", "s").distinct()
    return rows.select("rec_id", "sid", "idx", "rev", F.col("h").alias("kid"), F.col("s").alias("smer"))


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v, w, ln, ls, cov``: one row for each live oriented pair, with the highest coverage and overlap."""
    rows = table(spark, sf_dir, "arcs").where("del = false and v is not null and w is not null")
    at_most = [F.coalesce(F.max(c), F.lit(0)).cast("bigint").alias(c) for c in ("ln", "ls", "cov")]
    return rows.groupBy("v", "w").agg(*at_most)


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vid, name, seq, len, cov`` with null coverage as 1 and null length as that of the sequence."""
    rows = table(spark, sf_dir, "segments")
    size = F.coalesce("len", F.length("seq"), F.lit(0)).cast("bigint")
    return rows.select("vid", "name", "seq", size.alias("len"), F.coalesce("cov", F.lit(1)).cast("bigint").alias("cov"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation hits, each delivered once, with gene, segment and a real score."""
    rows = table(spark, sf_dir, "annot").drop("run_at", "loaded_at").distinct()
    return rows.where("gname is not null and sname is not null and score is not null and not isnan(score)")
