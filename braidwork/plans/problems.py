"""Queries and SQL of the general data problems: intervals and skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.operators.intervals import merge_intervals
from braidwork.operators.skew import key_quantiles, out_of_line
from braidwork.storage import materialize
from braidwork.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    annot = table(spark, sf_dir, "annot").withColumn("strand", F.col("strand").cast("int"))
    return merge_intervals(annot, ["sname", "strand"], "alifrom", "alito")


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The live records with h and cov, each delivered record once, as a written table."""
    rows = table(spark, sf_dir, "syncmers").where("del = false and h is not null and cov is not null")
    return materialize(rows.select("rec_id", "h", "cov").distinct())


def _stats(records: DataFrame, total: int) -> DataFrame:
    return materialize(key_quantiles(records, "h", "cov", [0.5], total))[0]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, total = _records(spark, sf_dir)
    return out_of_line(records, "h", "cov", _stats(records, total), total).select("rec_id")


def p4_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, total = _records(spark, sf_dir)
    stats = _stats(records, total)
    far = out_of_line(records, "h", "cov", stats, total).groupBy("h").agg(F.count(F.lit(1)).alias("n_out"))
    return stats.join(far, "h", "left").select(
        "h", "n", F.col("total").alias("total_cov"), F.col("q0").alias("median_cov"),
        F.coalesce("n_out", F.lit(0)).cast("bigint").alias("n_out"),
    )


_LIVE = """live AS (SELECT DISTINCT rec_id, h, cov FROM syncmers WHERE del = false AND h IS NOT NULL AND cov IS NOT NULL),
stats AS (SELECT h, count(*) AS n, sum(cov)::BIGINT AS total_cov, quantile_cont(cov::DOUBLE, 0.5) AS median_cov FROM live GROUP BY h),
far AS (SELECT rec_id, h FROM live JOIN stats USING (h) WHERE n >= 5 AND (cov >= 5 * median_cov OR 5 * cov <= median_cov))"""

QUERIES = {"p3_found": p3_found, "p4_found": p4_found, "p4_keys": p4_keys}

SQL = {
    "p3_found": """
WITH x AS (
  SELECT sname, strand::INT AS strand, least(alifrom, alito)::BIGINT AS b, greatest(alifrom, alito)::BIGINT AS f
  FROM annot WHERE sname IS NOT NULL AND strand IS NOT NULL AND alifrom IS NOT NULL AND alito IS NOT NULL),
y AS (SELECT *, max(f) OVER (PARTITION BY sname, strand ORDER BY b, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM x),
z AS (SELECT *, sum(CASE WHEN prev IS NULL OR b > prev + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY sname, strand ORDER BY b, f ROWS UNBOUNDED PRECEDING) AS run FROM y),
p AS (SELECT sname, strand, run, min(b) AS beg, max(f) AS fin FROM z GROUP BY ALL),
g AS (SELECT sname, strand, lag(fin) OVER (PARTITION BY sname, strand ORDER BY beg) + 1 AS beg, beg - 1 AS fin FROM p)
SELECT 'period' AS kind, sname, strand, beg, fin FROM p
UNION ALL SELECT 'gap', sname, strand, beg, fin FROM g WHERE beg IS NOT NULL""",
    "p4_found": f"WITH {_LIVE} SELECT rec_id FROM far",
    "p4_keys": f"WITH {_LIVE} SELECT h, n, total_cov, median_cov, count(far.rec_id) AS n_out FROM stats LEFT JOIN far USING (h) GROUP BY ALL",
}
