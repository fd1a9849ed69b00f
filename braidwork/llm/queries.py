"""Queries of the training-data operators over the project's tables, and SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm import components, encode, frequent, mixing, repetition, topn
from braidwork.tables import table

BEST_HITS = 3
ONE_IN = 250
_ORDER = [("score", "desc"), ("evalue", "asc"), ("gname", "asc"), ("hit_id", "asc")]


def p1_top_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "annot").where("score is not null and not isnan(score)")
    return topn.top_n_per_group(hits, "sname", _ORDER, BEST_HITS)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_top_hits(spark, sf_dir).select("sname", "hit_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = table(spark, sf_dir, "arcs").where("del = false and v is not null and w is not null")
    pairs = arcs.select(F.shiftright("v", 1).alias("a"), F.shiftright("w", 1).alias("b"))
    groups = components.connected_groups(pairs, "a", "b")
    return groups.select(F.col("root").alias("root_vid"), F.col("node").alias("vid"))


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "syncmers").where("del = false").select("rec_id", "h", "s").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent.frequent_values(_live(spark, sf_dir), ["h", "s"], ONE_IN).select("col_name", "item")


def p5_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent.top_values(_live(spark, sf_dir), "h", 100)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_texts(table(spark, sf_dir, "documents"))


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document its size in characters and whether its ids decode to its text; null decodes to the empty one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    back = encode.decode_ids(encode.encode_texts(docs, "doc_id", "body"))
    both = docs.join(back, "doc_id", "left")
    return both.select("doc_id", F.length("body").cast("bigint").alias("chars"), F.coalesce(F.col("text") == F.col("body"), F.lit(False)).alias("equal"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repeated_words(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetitive(p8_shares(spark, sf_dir)).select("doc_id")


def p8_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.language_divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found, "p1_top_hits": p1_top_hits, "p2_found": p2_found, "p5_found": p5_found, "p5_top": p5_top,
    "p6_ids": p6_ids, "p6_round_trip": p6_round_trip, "p7_mixture": p7_mixture, "p7_shares": p7_shares,
    "p8_found": p8_found, "p8_shares": p8_shares, "p8_divergence": p8_divergence,
}

_RANKED = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY sname ORDER BY score DESC, evalue ASC NULLS LAST, gname ASC NULLS LAST, hit_id) AS rank
  FROM (SELECT DISTINCT sname, hit_id, score, evalue, gname FROM annot WHERE sname IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)))"""
_WORDS = r"""w AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '\p{L}+'), lambda x: lower(x)) AS w FROM documents),
gram AS (SELECT doc_id, i, w[i:i + 4] AS g FROM w, range(1, len(w) - 3) t(i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(i) OVER (PARTITION BY doc_id, g) AS first FROM gram) WHERE i > first),
marked AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM again, range(0, 5) t(o) GROUP BY doc_id),
measured AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_repeated FROM w LEFT JOIN marked USING (doc_id))"""
_REC = "live AS (SELECT DISTINCT rec_id, h, s FROM syncmers WHERE del = false)"

SQL = {
    "p1_found": f"WITH {_RANKED} SELECT sname, hit_id FROM ranked WHERE rank <= {BEST_HITS}",
    "p1_top_hits": f"WITH {_RANKED} SELECT sname, rank::INT AS rank, score, evalue, gname, hit_id FROM ranked WHERE rank <= {BEST_HITS}",
    "p6_round_trip": "SELECT doc_id, coalesce(length(text), 0)::BIGINT AS chars, true AS equal FROM documents",
    "p2_found": """
WITH RECURSIVE e AS (
  SELECT DISTINCT v >> 1 AS a, w >> 1 AS b FROM arcs WHERE del = false AND v IS NOT NULL AND w IS NOT NULL),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
g(node, root) USING KEY (node) AS (
  SELECT a AS node, min(least(a, b)) AS root FROM both_ways GROUP BY a
  UNION
  SELECT x.b AS node, min(g.root) AS root FROM g JOIN both_ways x ON x.a = g.node JOIN recurring.g AS old ON old.node = x.b
  WHERE g.root < old.root GROUP BY x.b)
SELECT root AS root_vid, node AS vid FROM g WHERE root <> node""",
    "p8_shares": f"WITH {_WORDS} SELECT doc_id, n_words, n_repeated, CASE WHEN n_words > 0 THEN n_repeated / n_words ELSE 0.0 END::DOUBLE AS share FROM measured",
    "p8_found": f"WITH {_WORDS} SELECT doc_id FROM measured WHERE n_words >= 20 AND 10 * n_repeated >= 3 * n_words",
    "p5_found": f"""
WITH {_REC}, c AS (SELECT 'h' AS col_name, h AS item, count(*) AS n FROM live GROUP BY h UNION ALL SELECT 's', s, count(*) FROM live GROUP BY s)
SELECT col_name, item FROM c WHERE item IS NOT NULL AND n * {ONE_IN} >= (SELECT count(*) FROM live)""",
    "p5_top": f"WITH {_REC} SELECT 'h' AS col_name, h AS item, count(*) AS n FROM live WHERE h IS NOT NULL GROUP BY h ORDER BY n DESC, item LIMIT 100",
}
