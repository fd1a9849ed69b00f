"""Queries and SQL of the scalar sequence functions and of the operators on occurrences."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork.adapters import occurrences
from braidwork.functions import sequence as q
from braidwork.operators import occurrence as o
from braidwork.operators import syncmer
from braidwork.tables import table


def _reads(column):
    """A query that adds ``value`` to every read."""

    def run(spark, sf_dir):
        reads = table(spark, sf_dir, "reads")
        return reads.select("sid", column().alias("value"))

    return run


_UP = "replace(upper(seq), 'U', 'T')"
_RC = "reverse(translate(upper({0}), 'ACGTUNRYSWKMBDHV', 'TGCAANYRSWMKVHDB'))"
_RUNS = f"regexp_extract_all({_UP}, 'A+|C+|G+|T+|[^ACGT]')"
_HOCO = f"regexp_replace(array_to_string(list_transform({_RUNS}, lambda r: r[1]), ''), '[^ACGT]', 'A', 'g')"
_W5 = f"list_transform(range(1, length({_HOCO}) - 3), lambda i: substr({_HOCO}, i, 5))"
_CODE = "list_reduce(list_transform(string_split({0}, ''), lambda c: (strpos('ACGT', c) - 1)::BIGINT), lambda x, y: x * 4 + y)"
_OCC = """occ AS (SELECT DISTINCT rec_id, sid, idx, coalesce(rev, 0)::INT AS rev, h AS kid, s AS smer FROM syncmers
  WHERE del = false AND sid IS NOT NULL AND idx IS NOT NULL AND h IS NOT NULL)"""


def _pairs(d: int = 1) -> str:
    over = "OVER (PARTITION BY sid ORDER BY idx, kid, rev)"
    return f"""step{d} AS (SELECT * FROM (SELECT sid, idx, kid, rev, lead(kid, {d}) {over} AS kid2, lead(rev, {d}) {over} AS rev2, lead(idx, {d}) {over} AS idx2 FROM occ) WHERE kid2 IS NOT NULL),
canon{d} AS (SELECT CASE WHEN (kid, rev, kid2, rev2) <= (kid2, 1 - rev2, kid, 1 - rev) THEN {{'va': kid, 'vr': rev, 'wa': kid2, 'wr': rev2}}
  ELSE {{'va': kid2, 'vr': 1 - rev2, 'wa': kid, 'wr': 1 - rev}} END AS k, idx2 - idx AS step FROM step{d}),
cov{d} AS (SELECT k.va AS va, k.vr AS vr, k.wa AS wa, k.wr AS wr, count(*) AS cov FROM canon{d} GROUP BY ALL)"""


_KM = "km AS (SELECT kid, count(*) AS cov, min(smer) AS smer, coalesce(min(smer) = max(smer), true) AS consistent FROM occ GROUP BY kid)"
MIN_COV, MIN_FRACTION = 3, 0.35
_GRAPH = f"""{_OCC}, {_pairs()}, {_KM},
kept AS (SELECT c.* FROM cov1 c JOIN km a ON a.kid = va JOIN km b ON b.kid = wa WHERE a.cov >= {MIN_COV} AND b.cov >= {MIN_COV} AND c.cov >= {MIN_FRACTION} * least(a.cov, b.cov))"""


def _occ(spark, sf_dir):
    return occurrences(spark, sf_dir)


def arc_coverage(spark, sf_dir):
    return o.arc_coverage(_occ(spark, sf_dir))


def refreshed(spark, sf_dir):
    occ = _occ(spark, sf_dir)
    known = o.kmer_graph(occ, MIN_COV, MIN_FRACTION)[1]
    return o.refresh_coverage(known, occ)


def supported(spark, sf_dir):
    occ = _occ(spark, sf_dir)
    return o.supported_arcs(o.arc_coverage(occ), o.kept_kmers(o.kmer_table(occ), MIN_COV), MIN_FRACTION)


def peaks(spark, sf_dir):
    hist = [(r["mult"], r["n"]) for r in o.count_of_counts(_occ(spark, sf_dir), "kid").collect()]
    het, hom = o.coverage_peaks(hist)
    return spark.createDataFrame([(het, hom, o.automatic_cutoff(het, hom))], "het int, hom int, cutoff int")


def regression(spark, sf_dir):
    occ = _occ(spark, sf_dir)
    got = o.spacing_regression(occ, o.kmer_table(occ), [1, 2, 3])
    return got.select("gap", "links", *[F.round(c, 6).alias(c) for c in ("slope", "error", "r2")])


def limits(spark, sf_dir):
    return o.within_limits(_occ(spark, sf_dir), table(spark, sf_dir, "reads"))


def stats(spark, sf_dir):
    occ = _occ(spark, sf_dir)
    got = o.occurrence_stats(occ, o.kmer_table(occ))
    return got.withColumns({c: F.round(c, 6) for c in ("mean_cov", "mean_step")})


def compressed(spark, sf_dir):
    reads = table(spark, sf_dir, "reads").where("seq is not null")
    return reads.select("sid", q.compress_runs("seq").alias("seq"))


def small_words(spark, sf_dir):
    got = compressed(spark, sf_dir).select("sid", F.posexplode(q.small_words("seq", 5)).alias("pos", "w")).where("w is not null")
    return got.select("sid", "pos", F.col("w.code").alias("code"), F.col("w.rev").cast("int").alias("rev"), q.mix_bits(F.col("w.code"), 10).alias("mixed"))


def words_at(spark, sf_dir):
    at = occurrences(spark, sf_dir).join(compressed(spark, sf_dir), "sid").where(F.col("idx") + 21 <= F.length("seq"))
    word = q.word_at("seq", "idx", 21, "rev")
    return at.select("sid", "idx", "rev", word.alias("word"), q.canonical_word(word).alias("canonical"))


def rotated(spark, sf_dir):
    reads = table(spark, sf_dir, "reads").where("length(seq) > 0")
    pos = F.col("sid") % F.length("seq") + 1
    return reads.select("sid", q.rotate_sequence("seq", pos, F.col("sid") % 2 == 1).alias("value"))


def same_by_sql(spark, sf_dir):
    return syncmer.closed_syncmers_sql(compressed(spark, sf_dir), 15, 5)


def by_arrays(spark, sf_dir):
    return syncmer.closed_syncmers(compressed(spark, sf_dir), 31, 11)


QUERIES = {
    "a2_arc_coverage": arc_coverage,
    "a3_refreshed_coverage": refreshed,
    "a1_kmer_table": lambda s, d: o.kmer_table(_occ(s, d)),
    "f1_kept_kmers": lambda s, d: o.kept_kmers(o.kmer_table(_occ(s, d)), MIN_COV).select("kid", "cov", "del"),
    "f2_supported_arcs": supported,
    "g1_kmer_graph_arcs": lambda s, d: o.kmer_graph(_occ(s, d), MIN_COV, MIN_FRACTION)[1],
    "j1_next_occurrence": lambda s, d: o.neighbours(_occ(s, d)),
    "w2_third_next_occurrence": lambda s, d: o.neighbours(_occ(s, d), 3),
    "a4_kmer_histogram": lambda s, d: o.count_of_counts(_occ(s, d), "kid"),
    "a4_smer_histogram": lambda s, d: o.count_of_counts(_occ(s, d).where("smer is not null"), "smer"),
    "k6_histogram_bars": lambda s, d: o.histogram_bars(o.count_of_counts(_occ(s, d), "kid")),
    "a5_occurrence_stats": stats,
    "a24_coverage_peaks": peaks,
    "a23_spacing_regression": regression,
    "a26_limits": limits,
    "seq_p1_encoded": _reads(lambda: q.encode_bases("seq")),
    "seq_p2_reverse_complement": _reads(lambda: q.reverse_complement("seq")),
    "seq_p3_compressed": _reads(lambda: q.compress_runs("seq")),
    "seq_p3_run_lengths": _reads(lambda: q.run_lengths("seq")),
    "seq_p4_small_words": small_words,
    "seq_p7_words": words_at,
    "seq_p8_expanded": _reads(lambda: q.expand_runs(q.compress_runs("seq"), q.run_lengths("seq"))),
    "seq_p11_rotated": rotated,
    "w1_closed_syncmers": by_arrays,
    "w1_closed_syncmers_sql": same_by_sql,
}

SQL = {
    "a2_arc_coverage": f"WITH {_OCC}, {_pairs()} SELECT * FROM cov1",
    "a1_kmer_table": f"WITH {_OCC}, {_KM} SELECT * FROM km",
    "f1_kept_kmers": f"WITH {_OCC}, {_KM} SELECT kid, cov, cov < {MIN_COV} AS del FROM km",
    "f2_supported_arcs": f"WITH {_GRAPH} SELECT * FROM kept",
    "g1_kmer_graph_arcs": f"WITH {_GRAPH} SELECT va, vr, wa, wr, cov, false AS comp FROM kept UNION ALL SELECT wa, 1 - wr, va, 1 - vr, cov, true FROM kept WHERE NOT (va = wa AND vr <> wr)",
    "a3_refreshed_coverage": f"WITH {_GRAPH} SELECT va, vr, wa, wr, cov FROM kept UNION ALL SELECT wa, 1 - wr, va, 1 - vr, cov FROM kept WHERE NOT (va = wa AND vr <> wr)",
    "j1_next_occurrence": f"WITH {_OCC}, {_pairs()} SELECT sid, idx, kid, rev, kid2, rev2, idx2 FROM step1",
    "w2_third_next_occurrence": f"WITH {_OCC}, {_pairs(3)} SELECT sid, idx, kid, rev, kid2, rev2, idx2 FROM step3",
    "a4_kmer_histogram": f"WITH {_OCC}, {_KM} SELECT least(cov, 1000) AS mult, count(*) AS n FROM km GROUP BY 1",
    "a4_smer_histogram": f"WITH {_OCC}, x AS (SELECT smer, count(*) AS c FROM occ WHERE smer IS NOT NULL GROUP BY smer) SELECT least(c, 1000) AS mult, count(*) AS n FROM x GROUP BY 1",
    "k6_histogram_bars": f"WITH {_OCC}, {_KM}, x AS (SELECT least(cov, 1000) AS mult, count(*) AS n FROM km GROUP BY 1) SELECT mult, n, repeat('*', (n * 100 // max(n) OVER ())::INT) AS bar FROM x",
    "a5_occurrence_stats": f"""WITH {_OCC}, {_pairs()}, {_KM}
SELECT (SELECT count(DISTINCT sid) FROM occ) AS reads, (SELECT count(*) FROM occ) AS occurrences, (SELECT max(n) FROM (SELECT count(*) AS n FROM occ GROUP BY sid)) AS most_on_read,
 count(*) AS kmers, count(*) FILTER (cov = 1) AS singletons, round(avg(cov), 6) AS mean_cov, (SELECT round(avg(idx2 - idx), 6) FROM step1) AS mean_step FROM km""",
    "a23_spacing_regression": f"WITH {_OCC}, {_KM}, " + ", ".join(_pairs(d) for d in (1, 2, 3)) + "".join(f""",
l{d} AS (SELECT least(a.cov, b.cov)::DOUBLE AS x, c.cov::DOUBLE AS y FROM cov{d} c JOIN km a ON a.kid = va JOIN km b ON b.kid = wa),
m{d} AS (SELECT count(*) AS links, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy FROM l{d} WHERE y / x >= (SELECT quantile_cont(y / x, 0.05) FROM l{d}) AND y / x <= (SELECT quantile_cont(y / x, 0.95) FROM l{d}))""" for d in (1, 2, 3))
    + " UNION ALL ".join(f" SELECT {d} AS gap, links, round(xy / xx, 6) AS slope, round(sqrt(greatest(yy - xy / xx * xy, 0) / (links - 1) / xx), 6) AS error, round(1 - (yy - xy / xx * xy) / yy, 6) AS r2 FROM m{d}" for d in (1, 2, 3)),
    "a26_limits": f"WITH {_OCC} SELECT (SELECT max(sid) FROM reads) AS top_sid, (SELECT max(n) FROM (SELECT count(*) AS n FROM occ GROUP BY sid)) AS most, true AS ok",
    "seq_p1_encoded": f"SELECT sid, regexp_replace(translate({_UP}, 'ACGT', '0123'), '[^0123]', '4', 'g') AS value FROM reads",
    "seq_p2_reverse_complement": f"SELECT sid, {_RC.format('seq')} AS value FROM reads",
    "seq_p3_compressed": f"SELECT sid, {_HOCO} AS value FROM reads",
    "seq_p3_run_lengths": f"SELECT sid, list_transform({_RUNS}, lambda r: length(r)::INT) AS value FROM reads",
    "seq_p8_expanded": f"SELECT sid, regexp_replace({_UP}, '[^ACGT]', 'A', 'g') AS value FROM reads",
    "seq_p4_small_words": f"""
WITH h AS (SELECT sid, {_HOCO} AS seq FROM reads WHERE seq IS NOT NULL),
w AS (SELECT sid, i::INT AS pos, substr(seq, i + 1, 5) AS f, reverse(translate(substr(seq, i + 1, 5), 'ACGT', 'TGCA')) AS r FROM h, range(0, length(seq) - 4) t(i)),
c AS (SELECT sid, pos, {_CODE.format("least(f, r)")} AS code, (r < f)::INT AS rev FROM w WHERE f <> r),
m1 AS (SELECT *, (((-1 - code) + (code << 21)) & 1023) AS a FROM c), m2 AS (SELECT *, xor(a, a >> 24) AS b FROM m1),
m3 AS (SELECT *, (b + (b << 3) + (b << 8)) & 1023 AS d FROM m2), m4 AS (SELECT *, xor(d, d >> 14) AS e FROM m3),
m5 AS (SELECT *, (e + (e << 2) + (e << 4)) & 1023 AS g FROM m4), m6 AS (SELECT *, xor(g, g >> 28) AS x FROM m5)
SELECT sid, pos, code, rev, (x + (x << 31)) & 1023 AS mixed FROM m6""",
    "seq_p7_words": f"""
WITH {_OCC}, h AS (SELECT sid, {_HOCO} AS seq FROM reads WHERE seq IS NOT NULL),
w AS (SELECT sid, idx, rev, CASE WHEN rev <> 0 THEN {_RC.format("substr(seq, idx + 1, 21)")} ELSE substr(seq, idx + 1, 21) END AS word FROM occ JOIN h USING (sid) WHERE idx + 21 <= length(seq))
SELECT *, least(word, {_RC.format("word")}) AS canonical FROM w""",
    "seq_p11_rotated": f"""
WITH r AS (SELECT sid, seq, (sid % length(seq) + 1)::INT AS p FROM reads WHERE length(seq) > 0)
SELECT sid, CASE WHEN sid % 2 = 1 THEN {_RC.format("substr(seq, 1, p)")} || {_RC.format("substr(seq, p + 1)")} ELSE substr(seq, p) || substr(seq, 1, p - 1) END AS value FROM r""",
    "w1_closed_syncmers_sql": f"""
WITH h AS (SELECT sid, {_HOCO} AS seq FROM reads WHERE seq IS NOT NULL),
w AS (SELECT sid, i::INT AS pos, substr(seq, i + 1, 5) AS f, reverse(translate(substr(seq, i + 1, 5), 'ACGT', 'TGCA')) AS r FROM h, range(0, length(seq) - 4) t(i)),
c AS (SELECT sid, pos, f, r, CASE WHEN f <> r THEN {_CODE.format("least(f, r)")} END AS code FROM w),
m1 AS (SELECT *, (((-1 - code) + (code << 21)) & 1023) AS a FROM c), m3 AS (SELECT *, (a + (a << 3) + (a << 8)) & 1023 AS d FROM m1),
m5 AS (SELECT *, (d + (d << 2) + (d << 4)) & 1023 AS g FROM m3), m AS (SELECT sid, pos, (g + (g << 31)) & 1023 AS x FROM m5),
k AS (SELECT sid, pos, x AS head, lead(x, 10) OVER o AS tail, min(x) OVER (PARTITION BY sid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) AS least, lead(pos, 10) OVER o AS there FROM m WINDOW o AS (PARTITION BY sid ORDER BY pos)),
p AS (SELECT sid, pos FROM k WHERE there IS NOT NULL AND least IS NOT NULL AND (head IS NOT DISTINCT FROM least) <> (tail IS NOT DISTINCT FROM least))
SELECT sid, pos, least(substr(seq, pos + 1, 15), reverse(translate(substr(seq, pos + 1, 15), 'ACGT', 'TGCA'))) AS kmer FROM p JOIN h USING (sid)""",
}
