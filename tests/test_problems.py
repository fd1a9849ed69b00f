import random

import pytest
from pyspark.sql import functions as F

from braidwork.operators.intervals import merge_intervals
from braidwork.operators.skew import key_quantiles, out_of_line


def periods(rows):
    by = {}
    for k, s, a, b in rows:
        if None not in (k, s, a, b):
            by.setdefault((k, s), []).append((min(a, b), max(a, b)))
    out = set()
    for (k, s), spans in by.items():
        end = None
        for a, b in sorted(spans):
            if end is None:
                beg, end = a, b
            elif a <= end + 1:
                end = max(end, b)
            else:
                out |= {(k, s, "period", beg, end), (k, s, "gap", end + 1, a - 1)}
                beg, end = a, b
        out.add((k, s, "period", beg, end))
    return out


@pytest.mark.parametrize("width", [4, 10, 1 << 16])
@pytest.mark.parametrize("seed", range(3))
def test_intervals(spark, width, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        a = rng.randrange(-60, 400)
        b = a + rng.choice([0, 0, 1, 2, 3, 9, 40, -2])
        rows.append((rng.choice(["a", "b", None]), rng.choice([0, 1, 1, None]), rng.choice([a] * 20 + [None]), b))
    rows += rows[:20]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "k string, s int, a int, b int, beg int, kind int").repartition(5)
    got = [tuple(r) for r in merge_intervals(df, ["k", "s"], "a", "b", width).select("k", "s", "kind", "beg", "fin").collect()]
    assert len(got) == len(set(got)) and set(got) == periods(rows)


def test_intervals_over_many_shards_and_empty(spark):
    df = spark.createDataFrame([("a", 0, 2000), ("a", 2001, 2001), ("a", 2500, 9000), ("a", 9002, 9002)], "k string, a int, b int")
    got = {tuple(r) for r in merge_intervals(df, ["k"], "a", "b", 16).select("kind", "beg", "fin").collect()}
    assert got == {("period", 0, 2001), ("gap", 2002, 2499), ("period", 2500, 9000), ("gap", 9001, 9001), ("period", 9002, 9002)}
    assert merge_intervals(df.limit(0), ["k"], "a", "b").count() == 0


@pytest.mark.parametrize("width", [4, 64, 1 << 16])
def test_wide_intervals(spark, width):
    """Intervals of any width cost no more than a few pieces; cells inside them hold nothing of their own."""
    rng = random.Random(width)
    far = {4: 250, 64: 250_000, 1 << 16: 2**62}[width]
    rows = [("a", 5, far), ("a", far + 2, far + 10), ("b", -far, 7), ("b", 9, far // 3), ("b", far, far)]
    for key, axis in (("c", far // 100), ("d", far)):
        for _ in range(120):
            a = rng.randrange(-axis - 1, axis)
            rows.append((key, a, a + rng.choice([0, 1, 5, width, axis // 50])))
    if width > 64:
        rows += [("f", -(2**63), -(2**63) + 9), ("f", 2**63 - 9, 2**63 - 1), ("g", -(2**63), 2**63 - 1), ("h", 0, 10**12), ("h", 10**12 + 2, 10**12 + 3)]
    df = spark.createDataFrame(rows, "k string, a bigint, b bigint").repartition(3)
    got = [tuple(r) for r in merge_intervals(df, ["k"], "a", "b", width).select("k", "kind", "beg", "fin").collect()]
    want = {(k, kind, beg, fin) for k, _, kind, beg, fin in periods([(k, 0, a, b) for k, a, b in rows])}
    assert len(got) == len(set(got)) and set(got) == want


def test_partial_combining_comes_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", 0, 2000)], "k string, a int, b int")
    plan = merge_intervals(df, ["k"], "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan


def quantile(values, f):
    values = sorted(values)
    at = (len(values) - 1) * f
    low = int(at)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (at - low)


@pytest.mark.parametrize("spread", [10, 100_000, 2**61])
def test_quantiles(spark, spread):
    rng = random.Random(spread)
    rows = [(rng.choice([1] * 8 + [2, 3, 4, None]), rng.randrange(-spread, spread)) for _ in range(3000)]
    rows += [(9, 5), (9, 6), (10, -1), (11, None), (12, 7)] + [(13, v) for v in (1_000_001, 1_000_002, 1_000_003, 1_000_004)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "h bigint, c bigint, n int").repartition(6)
    got = {r["h"]: r for r in key_quantiles(df, "h", "c", [0.5, 0.25, 1.0]).collect()}
    by = {}
    for h, c in rows:
        if h is not None and c is not None:
            by.setdefault(h, []).append(c)
    assert set(got) == set(by)
    for h, values in by.items():
        assert got[h]["n"] == len(values) and got[h]["total"] == (sum(values) if abs(sum(values)) < 2**63 else None)
        for name, f in (("q0", 0.5), ("q1", 0.25), ("q2", 1.0)):
            assert got[h][name] == pytest.approx(quantile(values, f), rel=1e-12)


def test_out_of_line_and_hot_keys(spark):
    rows = [(i, 1, 10) for i in range(3000)] + [(5000, 1, 50), (5001, 1, 2), (5002, 1, 49), (5003, 1, 3)]
    rows += [(6000 + i, 100 + i % 900, 1 + i % 7) for i in range(4000)] + [(9000 + i, 7, c) for i, c in enumerate([1, 1, 1, 100])]
    df = spark.createDataFrame(rows, "rec_id bigint, h bigint, cov bigint").repartition(6)
    stats = key_quantiles(df, "h", "cov")
    got = {r["rec_id"] for r in out_of_line(df, "h", "cov", stats, len(rows)).collect()}
    by = {}
    for r, h, c in rows:
        by.setdefault(h, []).append(c)
    m = {h: quantile(v, 0.5) for h, v in by.items()}
    assert got == {r for r, h, c in rows if len(by[h]) >= 5 and (c >= 5 * m[h] or 5 * c <= m[h])}
    assert {5000, 5001} <= got and not {5002, 5003, 9003} & got
    assert key_quantiles(df.limit(0), "h", "cov").count() == 0
    assert out_of_line(df, "h", "cov", stats, len(rows)).where(F.col("h").isNull()).count() == 0
