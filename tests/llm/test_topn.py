import math
import random

import pyarrow as pa
import pytest

from braidwork.llm import topn
from braidwork.llm.topn import top_n_per_group

SCHEMA = "g string, score double, e double, name string, id bigint, rank int, _g string"
ORDER = [("score", "desc"), ("e", "asc"), ("name", "asc"), ("id", "asc")]


def brute(rows, n):
    best = {}
    for g, score, e, name, id_ in {r[:5] for r in rows if r[0] is not None}:
        best.setdefault(g, []).append((score, e, name, id_))

    def key(r):
        score, e, name, id_ = r
        return (score is None, -(score or 0), e is None, e or 0, name is None, (name or "").encode(), id_)

    return {(g, i + 1, *r) for g, v in best.items() for i, r in enumerate(sorted(v, key=key)[:n])}


def test_ties_nulls_repeats_and_clashing_names(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        g = rng.choice(["hot"] * 5 + [f"g{rng.randrange(200)}", None])
        r = (g, rng.choice([1.0, 2.0, 3.5, None, 0.0, -0.0]), rng.choice([None, 0.0, 1e-9]), rng.choice([None, "é", "z", "Z", ""]), i)
        rows += [(*r, 7, "x")] * rng.choice([1, 1, 3])
    got = {tuple(r) for r in top_n_per_group(spark.createDataFrame(rows, SCHEMA).repartition(7), "g", ORDER, 3).collect()}
    assert got == brute(rows, 3)


def test_fewer_than_n_and_empty(spark):
    df = spark.createDataFrame([("a", 1.0, None, None, 1, 0, "")], SCHEMA)
    assert [tuple(r)[:3] for r in top_n_per_group(df, "g", ORDER, 3).collect()] == [("a", 1, 1.0)]
    assert top_n_per_group(df.limit(0), "g", ORDER, 3).count() == 0


def test_nan_comes_after_numbers(spark):
    df = spark.createDataFrame([("a", math.nan, None, None, 1, 0, ""), ("a", -5.0, None, None, 2, 0, "")], SCHEMA)
    assert [r["id"] for r in top_n_per_group(df, "g", ORDER, 2).orderBy("rank").collect()] == [2, 1]


def test_smallest_integer_descending(spark):
    df = spark.sql("select 'a' as g, -9223372036854775808L as id union all select 'a', 9223372036854775807L")
    got = top_n_per_group(df, "g", [("id", "desc")], 1).collect()
    assert got[0]["id"] == 2**63 - 1


def test_descending_text_is_refused(spark):
    with pytest.raises(ValueError):
        top_n_per_group(spark.createDataFrame([("a", "b")], "g string, t string"), "g", [("t", "desc")], 1)


def test_heap_is_built_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", 1.0, None, None, 1, 0, "")], SCHEMA)
    plan = top_n_per_group(df, "g", ORDER, 3)._jdf.queryExecution().executedPlan().toString()
    assert "partial_collect_top_k" in plan


def test_repeats_are_dropped_in_the_task_and_one_shuffle_is_left(spark):
    df = spark.createDataFrame([("a", 1.0, None, None, 1, 0, "")], SCHEMA)
    plan = top_n_per_group(df, "g", ORDER, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("MapInArrow")


@pytest.mark.parametrize("chunk", [1, 50, 100_000])
def test_many_groups_in_small_chunks_without_the_queue(spark, monkeypatch, chunk):
    rng = random.Random(chunk)
    rows = [(f"g{rng.randrange(60)}", rng.choice([1.0, 2.0, None]), 0.5, rng.choice(["a", None]), rng.randrange(30), 0, "") for _ in range(800)]
    local = topn._local
    monkeypatch.setattr(topn, "CHUNK", chunk)
    batches = [pa.RecordBatch.from_pylist([dict(zip("gabcd", r[:5])) for r in rows[i : i + 70]]) for i in range(0, 800, 70)]
    kept = [tuple(x.values()) for b in local([w for _, w in ORDER], 3)(iter(batches)) for x in b.to_pylist()]
    assert set(kept) <= {r[:5] for r in rows} and brute([(*r, 0, "") for r in kept], 3) == brute(rows, 3)
    monkeypatch.setattr(topn, "bounded_heap", lambda item, n: None)
    assert {tuple(r) for r in top_n_per_group(spark.createDataFrame(rows, SCHEMA), "g", ORDER, 3).collect()} == brute(rows, 3)
