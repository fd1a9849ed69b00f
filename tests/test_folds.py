import random
from itertools import product

import numpy as np
import pytest

from braidwork.operators import annotation, localgraph
from braidwork.operators.align import best_chains, count_chains
from braidwork.operators.ordered import filled


def batches(sizes, limit):
    out, batch, upto = [], 0, 0
    for n in sizes:
        if upto >= limit:
            batch, upto = batch + 1, 0
        out.append(batch)
        upto += n or 0
    return out


@pytest.mark.parametrize("limit", [1, 20, 100_000])
def test_batches_count_anew_in_every_range(spark, limit):
    rng = random.Random(limit)
    sizes = [rng.choice([0, 0, 3, 7, 15, 60, None]) for _ in range(300)]
    df = spark.createDataFrame([(i, n, 1) for i, n in enumerate(sizes)], "i bigint, n int, batch_ int").repartition(5)
    got = {r["i"]: r["batch"] for r in filled(df, ["i"], "n", limit, "batch").collect()}
    assert [got[i] for i in range(300)] == batches(sizes, limit)
    assert filled(df.limit(0), ["i"], "n", limit, "batch").count() == 0


def test_components_that_bring_no_genes_are_left_out(spark):
    classes = [(1, 2, 900.0, 50_000), (2, 2, 800.0, 20_000), (3, 2, 700.0, 200_000), (4, 1, 500.0, 9_000), (5, 1, 400.0, 9_000), (6, 0, 999.0, 9)]
    genes = [(1, 2, g, 450.0) for g in "ab"] + [(1, 2, "c", 400.0)] + [(2, 2, "a", 440.0)] + [(3, 2, g, 460.0) for g in "abc"]
    genes += [(4, 1, "x", 500.0), (5, 1, "x", 300.0), (5, 2, "y", 999.0), (6, 1, "z", 900.0)]
    got = annotation.gaining(
        spark.createDataFrame(classes, "cid bigint, og_type int, score double, len bigint"), spark.createDataFrame(genes, "cid bigint, og_type int, gname string, score double")
    )
    # 2 brings nothing and has a third of the genes; 3 is better but too long for its score; 5 has another's gene, but as many as there are at 0.6.
    assert {r["cid"] for r in got.collect()} == {1, 4}


@pytest.mark.parametrize("seed", range(5))
def test_least_cost_is_that_of_all_combinations(seed):
    rng = np.random.default_rng(seed)
    top = rng.integers(1, 4, 6)
    alone = [rng.random(t + 1).tolist() for t in top]
    shared = []
    for _ in range(5):
        a, b, e = rng.choice(6, 2).tolist(), rng.choice(6, rng.integers(1, 3)).tolist(), float(rng.random() * 4)
        shared.append((a, b, lambda i, o, e=e: abs(e - i) + 2 * abs(i - o)))
    cost = lambda x: sum(c[n] for c, n in zip(alone, x)) + sum(f(sum(x[j] for j in a), sum(x[j] for j in b)) for a, b, f in shared)
    got = localgraph._least(alone, shared)
    assert cost(got) == pytest.approx(min(cost(x) for x in product(*[range(t + 1) for t in top])))


def test_no_table_too_large(monkeypatch):
    monkeypatch.setattr(localgraph, "MAX_TABLE", 3)
    assert localgraph._least([[0.0, 1.0], [0.0, 1.0]], [([0], [1], lambda i, o: abs(i - o))]) is None


def test_chains_are_counted_without_being_listed(monkeypatch):
    after = {2 * i + j: [2 * i + 2, 2 * i + 3] for i in range(39) for j in (0, 1)}
    assert count_chains([1] * 80, after) == 2**40
    assert best_chains([1] * 80, after) == (40, [])
    assert best_chains([2, 1, 3, 3], {0: [2, 3], 1: [2]}) == (5, [[0, 2], [0, 3]])


def test_tables_of_earlier_rounds_go(spark):
    import os

    from braidwork import storage

    df, n = storage.materialize(spark.range(5).toDF("x"))
    path = df._written.removeprefix("file://")
    assert n == 5 and os.path.exists(path)
    storage.discard(df, spark.range(3))
    assert not os.path.exists(path) and f"file://{path}" not in storage._written


def test_last_stage_of_expectation_is_the_same_on_tables_and_arrays(spark):
    from braidwork.operators.estimate import expected_coverage

    aln = [(s, k, 0, 2 * u, 0, 3, 0, 3, 4, 2) for s in range(30) for k, u in enumerate([s % 3, 3])] + [(99, 0, 0, 2, 0, 5, 0, 5, 6, 1)]
    aln = spark.createDataFrame(aln, "sid bigint, aln_id int, frag int, uid bigint, u_beg int, u_end int, s_beg int, s_end int, score int, n_aln int")
    sizes = spark.createDataFrame([(u, 10 + u) for u in range(5)], "uid bigint, n bigint")
    start = spark.createDataFrame([(u, 1.0 + u) for u in range(5)], "uid bigint, cov double")
    one = {r["uid"]: r["cov"] for r in expected_coverage(aln, sizes, start, rounds=6).collect()}
    many = {r["uid"]: r["cov"] for r in expected_coverage(aln, sizes, start, rounds=6, task_rows=0).collect()}
    assert one == pytest.approx(many) and len(one) == 5
