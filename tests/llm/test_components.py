import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from braidwork.llm import components
from braidwork.llm.components import connected_groups, spanning_stars


def brute(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {(x, find(x)) for x in parent if find(x) != x}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), max_size=60))
def test_union_find_in_a_partition(pairs):
    a, b = np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)
    nodes, roots = spanning_stars(a, b)
    assert set(zip(nodes.tolist(), roots.tolist())) == brute(pairs)


def graph(kind):
    rng = random.Random(kind)
    if kind == "random":
        return [(rng.randrange(900), rng.randrange(900)) for _ in range(700)]
    if kind == "path":
        return [(i, i + 1) for i in range(600)]
    if kind == "shuffled path":
        ids = rng.sample(range(10**12), 600)
        return list(zip(ids, ids[1:]))
    if kind == "star of the largest":
        return [(10**6, i) for i in range(600)]
    return [(0, i) for i in range(1, 500)] + [(7, 7), (None, 1), (3, None), (0, 1)]


@pytest.mark.parametrize("kind", ["random", "path", "shuffled path", "star of the largest", "dirty star"])
@pytest.mark.parametrize("task_pairs", [40, 2_000_000])
def test_groups(spark, kind, task_pairs):
    pairs = graph(kind)
    df = spark.createDataFrame([(a, b, 1) for a, b in pairs], "a bigint, b bigint, node int").repartition(5)
    got = [tuple(r) for r in connected_groups(df, "a", "b", task_pairs).select("node", "root").collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(pairs)


def test_hot_and_other_roots_in_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT_PARTS", 4)
    rng = random.Random(9)
    pairs = [(0, i) for i in range(1, 400)] + [(rng.randrange(400, 900), rng.randrange(400, 900)) for _ in range(400)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint").repartition(5)
    assert {tuple(r) for r in connected_groups(df, "a", "b", 60).select("node", "root").collect()} == brute(pairs)


def test_empty(spark):
    assert connected_groups(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0
