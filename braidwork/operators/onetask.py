"""What the iterative graph operators do once a table is small enough for one task.

They shrink their tables in distributed rounds while these have more than TASK_ROWS rows,
and finish here. The size is counted before, so no task gets more than that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TASK_ROWS = 1_000_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """Groups spread over as many tasks as the session has shuffle partitions.

    Groups worked on in Python cost far more than their bytes say, by which adaptive
    execution would put them into a few tasks; a number given outright is kept.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def in_one_task(df: DataFrame, work: Callable[..., dict[str, np.ndarray]], schema: str) -> DataFrame:
    """``work`` on the columns of ``df`` as arrays; ``df`` is known to have at most TASK_ROWS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        out = work(*[c.to_numpy() for c in table.columns])
        yield from pa.table({k: pa.array(v) for k, v in out.items()}).to_batches(100_000)

    return df.repartition(1).mapInArrow(run, schema)


def spanning_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over pairs: every node but the smallest of its group, and that smallest node."""
    if len(a) == 0:
        return a, b
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = place[: len(a)], place[len(a) :]
    parent = np.arange(len(ids))
    while True:
        ru, rv = parent[u], parent[v]
        open_ = ru != rv
        if not open_.any():
            break
        u, v, ru, rv = u[open_], v[open_], ru[open_], rv[open_]
        np.minimum.at(parent, np.maximum(ru, rv), np.minimum(ru, rv))  # union: the larger root below the smaller
        while True:  # find: all paths to their roots
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    child = parent != np.arange(len(ids))
    return ids[child], ids[parent[child]]


def list_ranks(node: np.ndarray, next_: np.ndarray) -> dict[str, np.ndarray]:
    """Head and place of every node of linked lists; a circle begins at its smallest node."""
    ids, place = np.unique(np.concatenate([node, next_]), return_inverse=True)
    n = len(ids)
    before = np.full(n, -1)
    before[place[len(node) :]] = place[: len(node)]
    head, pos = _doubled(before)
    circular = head < 0
    if circular.any():
        low, jump = np.arange(n), np.where(before < 0, np.arange(n), before)
        for _ in range(max(1, int(n).bit_length())):
            low, jump = np.minimum(low, low[jump]), jump[jump]
        before[circular & (low == np.arange(n))] = -1
        head, pos = _doubled(before)
    return {"node": ids, "head": ids[head], "pos": pos, "circular": circular}


def _doubled(before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Head and distance by doubling steps back; -1 as the head of what has none."""
    at = np.arange(len(before))
    jump, pos = np.where(before < 0, at, before), (before >= 0).astype(np.int64)
    for _ in range(max(1, len(before).bit_length())):
        pos, jump = pos + pos[jump], jump[jump]
    ended = before[jump] < 0
    return np.where(ended, jump, -1), pos


def strong_roots(v: np.ndarray, w: np.ndarray) -> dict[str, np.ndarray]:
    """Every node with the largest member of its strongly connected component (Tarjan, without recursion)."""
    ids, place = np.unique(np.concatenate([v, w]), return_inverse=True)
    n = len(ids)
    src, dst = place[: len(v)], place[len(v) :]
    order = np.argsort(src, kind="stable")
    dst = dst[order].tolist()
    first = np.searchsorted(src[order], np.arange(n + 1)).tolist()
    index, low, on, root = [-1] * n, [0] * n, [False] * n, np.arange(n)
    stack: list[int] = []
    count = 0
    for s in range(n):
        if index[s] >= 0:
            continue
        work = [(s, first[s])]
        index[s] = low[s] = count
        count += 1
        stack.append(s)
        on[s] = True
        while work:
            x, i = work.pop()
            if i < first[x + 1]:
                work.append((x, i + 1))
                y = dst[i]
                if index[y] < 0:
                    index[y] = low[y] = count
                    count += 1
                    stack.append(y)
                    on[y] = True
                    work.append((y, first[y]))
                elif on[y]:
                    low[x] = min(low[x], index[y])
                continue
            if low[x] == index[x]:
                members = []
                while True:
                    y = stack.pop()
                    on[y] = False
                    members.append(y)
                    if y == x:
                        break
                root[members] = max(members)
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[x])
    return {"v": ids, "scc": ids[root]}
