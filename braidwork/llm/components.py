"""One identifier for all records that pairs link directly or through others.

Every level runs union-find inside partitions of pairs and keeps only their spanning
forests, as stars around the smallest member. While the forest is larger than one task may
hold, the next level brings the stars of a node together in as many bounded partitions as
needed, joins their forests and shortens the remaining chains; below that size one last
partition joins all. A partition never holds more than ``task_pairs`` pairs at once: a task
that gets more works through them in pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.operators.onetask import spanning_stars
from braidwork.operators.skew import HOT_PARTS
from braidwork.storage import discard, materialize

TASK_PAIRS = 2_000_000
MAX_LEVELS = 200


def _forest(task_pairs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def joined() -> tuple[np.ndarray, np.ndarray]:
            return spanning_stars(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))

        def out(nodes: np.ndarray, roots: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(nodes), 100_000):
                piece = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[piece]), pa.array(roots[piece])], ["node", "root"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= task_pairs:
                forest = joined()
                size = len(forest[0])
                held = [forest]
                if size > task_pairs // 2:  # no room to go on: hand this forest on and begin another
                    yield from out(*forest)
                    held, size = [], 0
        if held:
            yield from out(*joined())

    return run


def connected_groups(pairs: DataFrame, a: str, b: str, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """For every node but the smallest of its group: ``node`` and ``root``, the smallest.

    ``a`` and ``b`` hold integral identifiers. Pairs with a null take no part, a pair of a
    node with itself links nothing, repeated pairs change nothing; nodes without a pair are
    groups of their own and have no row. Other columns are ignored.
    """
    grow = _forest(task_pairs)
    links = pairs.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b"))
    stars, n = materialize(links.where("a <> b").mapInArrow(grow, "node bigint, root bigint"))
    for _ in range(MAX_LEVELS):
        if n <= task_pairs:
            return materialize(stars.repartition(1).mapInArrow(grow, "node bigint, root bigint"))[0]
        parts = -(-2 * n // task_pairs)
        met, n = materialize(stars.repartition(parts, "node").mapInArrow(grow, "node bigint, root bigint"))
        up, nodes = materialize(met.groupBy("node").agg(F.min("root").alias("up")))
        sizes = met.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        chain = sizes.join(up.select(F.col("node").alias("root"), "up"), "root", "left")
        chain, _ = materialize(chain.where(F.col("up").isNotNull() | (F.col("n") >= n // HOT_PARTS + 1)))
        if n > task_pairs and nodes == n and chain.where("up is not null").isEmpty():
            return met  # every node has one star, and no root is a node
        old = stars, met, up, chain
        stars, n = materialize(_hung(met, chain, n))
        discard(*old)
    raise RuntimeError(f"groups didn't settle in {MAX_LEVELS} levels")


def _hung(stars: DataFrame, chain: DataFrame, total: int) -> DataFrame:
    """A root that is itself a node of other stars is a chain; its members hang one up.

    ``chain``: root, n (its stars), up (null if it isn't a node). Roots with more than one
    in HOT_PARTS of the stars, of which there are fewer than HOT_PARTS, are looked up where
    the stars lie; only the others are shuffled by root.
    """
    large = F.col("n") >= total // HOT_PARTS + 1
    hot = F.broadcast(chain.where(large).select("root", "up"))
    cold = chain.where(~large).select("root", "up").hint("merge")
    rest = stars.join(hot.select("root"), "root", "left_anti").join(cold, "root", "left")
    every = stars.join(hot, "root").unionByName(rest)
    return every.select("node", F.coalesce("up", "root").alias("root"))
