"""The N best items of every group by a mergeable aggregation.

The aggregate is Catalyst's bounded priority queue: every task keeps at most N items of a
group before the shuffle, and the queues of a group are merged afterwards, so a group with
a third of all rows sends N items a task. Tasks with more groups than fit in memory go on
with sorted, spillable input.

That queue would hold an item as often as it was delivered. Where items can be repeated, a
bounded set of N distinct items a group is kept first, on Arrow batches within each task;
only these are shuffled, once, by group, and what several tasks have in common is dropped there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a task sorts at once; what is left of them is carried on while it is less than half of that.
CHUNK = 200_000


def _same(column: pa.Array) -> np.ndarray:
    """Of each value but the first whether it equals the one before; nulls and NaN equal themselves."""
    if pa.types.is_null(column.type):
        return np.ones(max(0, len(column) - 1), bool)
    a, b = column[1:], column[:-1]
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    if pa.types.is_floating(column.type):
        same = pc.or_(same, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    return same.to_numpy(zero_copy_only=False)


def first_distinct(rows: pa.Table, ways: Sequence[str], n: int) -> pa.Table:
    """The first ``n`` distinct items of every group; the group is the first column, ``ways`` are those of the others."""
    if rows.num_rows < 2:
        return rows
    keys = [(c, "descending" if w == "desc" else "ascending") for c, w in zip(rows.column_names, ["asc", *ways])]
    rows = rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_end")).combine_chunks()
    columns = [c.chunk(0) for c in rows.columns]
    group, item = _same(columns[0]), np.ones(rows.num_rows - 1, bool)
    for c in columns:
        item &= _same(c)
    kept = np.flatnonzero(np.concatenate([[True], ~item]))
    begins = np.concatenate([[True], ~group])[kept]
    place = np.arange(len(kept))
    rank = place - np.maximum.accumulate(np.where(begins, place, 0))
    return rows.take(pa.array(kept[rank < n]))


def _local(ways: Sequence[str], n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK:
                best = first_distinct(pa.Table.from_batches(held), ways, n)
                held, size = best.to_batches(), best.num_rows
                if size > CHUNK // 2:  # too many groups to carry on: hand these on and begin again
                    yield from best.to_batches(10_000)
                    held, size = [], 0
        if held:
            yield from first_distinct(pa.Table.from_batches(held), ways, n).to_batches(10_000)

    return run


def bounded_heap(item: Column, n: int) -> Column | None:
    """Aggregate: the ``n`` smallest values of ``item`` (any orderable type), in ascending order.

    None where the session doesn't offer the expression: over Connect, or in another version of Spark.
    """
    try:
        from pyspark import SparkContext
        from pyspark.sql.classic.column import Column as ClassicColumn

        jvm = SparkContext._active_spark_context._jvm
        bridge = jvm.org.apache.spark.sql.classic.ExpressionUtils
        heap = jvm.org.apache.spark.sql.catalyst.expressions.aggregate.CollectTopK(
            bridge.expression(item._jc), n, True, 0, 0
        )
        return ClassicColumn(bridge.column(heap.toAggregateExpression()))
    except (ImportError, AttributeError, TypeError):  # a class that isn't there is a package to py4j
        return None
    except Exception as e:
        if type(e).__module__.startswith("py4j"):
            return None
        raise


def _turn(c: Column, kind: T.DataType, direction: str) -> Column:
    """A column whose ascending order is that of ``c`` in ``direction``; turning it again gives ``c`` back."""
    if direction != "desc":
        return c
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return -c
    if isinstance(kind, T.IntegralType):
        return F.bitwise_not(c)  # -x - 1, without overflow
    raise ValueError(f"descending order needs a number, not {kind.simpleString()}")


def top_n_per_group(
    df: DataFrame, group: str, order: Sequence[tuple[str, str]], n: int, repeated: bool = True
) -> DataFrame:
    """The first ``n`` items of every ``group`` in the given order (all, if fewer).

    ``order`` lists (column, 'asc' or 'desc'); it should end in a unique identifier, so that
    ties have one outcome. Nulls come last in either direction, NaN after all numbers, and
    strings compare by bytes. Rows with a null group take no part. With ``repeated``, rows
    equal in the group and in all ordered columns are one item, however often they were
    delivered; say False where they can't occur, which saves a sort in Python. Other columns are
    ignored. Empty input gives no rows.

    Returns the group, ``rank`` from 1, and the ordered columns.
    """
    rows = df.select(F.col(group).alias("_g"), *[F.col(c).alias(f"_o{i}") for i, (c, _) in enumerate(order)])
    rows = rows.where("_g is not null")
    kinds = [rows.schema[f"_o{i}"].dataType for i in range(len(order))]
    if repeated:
        # By group at once, so that neither step after it shuffles again.
        rows = rows.mapInArrow(_local([w for _, w in order], n), rows.schema).repartition("_g").distinct()
    # Of each column whether it is null, so that nulls come last, and the turned value.
    keys = []
    for i, (_, way) in enumerate(order):
        keys += [F.isnull(f"_o{i}").alias(f"n{i}"), _turn(F.col(f"_o{i}"), kinds[i], way).alias(f"k{i}")]
    heap = bounded_heap(F.struct(*keys), n)
    if heap is not None:
        best = rows.groupBy("_g").agg(heap.alias("_top"))
        flat = best.select("_g", F.posexplode("_top").alias("_pos", "_item"))
    else:  # rows beyond the first n of a group and task are dropped before its shuffle too
        place = F.row_number().over(Window.partitionBy("_g").orderBy("_item")) - 1
        flat = rows.select("_g", F.struct(*keys).alias("_item")).withColumn("_pos", place).where(F.col("_pos") < n)
    return flat.select(
        F.col("_g").alias(group), (F.col("_pos") + 1).alias("rank"),
        *[_turn(F.col(f"_item.k{i}"), kinds[i], way).alias(c) for i, (c, way) in enumerate(order)],
    )
