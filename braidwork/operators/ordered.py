"""Row numbers and running totals over a whole table, without one task that sees all rows.

Rows are sorted by ranges of the order; each range adds what lies in the ranges before it.
The driver only sees one number a range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.storage import materialize


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    ranged = df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    return materialize(ranged)[0]


def _offsets(ranged: DataFrame, amount) -> dict:
    sizes = {r["__range"]: r["n"] or 0 for r in ranged.groupBy("__range").agg(amount.alias("n")).collect()}
    start, at = {}, 0
    for p in sorted(sizes):
        start[p], at = at, at + sizes[p]
    return start


def _with_offset(ranged: DataFrame, start: dict, name: str, local) -> DataFrame:
    if not start:
        return ranged.drop("__range").withColumn(name, F.lit(0).cast("bigint"))
    offset = F.element_at(F.create_map(*[F.lit(x) for item in start.items() for x in item]), F.col("__range"))
    return ranged.withColumn(name, (offset + local).cast("bigint")).drop("__range")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows numbered from 0 in the order of ``order``, which should be a key."""
    ranged = _ranged(df, order)
    local = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return _with_offset(ranged, _offsets(ranged, F.count(F.lit(1))), name, local)


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """The sum of ``value`` (null as 0) up to and with each row in the order of ``order``, a key."""
    ranged = _ranged(df, order)
    own = F.coalesce(F.col(value), F.lit(0)).cast("bigint")
    local = F.sum(own).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return _with_offset(ranged, _offsets(ranged, F.sum(own)), name, local)


def filled(df: DataFrame, order: list[str], value: str, limit: int, name: str) -> DataFrame:
    """Rows with ``name``, the number of the batch they fall into in the order of ``order``, a key.

    A batch ends with the row with which its sum of ``value`` (null as 0) reaches ``limit``; the next begins
    to count at 0. Where batches begin in a range depends on where the last one before it began, so every range first says,
    for each row of its own that may be the first to begin one, how many begin from there on and what sum the next range
    has to reach. These are rows of one batch a range; the driver follows them from range to range.
    """
    ranged = _ranged(running_total(df, order, value, "__upto"), order)
    ranged = ranged.withColumn("__before", F.col("__upto") - F.coalesce(F.col(value), F.lit(0)).cast("bigint"))

    def begins(before: np.ndarray) -> np.ndarray:
        """Of each row the first one that lies a whole batch behind it."""
        return np.searchsorted(before, before + limit, side="left")

    def entries(frame: pd.DataFrame) -> pd.DataFrame:
        before = np.sort(frame["__before"].to_numpy())
        next_, n = begins(before), len(before)
        count, out = np.ones(n + 1, np.int64), np.append(before + limit, 0)
        for i in reversed(range(n)):
            if next_[i] < n:
                count[i], out[i] = count[next_[i]] + 1, out[next_[i]]
        first = np.unique(before, return_index=True)[1]
        first = first[before[first] <= before[0] + limit]
        return pd.DataFrame({"r": frame["__range"].iat[0], "at": before[first], "n": count[first], "out": out[first], "last": before[-1]})

    rows = ranged.select("__range", "__before").groupBy("__range").applyInPandas(entries, "r int, at bigint, n bigint, out bigint, last bigint").toPandas()
    start, at, batch = [], 0, 0
    for r, part in rows.sort_values(["r", "at"]).groupby("r"):
        start.append((int(r), at, batch))
        if at <= part["last"].iat[0]:
            i = int(np.searchsorted(part["at"].to_numpy(), at, side="left"))
            batch, at = batch + int(part["n"].iat[i]), int(part["out"].iat[i])
    entry = {r: (a, b) for r, a, b in start}

    def numbers(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__before", kind="stable")
        before = frame["__before"].to_numpy()
        next_ = begins(before)
        at, batch = entry[int(frame["__range"].iat[0])]
        i, own = int(np.searchsorted(before, at, side="left")), np.full(len(before), batch - 1, np.int64)
        while i < len(before):
            own[i:] = batch
            i, batch = int(next_[i]), batch + 1
        return frame[order].assign(**{name: own})

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*order).schema.fields)
    got = ranged.select(*order, "__range", "__before").groupBy("__range").applyInPandas(numbers, f"{keys}, {name} bigint")
    return df.join(got, order)
