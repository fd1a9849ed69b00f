"""The most frequent values of columns, counted exactly.

Values are counted by a spillable aggregation with combining before the shuffle. Every
partition of the counts then hands on its own first places, and one ordered limit joins them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("col_name"), F.col(c).cast("bigint").alias("item")) for c in columns])
    return df.select(F.inline(pairs)).groupBy("col_name", "item").agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent values of an integral column: ``col_name, item, n``.

    Of values equally frequent the smaller comes first. Null isn't a value. Each partition
    hands on ``k`` rows.
    """
    counts = _counts(df, [column]).where("item is not null")
    return counts.orderBy(F.desc("n"), "item").limit(k)


def frequent_values(df: DataFrame, columns: Sequence[str], one_in: int) -> DataFrame:
    """Values that at least one in ``one_in`` of all rows hold: ``col_name, item, n``.

    Null isn't a value, but rows with a null count in the total. No more than ``one_in``
    values of a column can qualify, so the first ``one_in`` places of each hold all of them.
    An empty table has no frequent value.
    """
    counts = _counts(df, columns)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    first = None
    for c in columns:
        places = counts.where((F.col("col_name") == c) & F.col("item").isNotNull())
        places = places.orderBy(F.desc("n"), "item").limit(one_in)
        first = places if first is None else first.unionByName(places)
    return first.where(F.col("n") * one_in >= total.scalar())
