"""Per-key results where a few keys hold most records.

Quantiles are found by exact selection over mergeable counts: a first histogram per key
with bins that are single values for small magnitudes and relative ranges beyond, then
histograms of the bin that holds the wanted rank, until it holds one value. Only counts of
bins are ever brought together, never the values of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.storage import materialize

#: Bins of one refinement; the first histogram has single values below EXACT_BELOW.
REFINE_BINS = 4096
EXACT_BELOW = 1024
#: Keys with at least one row in HOT_PARTS are hot, so there are at most HOT_PARTS of them.
HOT_PARTS = 1024


def _first_bin(v: Column) -> Column:
    """A monotone bin of an integral value: itself if small, else exponent and 9 leading bits."""
    size = F.when(v < 0, -(v + 1)).otherwise(v)
    power = F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int")
    wide = (power - 9).cast("bigint") * EXACT_BELOW + F.expr("0")
    shift = F.call_function("shiftright", size, F.greatest(power - 9, F.lit(0)))
    place = F.when(size < EXACT_BELOW, size).otherwise(wide + shift)
    return F.when(v < 0, -place - 1).otherwise(place)


def _total(upper: Column, lower: Column) -> Column:
    """The sum of two halves as bigint, null where it doesn't fit."""
    wide = upper.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + lower.cast("decimal(20,0)")
    return wide.try_cast("bigint")


def join_by_key(records: DataFrame, stats: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``records`` with the columns of ``stats`` (unique in ``key``; ``n`` rows of ``records`` each).

    Hot keys, of which there can be no more than HOT_PARTS, are joined where the records
    lie; the rest is shuffled, in groups of less than one in HOT_PARTS of the rows.
    """
    least = max(1, total // HOT_PARTS + 1)
    hot = F.broadcast(stats.where(F.col(n) >= least))
    rest = stats.where(F.col(n) < least)
    cold = records.join(hot.select(key), key, "left_anti").join(rest.hint("merge"), key)
    return records.join(hot, key).unionByName(cold)


def key_quantiles(
    records: DataFrame, key: str, value: str, fractions: Sequence[float] = (0.5,), total: int | None = None
) -> DataFrame:
    """Count, sum and exact quantiles of an integral ``value`` for every ``key``.

    A quantile is interpolated linearly between the two values beside place
    ``fraction * (n - 1)``; 0.5 gives the mean of the two middle ones if the number is even.
    Rows with a null key or value take no part; a key without others has no row. A sum that
    doesn't fit into bigint is null.

    ``records`` is read once for the first histogram and once for each refinement that
    some key still needs; give a written table if it is costly. Returns
    ``key, n, total, q0, q1, ...``.
    """
    rows = records.select(F.col(key).alias("_k"), F.col(value).cast("bigint").alias("_v")).where(
        "_k is not null and _v is not null"
    )
    wanted = [(2 * i + j, fraction, j) for i, fraction in enumerate(fractions) for j in (0, 1)]
    counts = [F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    # Upper and lower halves are summed apart, so that no sum on the way leaves bigint.
    upper, lower = F.shiftright("_v", 32), F.col("_v").bitwiseAND(F.lit((1 << 32) - 1))

    bins = rows.groupBy("_k", _first_bin(F.col("_v")).alias("_bin")).agg(
        *counts, F.sum(upper).alias("_up"), F.sum(lower).alias("_low")
    )
    by_key = Window.partitionBy("_k")
    bins = (
        bins.withColumn("_n", F.sum("_c").over(by_key))
        .withColumn("_t", _total(F.sum("_up").over(by_key), F.sum("_low").over(by_key)))
        .withColumn("_upto", F.sum("_c").over(by_key.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)))
    )
    place = lambda f, up: (F.ceil if up else F.floor)((F.col("_n") - 1) * F.lit(float(f))).cast("bigint")
    targets = F.array(*[F.struct(F.lit(t).alias("t"), place(f, up).alias("at")) for t, f, up in wanted])
    found = bins.select(
        "_k", "_n", "_t", "_lo", "_hi", "_c", F.inline(targets), (F.col("_upto") - F.col("_c")).alias("_from")
    ).where("at >= _from and at < _from + _c")
    state, open_ = _settle(found.withColumn("at", F.col("at") - F.col("_from")))
    parts = [state.where("value is not null")]

    while open_:
        # The bins that hold a wanted rank; two ranks of a key may lie in different ones.
        ranges = state.where("value is null").select("_k", "_n", "_t", "_lo", "_hi", "t", "at")
        spans = ranges.groupBy("_k", "_n", "_lo", "_hi").agg(F.lit(1).alias("_one"))
        per_key = spans.groupBy("_k", "_n").agg(F.collect_list(F.struct("_lo", "_hi")).alias("_spans"))
        if total is None:
            total = rows.count()
        near = (
            join_by_key(rows, per_key, "_k", "_n", total)
            .select("_k", "_v", F.inline("_spans"))
            .where("_v between _lo and _hi")
        )
        step = F.greatest(F.lit(1), F.expr(f"(_hi - _lo) div {REFINE_BINS} + 1"))
        fine = (
            near.withColumn("_step", step)
            .withColumn("_bin", F.expr("(_v - _lo) div _step"))
            .groupBy("_k", F.col("_lo").alias("_plo"), F.col("_hi").alias("_phi"), "_bin")
            .agg(*counts)
        )
        span = Window.partitionBy("_k", "_plo", "_phi").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        fine = fine.withColumn("_upto", F.sum("_c").over(span))
        goal = ranges.select("_k", "_n", "_t", F.col("_lo").alias("_plo"), F.col("_hi").alias("_phi"), "t", "at")
        found = fine.join(goal, ["_k", "_plo", "_phi"]).where("at >= _upto - _c and at < _upto")
        found = found.select(
            "_k", "_n", "_t", "_lo", "_hi", "_c", "t", (F.col("at") - F.col("_upto") + F.col("_c")).alias("at")
        )
        state, open_ = _settle(found)
        parts.append(state.where("value is not null"))

    done = parts[0]
    for part in parts[1:]:
        done = done.unionByName(part)
    at = lambda t: F.max(F.when(F.col("t") == t, F.col("value")))
    quantiles = []
    for i, fraction in enumerate(fractions):
        share = (F.col("n") - 1) * F.lit(float(fraction))
        share = share - F.floor(share)
        low, high = (F.col(f"_q{2 * i + j}").cast("double") for j in (0, 1))
        quantiles.append((low + (high - low) * share).alias(f"q{i}"))
    return (
        done.groupBy("_k")
        .agg(F.max("_n").alias("n"), F.max("_t").alias("total"), *[at(t).alias(f"_q{t}") for t, _, _ in wanted])
        .select(F.col("_k").alias(key), "n", "total", *quantiles)
    )


def _settle(found: DataFrame) -> tuple[DataFrame, int]:
    """Give targets their value where the bin leaves no doubt; the table and the number left open."""
    value = (
        F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
        .when(F.col("at") == 0, F.col("_lo"))
        .when(F.col("at") == F.col("_c") - 1, F.col("_hi"))
    )
    state, _ = materialize(found.select("_k", "_n", "_t", "_lo", "_hi", "t", "at", value.alias("value")))
    return state, state.where("value is null").count()


def out_of_line(
    records: DataFrame, key: str, value: str, stats: DataFrame, total: int, factor: int = 5, least: int = 5
) -> DataFrame:
    """Records whose value is ``factor`` times the key's median or more, or a ``factor``-th or less.

    ``stats`` is the result of :func:`key_quantiles` with the median as ``q0``. Only keys
    with at least ``least`` records are judged. All columns of ``records`` are kept.
    """
    judged = stats.where(F.col("n") >= least).select(key, F.col("n").alias("_n"), F.col("q0").alias("_m"))
    v = F.col(value)
    far = (v >= factor * F.col("_m")) | (factor * v <= F.col("_m"))
    return join_by_key(records, judged, key, "_n", total).where(far).drop("_n", "_m")
