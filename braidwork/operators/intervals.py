"""Continuous periods and the gaps between them, per entity.

The axis is cut into cells of ``2**bits`` positions, these into cells of ``2**bits`` cells,
and so on, until few enough are left for one task. An interval is clipped to the cells it
touches in part: two at most on every level; what lies between is one piece of whole cells
on the next level, however many these are. Cells are merged level by level: the first and
the last period of a cell are handed up, all else in it is final. A cell that lies within a
longer piece holds nothing but covered positions and is left out.

A cell never holds more distinct starts than ``2**bits``, nor gets more than two periods
from each of its cells, so no task gets an unbounded group, however many intervals an
entity has, and however wide they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.storage import materialize

SHARD_WIDTH = 1 << 16


def _levels(low: int, high: int, bits: int) -> int:
    """Levels of cells below the last one, which has at most ``2**bits`` of them (or positions) in all."""
    n = 0
    while (high >> (bits * n)) - (low >> (bits * n)) >= 1 << bits:
        n += 1
    return n


def _pieces(lo: Column, hi: Column, top: int, bits: int) -> Column:
    """What an interval is on every level: an array of (level, first position, last position)."""
    out, there = [], F.lit(True)
    entry = lambda level, b, f: F.struct(F.lit(level).alias("_level"), b.alias("_b"), f.alias("_f"))
    for level in range(top):
        shift = bits * (level + 1)
        first, last = F.shiftright(lo, shift), F.shiftright(hi, shift)
        inside = first == last
        out.append(F.when(there & inside, entry(level, lo, hi)))
        out.append(F.when(there & ~inside, entry(level, lo, F.shiftleft(first, shift) + F.lit((1 << shift) - 1))))
        out.append(F.when(there & ~inside, entry(level, F.shiftleft(last, shift), hi)))
        there = there & (last > first + 1)
        lo, hi = F.shiftleft(first + 1, shift), F.shiftleft(last, shift) - 1
    out.append(F.when(there, entry(top, lo, hi)))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def _cell(level: int, top: int, bits: int, at: str = "_b") -> Column:
    """The cell of a position; the last level is one cell."""
    return F.shiftright(at, bits * (level + 1)) if level < top else F.lit(0).cast("bigint")


def _merged(rows: DataFrame, ks: list[str]) -> DataFrame:
    """Periods within cells of rows ``_cell, _b, _f, _done``.

    With the end of the period before as ``_prev``, and whether the gap between the two is
    known already as ``_done``; ``_last`` marks the last of a cell.
    """
    cell = Window.partitionBy(*ks, "_cell")
    order = cell.orderBy("_b")
    return (
        rows.withColumn("_prev", F.max("_f").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_end", F.max("_f").over(cell))
        .where(F.col("_prev").isNull() | (F.col("_b") > F.col("_prev") + 1))
        .withColumn("_next", F.lead("_prev").over(order))
        .select(*ks, "_cell", "_b", F.coalesce("_next", "_end").alias("_f"), "_prev", "_done", F.col("_next").isNull().alias("_last"))
    )


def _uncovered(pieces: DataFrame, wide: DataFrame, ks: list[str], level: int, above: int, top: int, bits: int) -> DataFrame:
    """Pieces of a level without those in cells that pieces of the level ``above`` cover.

    Cells are looked up in order of place among the pieces above them; these cover whole
    cells of the level below their own.
    """
    shift, parent = bits * (level + 1), bits * above
    inner = pieces.select(*ks, F.shiftright("_b", shift).alias("_c")).distinct()
    inner = inner.withColumn("_p", F.shiftright("_c", parent - shift))
    marks = inner.select(*ks, F.shiftleft("_p", parent).alias("_b"), F.lit(None).cast("bigint").alias("_f"), "_p").distinct()
    rows = marks.unionByName(wide.select(*ks, "_b", "_f", F.lit(None).cast("bigint").alias("_p")))
    order = Window.partitionBy(*ks, "_cell").orderBy("_b").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_cell", _cell(above, top, bits)).withColumn("_upto", F.max("_f").over(order))
    covered = rows.where(F.col("_p").isNotNull() & (F.col("_upto") >= F.col("_b") + F.lit((1 << parent) - 1))).select(*ks, "_p")
    gone = inner.join(covered, [*ks, "_p"], "left_semi").select(*ks, "_c")
    return pieces.withColumn("_c", F.shiftright("_b", shift)).join(gone, [*ks, "_c"], "left_anti").drop("_c")


def merge_intervals(
    df: DataFrame, keys: Sequence[str], beg: str | Column, fin: str | Column, shard_width: int = SHARD_WIDTH
) -> DataFrame:
    """Maximal covered runs (``kind`` 'period') and the free runs between them ('gap').

    ``beg`` and ``fin`` are integral positions, both included, in either order, anywhere in
    bigint. Runs that touch without a free position are one period. Rows with a null key or
    limit take no part; repeated and nested intervals change nothing; an empty input gives
    no rows. Other columns of ``df`` are ignored, whatever their names. ``shard_width`` is
    the number of positions of a cell, and is rounded up to a power of two.

    One pass over the limits says how many levels of cells there are. Returns
    ``keys..., kind, beg, fin`` (``beg`` and ``fin`` bigint).
    """
    bits = max(1, (shard_width - 1).bit_length())
    b, f = (F.col(c) if isinstance(c, str) else c for c in (beg, fin))
    ks = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(
        *[F.col(c).alias(k) for c, k in zip(keys, ks)],
        F.least(b, f).cast("bigint").alias("_lo"),
        F.greatest(b, f).cast("bigint").alias("_hi"),
        (b.isNotNull() & f.isNotNull()).alias("_ok"),
    ).where("_ok")
    for k in ks:
        rows = rows.where(F.col(k).isNotNull())

    # Where the axis begins and ends, and how many cells of each size an interval passes at most.
    shifts = range(bits, 64, bits)
    across = [F.max(F.shiftright("_hi", s) - F.shiftright("_lo", s)).alias(f"s{s}") for s in shifts]
    seen = rows.agg(F.min("_lo").alias("lo"), F.max("_hi").alias("hi"), *across).first()
    top = _levels(seen["lo"], seen["hi"], bits) if seen["lo"] is not None else 0
    wide = [level for level in range(1, top + 1) if seen[f"s{bits * level}"] > 1]

    pieces = rows.select(*ks, F.inline(_pieces(F.col("_lo"), F.col("_hi"), top, bits)))
    # Of the pieces with one start only the longest matters. This is combined before the
    # shuffle and leaves at most shard_width rows in any cell.
    pieces = pieces.groupBy(*ks, "_level", "_b").agg(F.max("_f").alias("_f"))
    if wide:
        pieces, _ = materialize(pieces)

    def out(source: DataFrame, period: Column) -> DataFrame:
        """A period where ``period`` holds, and the gap before it where it is known and new."""
        gap = F.struct(F.lit("gap").alias("kind"), (F.col("_prev") + 1).alias("beg"), (F.col("_b") - 1).alias("fin"))
        per = F.struct(F.lit("period").alias("kind"), F.col("_b").alias("beg"), F.col("_f").alias("fin"))
        new = F.col("_prev").isNotNull() & ~F.col("_done")
        each = F.filter(F.array(F.when(period, per), F.when(new, gap)), lambda x: x.isNotNull())
        return source.select(*[F.col(k).alias(c) for c, k in zip(keys, ks)], F.inline(each))

    parts, edges = [], None
    for level in range(top + 1):
        own = None
        if level in (0, *wide):
            own = pieces.where(F.col("_level") == level) if wide else pieces
            own = own.select(*ks, "_b", "_f")
            for above in wide:
                if above > level:
                    own = _uncovered(own, pieces.where(F.col("_level") == above), ks, level, above, top, bits)
            own = own.withColumn("_done", F.lit(False))
        current = own if edges is None else edges if own is None else edges.unionByName(own)
        local = _merged(current.withColumn("_cell", _cell(level, top, bits)), ks)
        if level == top:
            parts.append(out(local, F.lit(True)))
            break
        if top > 1:
            local, _ = materialize(local)
        # Inside a cell, all gaps and the periods between the first and the last are final.
        # At most two rows a cell are left for the level above; the gap between the first
        # and the last of one cell, if any, is already among the final ones.
        outer = F.col("_prev").isNull() | F.col("_last")
        parts.append(out(local, ~outer))
        edges = local.where(outer).select(*ks, "_b", "_f", F.col("_prev").isNotNull().alias("_done"))
    done = parts[0]
    for part in parts[1:]:
        done = done.unionByName(part)
    return done
