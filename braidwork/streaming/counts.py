"""K-mer and arc counts over a stream of records that may come late or twice.

Records have ``rec_id, sid, h, seen_at`` as in the record table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kmer_counts(records: DataFrame, window: str = "1 hour", late: str = "2 days") -> DataFrame:
    """``beg, fin, h, n``: live records of each k-mer by the time they were seen.

    A record delivered again within ``late`` counts once, as state is kept that long; what
    arrives later than ``late`` behind the newest is dropped by the watermark, so choose it as
    long as deliveries may take. Null k-mers, ids and times and deleted records don't count. A k-mer that
    holds a third of all records is combined before the shuffle.
    """
    live = records.where("del = false and h is not null and rec_id is not null and seen_at is not null")
    once = live.select("rec_id", "h", F.col("seen_at").cast("timestamp").alias("seen_at")).withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["rec_id"])
    counts = once.groupBy(F.window("seen_at", window).alias("w"), "h").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("beg"), F.col("w.end").alias("fin"), "h", "n")
