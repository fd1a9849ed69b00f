"""Annotation by an external profile search, where its program is installed.

Batches of sequences go to the program's standard input, its table comes from standard
output. Without the program, tables made elsewhere are read by :mod:`hits`.
"""

from __future__ import annotations

import shlex
import subprocess

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.sources.sequences import batches

COMMAND = "nhmmscan --noali --cpu 1 -o /dev/null --tblout /dev/stdout {database} -"
TRIES = 3


def search(records: DataFrame, database: str, bases: int = 100_000, command: str = COMMAND) -> DataFrame:
    """The lines of the program's tables: ``batch, value``. ``records``: sid, name, seq.

    Each batch of about ``bases`` bases is one call, repeated up to TRIES times; a batch
    that fails every time is an error. ``database`` must be there on every executor.
    """
    rows = batches(records, bases).select("batch", "sid", "name", "seq")
    call = shlex.split(command.format(database=shlex.quote(database)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("sid")
        text = "".join(f">{n}\n{s}\n" for n, s in zip(frame["name"], frame["seq"]))
        for left in reversed(range(TRIES)):
            done = subprocess.run(call, input=text, capture_output=True, text=True)
            if done.returncode == 0:
                break
            if not left:
                raise RuntimeError(f"{call[0]} failed: {done.stderr[-500:]}")
        return pd.DataFrame({"batch": frame["batch"].iat[0], "value": [x for x in done.stdout.splitlines() if x and x[0] != "#"]})

    return rows.groupBy("batch").applyInPandas(run, "batch bigint, value string").orderBy("batch")


def as_table(found: DataFrame) -> DataFrame:
    """Only the lines, for :func:`braidwork.sinks.lines.write_lines`."""
    return found.select(F.col("value"))
