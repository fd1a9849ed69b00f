"""Reading FASTA and FASTQ files, plain or compressed, from any file system pyarrow or Hadoop knows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.operators.ordered import filled, numbered, running_total

SCHEMA = "file_no int, record bigint, name string, comment string, seq string, qual string"
BATCH = 10_000


def parse_records(lines: Iterator[str], where: str = "") -> Iterator[tuple[str, str | None, str, str | None]]:
    """(name, comment, sequence, quality) of FASTA or FASTQ lines; sequences may span lines.

    A quality shorter than its sequence at the end of the input is an error, as is a longer one.
    """
    line = next(lines, None)
    while line is not None:
        if not line or line[0] not in ">@":
            line = next(lines, None)
            continue
        name, _, comment = line[1:].replace("\t", " ", 1).partition(" ")
        seq: list[str] = []
        line = next(lines, None)
        while line is not None and line[:1] not in (">", "@", "+"):
            seq.append(line.strip())
            line = next(lines, None)
        bases, qual = "".join(seq), None
        if line is not None and line[0] == "+":
            held, n = [], 0
            while n < len(bases) and (line := next(lines, None)) is not None:
                held.append(line)
                n += len(line)
            if n != len(bases):
                raise ValueError(f"{where}: quality of {name} has {n} letters for {len(bases)} bases")
            qual = "".join(held)
            line = next(lines, None)
        yield name, comment or None, bases, qual


def _lines(path: str) -> Iterator[str]:
    """Lines of a file, decompressed by its extension, as a stream."""
    import io

    import pyarrow as pa
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    with system.open_input_stream(inner, compression="detect") as raw:
        for line in io.TextIOWrapper(io.BufferedReader(pa.PythonFile(raw, mode="r")), encoding="latin-1"):
            yield line.rstrip("\r\n")


def read_sequences(spark: SparkSession, files: list[str]) -> DataFrame:
    """``sid, name, comment, seq, qual`` of all records, numbered from 0 in the order of files and records.

    One task streams one file. For a single large FASTA file without compression
    :func:`read_fasta` splits it. Empty files have no records and don't end the input.
    """
    listed = spark.createDataFrame(list(enumerate(files)), "file_no int, path string").repartition(max(1, len(files)), "file_no")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file_no, path in zip(frame["file_no"], frame["path"]):
                held = []
                for i, record in enumerate(parse_records(_lines(path), path)):
                    held.append((file_no, i, *record))
                    if len(held) >= BATCH:
                        yield pd.DataFrame(held, columns=["file_no", "record", "name", "comment", "seq", "qual"])
                        held = []
                yield pd.DataFrame(held, columns=["file_no", "record", "name", "comment", "seq", "qual"])

    rows = numbered(listed.mapInPandas(run, SCHEMA), ["file_no", "record"], "sid")
    return rows.select("sid", "name", "comment", "seq", "qual")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``sid, name, comment, seq`` of plain FASTA, split among tasks at record starts.

    A '>' within a header would start a record; such files need :func:`read_sequences`.
    """
    rows = spark.read.option("lineSep", ">").text(path)
    rows = rows.select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    rows = rows.where("length(trim(value)) > 0")
    head = F.regexp_extract("value", r"^([^\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    name = F.regexp_extract(head, r"^(\S*)", 1)
    comment = F.nullif(F.trim(F.regexp_replace(head, r"^\S*\s?", "")), F.lit(""))
    return numbered(rows.select("f", "b", "i", name.alias("name"), comment.alias("comment"), body.alias("seq")), ["f", "b", "i"], "sid").drop("f", "b", "i")


def capped(reads: DataFrame, bases: int) -> DataFrame:
    """The first reads up to and with the one that reaches ``bases``; all if ``bases`` is 0."""
    if not bases:
        return reads
    rows = running_total(reads.withColumn("_n", F.length("seq")), ["sid"], "_n", "_upto")
    return rows.where(F.col("_upto") - F.coalesce("_n", F.lit(0)) < bases).drop("_n", "_upto")


def size_of(text: str) -> int:
    """A number of bases with an optional K, M or G (steps of 1024)."""
    unit = {"k": 10, "m": 20, "g": 30}.get(text[-1:].lower())
    return int(float(text[:-1]) * (1 << unit)) if unit else int(text)


def batches(records: DataFrame, bases: int) -> DataFrame:
    """Records (``sid`` is a key) with ``batch``, which ends with the record that brings it to ``bases`` or more.

    The next one counts anew. A record is never cut. A null sequence is an error, as it can't be searched.
    """
    size = F.when(F.col("seq").isNull(), F.raise_error("a record has no sequence").cast("int")).otherwise(F.length("seq"))
    return filled(records.withColumn("_n", size), ["sid"], "_n", bases, "batch").drop("_n")
