"""Reading assembly graphs: GFA segments and links with their tags, and sequence files as graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.operators.graph import symmetric
from braidwork.operators.ordered import numbered
from braidwork.sources.sequences import read_sequences
from braidwork.storage import materialize

TAG = r"^[A-Za-z][A-Za-z0-9]:[AifZB]:"


def tag(fields: Column, name: str) -> Column:
    """The value of a tag such as ``KC:i`` among the fields of a line; its type must match."""
    found = F.filter(fields, lambda x: x.startswith(f"{name}:"))
    return F.get(F.transform(found, lambda x: F.substr(x, F.lit(len(name) + 2))), F.lit(0))


def valid_tags(fields: Column) -> Column:
    """Whether every optional field is a letter, a letter or digit, a type and a value."""
    return F.forall(fields, lambda x: x.rlike(TAG))


def overlap_length(text: Column) -> Column:
    """Bases of the first segment under an overlap: of a CIGAR its M, D and N; of ``a:b`` a; of ``*`` none."""
    parts = F.regexp_extract_all(text, F.lit(r"([0-9]+)[MDN=X]"), F.lit(1))
    cigar = F.aggregate(parts, F.lit(0).cast("bigint"), lambda t, x: t + x.cast("bigint"))
    pair = F.regexp_extract(text, r"^([0-9]+):[0-9]*$", 1)
    return F.when(pair != "", F.expr("1") * pair.try_cast("bigint")).otherwise(cigar)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place: file, split and order."""
    rows = spark.read.text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))


def read_gfa(spark: SparkSession, path: str, kmer_tag: str | None = None, seq_tag: str = "SC:f", arc_tag: str = "EC:i") -> tuple[DataFrame, DataFrame]:
    """Segments ``vid, name, seq, len, cov`` and both directions of links ``v, w, ls, cov``.

    Segments are numbered in the order of their lines; those only named in links follow with
    length 0. Coverage is the k-mer tag per base, else the sequence tag, else KC or FC per base; nothing or
    0 counts as 1. A repeated segment name, a broken line or tag is an error.
    """
    lines, _ = materialize(read_lines(spark, path).where(F.col("value").rlike("^[SL]\t")).withColumn("x", F.split("value", "\t")))
    tags = lambda first: F.slice("x", first, F.greatest(F.size("x") - (first - 1), F.lit(0)))
    s = lines.where(F.col("value").startswith("S")).withColumn("t", F.filter(tags(4), lambda y: y != ""))
    s = s.withColumn("t", F.when((F.size("x") >= 3) & valid_tags("t"), F.col("t")).otherwise(F.raise_error(F.concat(F.lit("broken segment: "), "value"))))
    seq = F.nullif(F.col("x")[2], F.lit("*"))
    size = F.coalesce(F.length(seq), tag(F.col("t"), "LN:i").cast("bigint"), F.lit(0)).cast("bigint")
    number = lambda name: tag(F.col("t"), name).cast("double")
    base = F.nullif(size.cast("double"), F.lit(0.0))
    choices = ([number(kmer_tag) / base] if kmer_tag else []) + [number(seq_tag), number("KC:i") / base, number("FC:i") / base]
    cov = F.coalesce(*choices, F.lit(0.0)).cast("bigint")
    segs = s.select(F.col("x")[1].alias("name"), seq.alias("seq"), size.alias("len"), F.when(cov == 0, 1).otherwise(cov).alias("cov"), "f", "b", "i")
    if not segs.groupBy("name").count().where("count > 1").isEmpty():
        raise ValueError(f"{path}: a segment name is repeated")

    k = lines.where(F.col("value").startswith("L")).withColumn("t", F.filter(tags(7), lambda y: y != ""))
    ok = (F.size("x") >= 5) & F.col("x")[2].isin("+", "-") & F.col("x")[4].isin("+", "-") & valid_tags("t")
    k = k.withColumn("t", F.when(ok, F.col("t")).otherwise(F.raise_error(F.concat(F.lit("broken link: "), "value"))))
    ec = F.coalesce(tag(F.col("t"), arc_tag).cast("bigint"), F.lit(0))
    links, _ = materialize(k.select(
        F.col("x")[1].alias("a"), (F.col("x")[2] == "-").cast("bigint").alias("ar"), F.col("x")[3].alias("c"), (F.col("x")[4] == "-").cast("bigint").alias("cr"),
        F.coalesce(overlap_length(F.get("x", F.lit(5))), F.lit(0)).alias("ls"), F.when(ec == 0, 1).otherwise(ec).alias("cov"),
    ))
    named = links.select(F.explode(F.array("a", "c")).alias("name")).distinct().join(segs.select("name"), "name", "left_anti")
    none = F.lit(None)
    added = named.select("name", none.cast("string").alias("seq"), F.lit(0).cast("bigint").alias("len"), F.lit(1).cast("bigint").alias("cov"), F.lit("￿").alias("f"), F.lit(0).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("i"))
    vertices, _ = materialize(numbered(segs.unionByName(added), ["f", "b", "i", "name"], "vid").select("vid", "name", "seq", "len", "cov"))
    ids = vertices.select("vid", "name")
    at = lambda n, i: ids.select(F.col("name").alias(n), F.col("vid").alias(i))
    arcs = links.join(at("a", "va"), "a").join(at("c", "vc"), "c")
    arcs = arcs.select((F.col("va") * 2 + F.col("ar")).alias("v"), (F.col("vc") * 2 + F.col("cr")).alias("w"), "ls", "cov")
    return vertices, symmetric(arcs)


def read_graph(spark: SparkSession, path: str, **tags) -> tuple[DataFrame, DataFrame]:
    """A graph by the first letter of its file: '>' FASTA and '@' FASTQ give segments without links, else GFA."""
    first = spark.read.text(path).where("value <> ''").limit(1).collect()
    if first and first[0]["value"][0] in ">@":
        rows = read_sequences(spark, [path])
        one = F.lit(1).cast("bigint")
        vertices = rows.select(F.col("sid").alias("vid"), "name", "seq", F.length("seq").cast("bigint").alias("len"), one.alias("cov"))
        if not vertices.groupBy("name").count().where("count > 1").isEmpty():
            raise ValueError(f"{path}: a segment name is repeated")
        return vertices, spark.createDataFrame([], "v bigint, w bigint, ls bigint, cov bigint")
    return read_gfa(spark, path, **tags)
