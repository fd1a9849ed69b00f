"""From reads to an assembly graph, and from a graph with annotation to the paths of organelles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.functions import sequence as q
from braidwork.operators import align, annotation, chains, clean, coverage, estimate, graph, occurrence, organelle, overlap, paths, syncmer, unzip
from braidwork.operators.correct import CorrectionRules, correct_reads
from braidwork.operators.ordered import numbered
from braidwork.operators.skew import join_by_key
from braidwork.sources.sequences import capped
from braidwork.storage import materialize


@dataclass(frozen=True)
class AssemblyConfig:
    """What an assembly can be told. ``min_kmer`` 0 means: from the coverage histogram."""

    k: int = 1001
    s: int = 31
    min_kmer: int = 30
    arc_part: float = 0.35
    max_bases: int = 0
    bubble: int = 100_000
    tip: int = 10_000
    weak: float = 0.3
    unzip_rounds: int = 3
    correct: bool = True
    covered: float = 0.9

    def __post_init__(self):
        if not 0 < self.s < 32 or self.k <= self.s:
            raise ValueError("needs 0 < s < 32 and s < k")


@dataclass(frozen=True)
class PathConfig:
    """What path finding can be told."""

    rules: annotation.ClassRules = field(default_factory=annotation.ClassRules)
    circle_part: float = 0.9
    min_fraction: float = 0.2
    max_copy: int = 10
    max_paths: int = 1_000_000
    policy: str = "longest"
    clean: bool = True
    bubble: int = 100_000
    tip: int = 10_000
    weak: float = 0.3
    gains: tuple[int, int] = (3, 1)  # genes that a further plastid or mitochondrial component must bring
    min_rest: int = 10_000


@dataclass
class Assembly:
    """Unitigs (``uid, n, seq, len, cov``), links in both directions (``v, w, ln, ls, cov``), members, alignments and k-mers."""

    unitigs: DataFrame
    links: DataFrame
    members: DataFrame
    alignments: DataFrame
    kmers: DataFrame
    occurrences: DataFrame


def _kmer_vertices(occ: DataFrame) -> DataFrame:
    """``vid, kmer, cov``: k-mers numbered in the order of their sequence."""
    counts = occ.groupBy("kmer").agg(F.count(F.lit(1)).alias("cov"))
    return materialize(numbered(counts, ["kmer"], "vid"))[0]


def _arcs(occ: DataFrame, kmers: DataFrame, min_part: float) -> DataFrame:
    """Both directions of arcs between successive k-mers (``sid, idx, v``): v, w, ls, cov."""
    as_kid = occ.select("sid", "idx", F.shiftright("v", 1).alias("kid"), F.col("v").bitwiseAND(F.lit(1).cast("bigint")).cast("int").alias("rev"))
    cov = occurrence.arc_coverage(as_kid)
    arcs = cov.select((F.col("va") * 2 + F.col("vr")).alias("v"), (F.col("wa") * 2 + F.col("wr")).alias("w"), F.lit(0).cast("bigint").alias("ls"), "cov")
    ends = kmers.select("vid", F.col("cov").alias("c"))
    rows = arcs.join(ends.withColumnsRenamed({"vid": "_v", "c": "_cv"}), F.shiftright("v", 1) == F.col("_v")).join(ends.withColumnsRenamed({"vid": "_w", "c": "_cw"}), F.shiftright("w", 1) == F.col("_w"))
    rows = rows.where(F.col("cov") >= min_part * F.least("_cv", "_cw")).select("v", "w", "ls", "cov")
    return materialize(rows.unionByName(graph.twins(rows)))[0]


def _distances(occ: DataFrame) -> DataFrame:
    """Modal distances of successive k-mers in both directions: v, w, d. ``occ``: sid, idx, pos, v, ec."""
    rows = occ.withColumn("kid", F.shiftright("v", 1)).withColumn("rev", F.col("v").bitwiseAND(F.lit(1).cast("bigint")).cast("int"))
    d = overlap.modal_distances(overlap.pair_distances(rows))
    one = d.select((F.col("va") * 2 + F.col("vr")).alias("v"), (F.col("wa") * 2 + F.col("wr")).alias("w"), "d")
    return materialize(one.unionByName(graph.twins(one)).distinct())[0]


def read_kmers(reads: DataFrame, k: int, s: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Reads (``sid, seq, lengths``, runs compressed), their closed syncmers as numbered k-mers, these k-mers, and modal distances.

    A frequent k-mer's occurrences are joined with its number where they lie.
    """
    occ, total = materialize(syncmer.closed_syncmers(reads, k, s))
    kmers = _kmer_vertices(occ)
    rows = join_by_key(occ, kmers.select("vid", "kmer", F.col("cov").alias("_n")), "kmer", "_n", total)
    occ, _ = materialize(rows.select("sid", "idx", F.col("pos").cast("bigint").alias("pos"), (F.col("vid") * 2 + F.col("rev")).alias("v"), F.lit(False).alias("ec")))
    return reads, occ, kmers, _distances(occ)


def assemble(reads: DataFrame, config: AssemblyConfig = AssemblyConfig()) -> Assembly:
    """Reads (``sid, name, seq``) to unitigs.

    Runs are compressed, closed syncmers chosen and counted, errors corrected by the graph,
    the graph cleaned, reads aligned to its unitigs and ways through repeats separated.
    """
    c = config
    reads, _ = materialize(capped(reads.where("seq is not null"), c.max_bases).select("sid", q.compress_runs("seq").alias("seq"), q.run_lengths("seq").alias("lengths")))
    reads, occ, kmers, distances = read_kmers(reads, c.k, c.s)
    least = c.min_kmer
    if not least:
        hist = occurrence.count_of_counts(occ.select((F.shiftright("v", 1)).alias("kid")), "kid")
        least = occurrence.automatic_cutoff(*occurrence.coverage_peaks([(r["mult"], r["n"]) for r in hist.collect()]))
    if c.correct:
        arcs = _arcs(occ, kmers, 0.0).join(distances, ["v", "w"], "left")
        occ, _ = correct_reads(occ, kmers, arcs, reads, c.k, CorrectionRules(max_error=max(least, 4)))
    counts = occ.groupBy(F.shiftright("v", 1).alias("vid")).agg(F.count(F.lit(1)).alias("cov"))
    kept, _ = materialize(counts.where(F.col("cov") >= max(least, 1)).join(kmers.select("vid", "kmer"), "vid").select("vid", F.lit(1).cast("bigint").alias("len"), "cov", "kmer"))
    known = occ.join(kept.select("vid"), F.shiftright("v", 1) == F.col("vid"), "left_semi")
    arcs = graph.live_arcs(kept, _arcs(occ, kept, c.arc_part))
    unit = lambda n: max(1, n // max(1, c.k // 2))  # noqa: E731  (lengths count k-mers here)
    vs, es = clean.cleaned(kept, materialize(arcs)[0], unit(c.tip), unit(c.bubble), c.weak, bubbles=not c.unzip_rounds)
    members, sizes, links = _unitigs(vs, es, kept)
    known, _ = materialize(known)
    aln = align.align_reads(known, members, links, c.covered)
    for _ in range(c.unzip_rounds):
        aln, _ = materialize(aln)
        members, sizes, links, n = unzip.multiplex(members, sizes, links, align.triplet_scores(aln), c.k)
        if not n:
            break
        aln = align.align_reads(known, members, links, c.covered)
    aln, _ = materialize(aln)
    cov, _ = materialize(estimate.alignment_coverage(aln, members, kept))
    spelled = _spelled(known, reads, kept, c.k)
    seqs = overlap.unitig_sequences(members, spelled, distances, c.k)
    table = sizes.drop("cov").join(cov, "uid", "left").join(seqs, "uid")
    table, _ = materialize(table.select("uid", "n", "seq", F.length("seq").cast("bigint").alias("len"), F.greatest(F.coalesce(F.floor("cov"), F.lit(1)), F.lit(1)).cast("bigint").alias("cov")))
    ends = members.groupBy("uid").agg(F.min_by("v", "pos").alias("first"), F.max_by("v", "pos").alias("last"))
    tail = ends.select((F.col("uid") * 2).alias("v"), F.col("last").alias("a")).unionByName(ends.select((F.col("uid") * 2 + 1).alias("v"), graph.turned("first").alias("a")))
    head = ends.select((F.col("uid") * 2).alias("w"), F.col("first").alias("b")).unionByName(ends.select((F.col("uid") * 2 + 1).alias("w"), graph.turned("last").alias("b")))
    joint = links.join(tail, "v").join(head, "w").join(distances.withColumnsRenamed({"v": "a", "w": "b"}), ["a", "b"], "left")
    size = table.select(F.explode(F.array(F.col("uid") * 2, F.col("uid") * 2 + 1)).alias("v"), "len")
    counted = align.link_coverage(aln).withColumnRenamed("cov", "seen")
    done = overlap.link_overlaps(joint.select("v", "w", "ln", "b", "d"), size, spelled, c.k).join(counted, ["v", "w"], "left")
    done, _ = materialize(done.select("v", "w", "ln", "ls", F.greatest(F.coalesce(F.round("seen"), F.lit(1)), F.lit(1)).cast("bigint").alias("cov")))
    return Assembly(table, done, members, aln, kept, known)


def _unitigs(vs: DataFrame, es: DataFrame, kmers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    members, table, links = chains.unitigs(vs, es)
    members, _ = materialize(members)
    cov = coverage.unitig_coverage(members, kmers)
    sizes, _ = materialize(table.select("uid", "n").join(cov, "uid").select("uid", "n", F.floor("cov").cast("bigint").alias("cov")))
    links, _ = materialize(links.select("v", "w", F.lit(0).alias("ln"), "cov"))
    return members, sizes, links


def _spelled(occ: DataFrame, reads: DataFrame, kmers: DataFrame, k: int) -> DataFrame:
    """``vid, kmer, lengths``: k-mers with the mean lengths of their runs."""
    rows = occ.select("sid", "pos", "ec", F.shiftright("v", 1).alias("kid"), F.col("v").bitwiseAND(F.lit(1).cast("bigint")).cast("int").alias("rev"))
    got = overlap.run_consensus(rows, reads.select("sid", "lengths"), kmers.select(F.col("vid").alias("kid"), "kmer"), k)
    return materialize(got.withColumnRenamed("kid", "vid"))[0]


@dataclass
class Found:
    """Components with their class, all paths, the chosen ones, hits on these, and segments of typed components on no chosen path."""

    classes: DataFrame
    paths: DataFrame
    chosen: DataFrame
    places: DataFrame
    rest: DataFrame


def find_paths(vertices: DataFrame, arcs: DataFrame, hits: DataFrame, config: PathConfig = PathConfig()) -> Found:
    """Paths of the components with a type. ``vertices``: vid, name, seq, len, cov; ``arcs``: v, w, ls, cov; ``hits`` as read.

    Components that bring no genes are left out. Circular plastids begin at their first core gene, in the direction in
    which the order of genes fits better. ``rest`` (cid, og_type, vid) has the segments of at least ``min_rest`` bases that are on no
    chosen path, and all segments of components with too many paths.
    """
    c = config
    vs, _ = materialize(vertices)
    es, _ = materialize(graph.live_arcs(vs, graph.symmetric(arcs)))
    if c.clean:
        vs, es = clean.cleaned(vs, es, c.tip, c.bubble, c.weak)
    place, _ = materialize(graph.components(vs, es))
    hits, _ = materialize(annotation.in_order(hits))
    found, genes = (materialize(x)[0] for x in annotation.component_classes(hits, vs, place, c.rules))
    classes, _ = materialize(annotation.repaired(found, genes, c.rules))
    worth, _ = materialize(annotation.gaining(classes, genes, c.rules.min_score, {annotation.PLTD: c.gains[0], annotation.MITO: c.gains[1]}))
    typed, _ = materialize(classes.where(F.col("og_type") != annotation.UNCLASSIFIED).join(worth, "cid", "left_semi"))
    own = place.join(typed.select("cid"), "cid", "left_semi")
    vs2, _ = materialize(vs.join(own.select("vid"), "vid", "left_semi"))
    copies, _ = materialize(organelle.copy_numbers(vs2, own, c.max_copy, c.min_fraction))
    every, _ = materialize(organelle.all_paths(vs2, es, own, copies, True, c.max_copy, c.max_paths, c.circle_part))
    plastid = every.join(typed.where(F.col("og_type") == annotation.PLTD).select("cid"), "cid", "left_semi")
    order, _ = materialize(organelle.gene_order(plastid, _first_core_genes(hits, vs2, c.rules), copies))
    turned = order.select("cid", "path_no", F.col("v").alias("_v"))
    every, _ = materialize(every.join(turned, ["cid", "path_no"], "left").withColumn("v", F.coalesce("_v", "v")).drop("_v"))
    best, _ = materialize(organelle.chosen(every, typed, c.circle_part, order, c.policy))
    steps = best.select(F.col("cid").alias("path_id"), "circ", F.posexplode("v").alias("pos", "v"))
    placed = paths.placed_steps(steps.where("circ"), vs, es, True).unionByName(paths.placed_steps(steps.where("not circ"), vs, es))
    kept = own.join(vs2.select("vid", "len"), "vid").join(typed.select("cid", "og_type"), "cid")
    free = kept.join(steps.select(F.shiftright("v", 1).alias("vid")).distinct(), "vid", "left_anti").join(best.select("cid", F.lit(True).alias("_has")), "cid", "left")
    rest, _ = materialize(free.where(F.col("_has").isNull() | (F.col("len") >= c.min_rest)).select("cid", "og_type", "vid").distinct())
    return Found(classes, every, best, annotation.lifted(hits, placed, None, c.rules.max_evalue), rest)


def _first_core_genes(hits: DataFrame, vertices: DataFrame, rules: annotation.ClassRules) -> DataFrame:
    """``vid, rank`` of the first core gene, in the usual order of a plastid, whose best hit is on the segment."""
    on = annotation.of_segments(annotation.considered(hits, rules), vertices).where(F.col("og_type") == annotation.PLTD)
    rank = F.array_position(F.array(*[F.lit(g) for g in annotation.PLASTID_ORDER]), F.col("gname"))
    best = on.withColumn("rank", rank.cast("int")).where("rank > 0").groupBy("gname", "rank").agg(F.max_by("vid", F.struct("score", -F.col("vid"))).alias("vid"))
    return best.groupBy("vid").agg(F.min("rank").alias("rank"))


def contigs(found: Found, vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    """``cid, circ, seq, len`` of the chosen paths."""
    steps = found.chosen.select(F.col("cid").alias("path_id"), "circ", F.posexplode("v").alias("pos", "v"))
    ring = paths.path_sequences(steps.where("circ"), vertices, arcs, True).withColumn("circ", F.lit(True))
    line = paths.path_sequences(steps.where("not circ"), vertices, arcs).withColumn("circ", F.lit(False))
    return ring.unionByName(line).withColumnRenamed("path_id", "cid")
