"""Alignment of reads to unitigs by their shared k-mers, and what is counted on it.

Occurrences have ``sid, idx, v`` (oriented k-mer numbers), members ``uid, pos, v``, links
``v, w, ln`` between oriented unitigs, where ``ln`` k-mers are shared at the junction.
Candidate pairs come from joins; only the chaining of one read's own fragments runs in
Python, on groups as large as a read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.functions.editing import align, cigar_text
from braidwork.operators.onetask import spread
from braidwork.operators.skew import join_by_key
from braidwork.storage import materialize

FRAGMENTS = "sid bigint, frg int, uid bigint, u_beg int, u_end int, s_beg int, s_end int, score int"
ALIGNED = "sid bigint, aln_id int, frag int, uid bigint, u_beg int, u_end int, s_beg int, s_end int, score int, n_aln int"
#: Equally good chains of a read that are listed; a read with more has one row that says how many.
MAX_CHAINS = 100_000


def member_index(members: DataFrame) -> DataFrame:
    """``vid, uid, rev, pos, n, times``: where each k-mer lies on unitigs, and on how many places."""
    n = members.groupBy("uid").agg(F.count(F.lit(1)).alias("n"))
    rows = members.join(n, "uid").select(F.shiftright("v", 1).alias("vid"), "uid", F.col("v").bitwiseAND(F.lit(1).cast("bigint")).alias("rev"), "pos", "n")
    times = rows.groupBy("vid").agg(F.count(F.lit(1)).alias("times"))
    return rows.join(times, "vid")


def seeds(occ: DataFrame, index: DataFrame) -> DataFrame:
    """``sid, uid, s, u, n``: reads' k-mers on oriented unitigs, with the place read in that orientation."""
    # A k-mer with a tenth of all occurrences is looked up where these lie.
    own = occ.select("sid", "idx", "v", F.shiftright("v", 1).alias("vid"))
    seen, total = materialize(own.groupBy("vid").agg(F.count(F.lit(1)).alias("_n")))
    total = seen.agg(F.sum("_n")).first()[0] or 0
    places = index.groupBy("vid").agg(F.collect_list(F.struct("uid", "rev", "pos", "n")).alias("_at")).join(seen, "vid")
    rows = join_by_key(own, places, "vid", "_n", total).select("sid", "idx", "v", F.inline("_at"))
    turned = F.col("v").bitwiseAND(F.lit(1).cast("bigint")) != F.col("rev")
    return rows.select(
        "sid", (F.col("uid") * 2 + turned.cast("bigint")).alias("uid"), F.col("idx").cast("int").alias("s"),
        F.when(turned, F.col("n") - 1 - F.col("pos")).otherwise(F.col("pos")).cast("int").alias("u"), F.col("n").cast("int").alias("n"),
    )


def chain_seeds(pairs: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Chains (u_beg, u_end, s_beg, s_end, score) of (s, u) in increasing order on both.

    Each seed goes to the open chain that ends nearest below it on the unitig, or begins
    one. The score is the number of seeds less the widest gap on the unitig.
    """
    open_: list[list[int]] = []  # u_beg, u_end, s_beg, s_end, seeds, widest gap
    for s, u in sorted(pairs):
        fit = [c for c in open_ if c[1] < u and c[3] < s]
        if fit:
            c = max(fit, key=lambda x: x[1])
            c[5] = max(c[5], u - c[1] - 1)
            c[1], c[3], c[4] = u, s, c[4] + 1
        else:
            open_.append([u, u, s, s, 1, 0])
    return [(c[0], c[1], c[2], c[3], c[4] - c[5]) for c in open_ if c[4] - c[5] > 0]


def fragments(pairs: DataFrame) -> DataFrame:
    """Chains of seeds on one unitig, numbered within the read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for sid, *columns in zip(frame["sid"], frame["uid"], frame["s"], frame["u"]):
                by = defaultdict(list)
                for uid, s, u in zip(*(c.tolist() for c in columns)):
                    by[uid].append((s, u))
                rows = [(uid, *c) for uid, seeds_ in by.items() for c in chain_seeds(seeds_)]
                rows.sort(key=lambda r: (r[3], r[4], r[0], r[1]))
                out += [(sid, i, *r) for i, r in enumerate(rows)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FRAGMENTS.split(", ")])

    return _by_read(spread(pairs.select("sid", "uid", "s", "u"), "sid"), ["uid", "s", "u"]).mapInPandas(run, FRAGMENTS)


def _by_read(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row a read, with an array for each column, in ascending order of the columns. A read is as long as it is."""
    held = rows.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_x"))
    part = lambda c: F.transform("_x", lambda x: x[c]).alias(c)
    return held.select("sid", *[part(c) for c in columns])


def best_chains(score: list[int], after: dict[int, list[int]]) -> tuple[int, list[list[int]]]:
    """The best total and all ways to reach it, of items in an order that ``after`` respects; none if there are more than MAX_CHAINS."""
    best, nexts, starts, n = _best_ways(score, after)
    out: list[list[int]] = []
    stack = [[i] for i in reversed(starts)] if n <= MAX_CHAINS else []
    while stack:
        path = stack.pop()
        if not nexts[path[-1]]:
            out.append(path)
        stack += [path + [j] for j in reversed(nexts[path[-1]])]
    return best, out


def count_chains(score: list[int], after: dict[int, list[int]]) -> int:
    """How many ways reach the best total, without listing them."""
    return _best_ways(score, after)[3]


def _best_ways(score: list[int], after: dict[int, list[int]]) -> tuple[int, list[list[int]], list[int], int]:
    """The best total, the items after each on a best way, those that begin one, and the number of best ways."""
    n = len(score)
    best, nexts, ways = list(score), [[] for _ in score], [1] * n
    for i in reversed(range(n)):
        rest = max([best[j] for j in after.get(i, [])], default=0)
        if rest:
            nexts[i] = [j for j in after[i] if best[j] == rest]
            ways[i] = sum(ways[j] for j in nexts[i])
        best[i] += rest
    top = max(best, default=0)
    starts = [i for i in range(n) if best[i] == top]
    return top, nexts, starts, sum(ways[i] for i in starts)


def align_reads(occ: DataFrame, members: DataFrame, links: DataFrame, covered: float = 0.9) -> DataFrame:
    """Best chains of fragments over links, for reads of which at least ``covered`` of the k-mers are used.

    Two fragments follow each other if a link joins their unitigs, the first reaches the
    end of its unitig, the second begins at its start, and they share exactly the k-mers of the link. All
    equally good chains are kept; ``n_aln`` is their number. A read with more than MAX_CHAINS of them has one row with
    an ``aln_id`` of -1, no fragment and the number; what is counted on alignments leaves it out.
    """
    index = member_index(members)
    pairs = seeds(occ, index)
    frg = fragments(pairs)
    size = members.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(F.col("uid") * 2, F.col("uid") * 2 + 1)).alias("uid"), "n")
    sized = frg.join(size, "uid")
    left = sized.where("u_end = n - 1").select("sid", F.col("frg").alias("a"), F.col("uid").alias("v"), F.col("s_end").alias("_e"))
    right = sized.where("u_beg = 0").select("sid", F.col("frg").alias("b"), F.col("uid").alias("w"), F.col("s_beg").alias("_s"))
    # Neighbours on the read first: a k-mer with very many links would meet all of them.
    shared = [r["ln"] for r in links.select(F.col("ln").cast("int").alias("ln")).distinct().collect()]  # at most k values
    offered = left.withColumn("ln", F.explode(F.array(*[F.lit(x) for x in shared]) if shared else F.array().cast("array<int>")))
    beside = offered.withColumn("_s", F.col("_e") + 1 - F.col("ln")).join(right, ["sid", "_s"]).where("a <> b")
    joined = beside.join(links.select("v", "w", F.col("ln").cast("int").alias("ln")).distinct(), ["v", "w", "ln"], "left_semi")
    length = occ.groupBy("sid").agg(F.count(F.lit(1)).alias("total"))
    names = [c.split()[0] for c in FRAGMENTS.split(", ")][1:]
    held = _by_read(spread(frg, "sid"), names)
    edges = _by_read(spread(joined.select("sid", "a", "b", F.col("ln").cast("int").alias("ln")), "sid"), ["a", "b", "ln"])
    whole = held.join(edges, "sid", "left").join(length, "sid").select("sid", *names, "a", "b", "ln", "total")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in ALIGNED.split(", ")]
        for frame in frames:
            out = []
            for sid, _, uid, u_beg, u_end, s_beg, s_end, score, a, b, ln, total in frame.itertuples(index=False):
                after, shared = defaultdict(list), {}
                for x, y, n in zip(*(c.tolist() for c in (a, b, ln))) if a is not None else ():
                    after[x].append(y)
                    shared[x, y] = n
                at = list(zip(*(c.tolist() for c in (uid, u_beg, u_end, s_beg, s_end))))
                top, chains = best_chains(score.tolist(), after)
                if not chains:
                    out.append((sid, -1, 0, None, None, None, None, None, top, min(count_chains(score.tolist(), after), 2**31 - 1)))
                    continue
                used = lambda path: sum(at[i][4] - at[i][3] + 1 for i in path) - sum(shared[x] for x in zip(path, path[1:]))  # noqa: B023, E731
                chains = [c for c in chains if used(c) >= covered * total]
                out += [(sid, k, i, *at[x], top, len(chains)) for k, path in enumerate(chains) for i, x in enumerate(path)]
            yield pd.DataFrame(out, columns=columns).astype({c: "Int64" for c in columns})

    return whole.mapInPandas(run, ALIGNED)


def informative(occ: DataFrame, before: DataFrame) -> DataFrame:
    """Occurrences of the reads that lay on three or more unitigs in an earlier alignment."""
    many = before.groupBy("sid", "aln_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("sid").distinct()
    return occ.join(many, "sid", "left_semi")


def not_worse(now: DataFrame, before: DataFrame) -> DataFrame:
    """Alignments of reads whose score is no lower than it was."""
    old = before.groupBy("sid").agg(F.max("score").alias("_old"))
    return now.join(old, "sid", "left").where("_old is null or score >= _old").drop("_old")


def _steps(aln: DataFrame, n: int) -> DataFrame:
    along = Window.partitionBy("sid", "aln_id").orderBy("frag")
    ahead = [F.lead("uid", i).over(along).alias(f"u{i}") for i in range(1, n)]
    return aln.select(F.col("uid").alias("u0"), *ahead, (1 / F.col("n_aln")).alias("part")).where(f"u{n - 1} is not null")


def link_coverage(aln: DataFrame, unique: DataFrame | None = None) -> DataFrame:
    """``v, w, cov``: alignments that cross a link, each as its part of the read's; both directions.

    With ``unique`` (uid) only links whose both unitigs hold a k-mer of their own count.
    """
    rows = _steps(aln, 2).select(F.col("u0").alias("v"), F.col("u1").alias("w"), "part")
    if unique is not None:
        for c in ("v", "w"):
            rows = rows.join(unique.select(F.col("uid").alias("_u")), F.shiftright(c, 1) == F.col("_u"), "left_semi")
    one = F.lit(1).cast("bigint")
    both = rows.unionByName(rows.select(F.col("w").bitwiseXOR(one).alias("v"), F.col("v").bitwiseXOR(one).alias("w"), "part"))
    return both.groupBy("v", "w").agg(F.sum("part").alias("cov"))


def triplet_scores(aln: DataFrame) -> DataFrame:
    """``a, u, b, score``: alignments through u from a to b, and the same read backwards."""
    rows = _steps(aln, 3).select(F.col("u0").alias("a"), F.col("u1").alias("u"), F.col("u2").alias("b"), "part")
    one = F.lit(1).cast("bigint")
    turn = lambda c: F.col(c).bitwiseXOR(one)
    both = rows.unionByName(rows.select(turn("b").alias("a"), turn("u").alias("u"), turn("a").alias("b"), "part"))
    return both.groupBy("a", "u", "b").agg(F.sum("part").alias("score"))


def common_blocks(a: list, b: list) -> list[tuple[int, int, int, int]]:
    """Blocks (a_beg, a_end, b_beg, b_end), ends included, of a longest common subsequence; adjacent matches are one block."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in reversed(range(len(x))):
        for j in reversed(range(len(y))):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    pairs = [(i, i) for i in range(lo)]
    i = j = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            pairs.append((lo + i, lo + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    pairs += [(len(a) - hi + t, len(b) - hi + t) for t in range(hi)]
    blocks: list[list[int]] = []
    for p, q in pairs:
        if blocks and blocks[-1][1] == p - 1 and blocks[-1][3] == q - 1:
            blocks[-1][1], blocks[-1][3] = p, q
        else:
            blocks.append([p, p, q, q])
    return [tuple(x) for x in blocks]


def shared_intervals(aln: DataFrame) -> DataFrame:
    """``sid, beg, fin, uids``: stretches of a read over which its alignments name the same unitigs.

    The ends of all fragments cut the read; each piece lists the unitigs of the fragments
    over it, once for every alignment. Pieces that not all alignments cover are left out.
    One sweep over the ends of a read's fragments counts what is open.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        events = defaultdict(list)
        for a, u, beg, end in zip(frame["aln_id"], frame["uid"], frame["s_beg"], frame["s_end"]):
            events[int(beg)].append((1, int(a), int(u) >> 1))
            events[int(end) + 1].append((-1, int(a), int(u) >> 1))
        cuts, n = sorted(events), int(frame["n_aln"].iat[0])
        alns, uids, out = Counter(), Counter(), []
        for beg, end in zip(cuts, cuts[1:]):
            for step, a, u in events[beg]:
                for count, x in ((alns, a), (uids, u)):
                    count[x] += step
                    if not count[x]:
                        del count[x]
            if len(alns) == n:
                out.append((frame["sid"].iat[0], beg, end - 1, sorted(uids)))
        return pd.DataFrame(out, columns=["sid", "beg", "fin", "uids"])

    return spread(aln.where("aln_id >= 0"), "sid").groupBy("sid").applyInPandas(run, "sid bigint, beg int, fin int, uids array<bigint>")


def edit_alignments(pairs: DataFrame, target: str, query: str, key: str, band: int, extend: bool = False) -> DataFrame:
    """``key, score, target_end, query_end, cigar`` of pairs of sequences; null score beyond ``band``.

    For the mere score of whole sequences the built-in ``levenshtein`` with a threshold does.
    """

    def run(frames):
        for f in frames:
            got = [None if t is None or q is None else align(t, q, extend, band, True) for t, q in zip(f["t"], f["q"])]
            rows = [(k, None, None, None, None) if a is None else (k, a.score, a.target_end, a.query_end, cigar_text(a.cigar)) for k, a in zip(f["k"], got)]
            yield pd.DataFrame(rows, columns=["k", "score", "target_end", "query_end", "cigar"]).astype({c: "Int64" for c in ("score", "target_end", "query_end")})

    rows = pairs.select(F.col(key).cast("bigint").alias("k"), F.col(target).alias("t"), F.col(query).alias("q"))
    return rows.mapInPandas(run, "k bigint, score bigint, target_end bigint, query_end bigint, cigar string").withColumnRenamed("k", key)
