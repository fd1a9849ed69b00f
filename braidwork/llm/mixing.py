"""Mixing sources to target weights.

Every document belongs to the sources by degrees: wholly to its own where it is labelled,
and by the posterior of a classifier fitted to labelled rows where it isn't. Posteriors are
those of CELLS cells of like documents, each with the shares of the sources among the
labelled rows in it, so there are only as many memberships as sources and cells. Tokens are
summed by membership over all documents. Nonnegative rates are fitted to these sums by
projected gradient steps, so that the expected tokens of every source meet its target:
documents of one membership have one gradient, hence one rate, and a step over the sums is
the step over all documents. Rates become whole copies by a hash of the document; where
all documents of a source are labelled alike, one threshold, chosen from histograms of tokens, makes the tokens
taken meet what is left of the target.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.encode import FOLDER, VOCABULARY, _encoded, encoder
from braidwork.llm.repetition import words_of
from braidwork.llm.texts import strings
from braidwork.storage import materialize

#: The classifier is fitted to about this many labelled rows a source at most.
FIT_ROWS = 1000
WORD_BUCKETS = 128
SIZE_KNOTS = 16
WIDTH = WORD_BUCKETS + 16 + SIZE_KNOTS + 2
CELLS = 64
FIT_STEPS = 150
#: Weights of the penalty on words that are tried; one row in FOLD judges them.
PENALTIES = (1e-4, 3e-3, 1e-1)
FOLD = 4
MAX_STEPS = 200
#: Steps end when the residual, or what a step takes off it, is a smaller part of the mix.
TOLERANCE = 1e-6
PLACES = 4096


def features(text: str | None, lang: str | None) -> np.ndarray:
    """Hashed words as shares, the hashed language, and the size between knots of its logarithm."""
    out = np.zeros(WIDTH, np.float32)
    text = text or ""
    words = words_of(text)
    for w in words:
        out[zlib.crc32(w.encode("utf-8", "replace")) % WORD_BUCKETS] += 1
    out[:WORD_BUCKETS] /= max(1, len(words)) / 8
    out[WORD_BUCKETS + zlib.crc32((lang or "").strip().lower()[:2].encode("utf-8", "replace")) % 16] = 1
    size = min(np.log2(1 + len(text)) / 14, 1.0) * (SIZE_KNOTS - 1)
    knot = min(int(size), SIZE_KNOTS - 2)
    out[WORD_BUCKETS + 16 + knot : WORD_BUCKETS + 18 + knot] = knot + 1 - size, size - knot
    out[-2] = text.count("\n") > 0
    out[-1] = 1
    return out


@dataclass
class SourceClassifier:
    """Softmax regression over :func:`features`, and cells of like posteriors with the shares of sources seen in them."""

    sources: list[str]
    weights: np.ndarray
    log_prior: np.ndarray
    centres: np.ndarray
    shares: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, sources: list[str], prior: np.ndarray) -> SourceClassifier:
        """Rows count the same for every source in the fit; ``prior``, the labelled rows a source, is put back after it.

        The penalty on words is the one under which held-out rows are likeliest.
        """
        share = prior / prior.sum()
        log_prior = np.log(share)
        row_prior = (share / np.maximum(np.bincount(y, minlength=len(sources)), 1))[y]
        test = np.arange(len(y)) % FOLD == FOLD - 1
        loss = []
        for penalty in PENALTIES if test.any() and not test.all() else PENALTIES[:1]:
            p = softmax(x[test] @ _regression(x[~test], y[~test], len(sources), penalty) + log_prior)
            loss.append(float(-(row_prior[test] * np.log(np.maximum(p[np.arange(len(p)), y[test]], 1e-12))).sum()))
        w = _regression(x, y, len(sources), PENALTIES[int(np.argmin(loss))])
        p = softmax(x @ w + log_prior)
        centres = _centres(p, row_prior)
        seen = np.zeros((len(centres), len(sources)))
        np.add.at(seen, (_nearest(p, centres), y), row_prior * len(y))
        seen += share * 0.5
        return SourceClassifier(sources, w, log_prior, centres, seen / seen.sum(axis=1, keepdims=True))

    def posterior(self, x: np.ndarray) -> np.ndarray:
        return softmax(x @ self.weights + self.log_prior)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row; ``shares`` has the sources' shares in it."""
        return _nearest(self.posterior(x), self.centres)


def _regression(x: np.ndarray, y: np.ndarray, k: int, penalty: float) -> np.ndarray:
    row_weight = (1 / np.maximum(np.bincount(y, minlength=k), 1))[y][:, None]
    row_weight /= row_weight.sum() or 1
    on = np.where(np.arange(x.shape[1]) < WORD_BUCKETS, penalty, 1e-4)[:, None]
    want = np.eye(k)[y]
    w, m, v = np.zeros((x.shape[1], k)), 0.0, 0.0
    for t in range(1, FIT_STEPS + 1):
        grad = x.T @ ((softmax(x @ w) - want) * row_weight) + on * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def _nearest(p: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * p @ centres.T).argmin(axis=1)


def _centres(p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """At most CELLS centres of posteriors: begun far from each other, then moved to the means of their rows."""
    if not len(p):
        return np.zeros((1, p.shape[1]))
    at, far = [0], ((p - p[0]) ** 2).sum(axis=1)
    while len(at) < CELLS and far.max() > 1e-6:
        at.append(int(far.argmax()))
        far = np.minimum(far, ((p - p[at[-1]]) ** 2).sum(axis=1))
    centres = p[at]
    for _ in range(10):
        own, mass = _nearest(p, centres), np.zeros(len(at))
        np.add.at(mass, own, weight)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, p * weight[:, None])
        centres = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-300)[:, None], centres)
    return centres


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_classifier(docs: DataFrame, fit_rows: int = FIT_ROWS) -> SourceClassifier | None:
    """A classifier of ``source`` from ``text`` and ``lang``; None without labelled rows.

    Priors are counted over all labelled rows. The fit takes the rows of a source whose
    hash falls below ``fit_rows`` divided by the rows of that source. Sources are taken to
    be few: their names and counts come to the driver.
    """
    labelled = docs.where("source is not null")
    prior = {r["source"]: r["n"] for r in labelled.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not prior:
        return None
    sources = sorted(prior)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.create_map(*[F.lit(x) for s in sources for x in (s, min(1.0, fit_rows / prior[s]))])
    part = labelled.where(place < F.element_at(rate, F.col("source")))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t, g) for t, g in zip(strings(batch.column(1)), strings(batch.column(2)))]
            flat = pa.array(np.concatenate(x) if x else np.zeros(0, np.float32))
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)], ["source", "x"])

    rows = part.select("source", "text", "lang").mapInArrow(run, "source string, x array<float>").toArrow()
    at = {s: i for i, s in enumerate(sources)}
    y = np.array([at[s] for s in rows["source"].to_pylist()], int)
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(-1, WIDTH).astype(float) if len(y) else np.zeros((0, WIDTH))
    return SourceClassifier.fit(x, y, sources, np.array([prior[s] for s in sources], float))


def memberships(docs: DataFrame, model: SourceClassifier | None, folder: str, vocabulary: str) -> DataFrame:
    """``doc_id, source, cell, tokens``: the cell of ``model`` where the source is null, and null where it is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = encoder(folder, vocabulary)
        for batch in batches:
            sources, texts, langs = (strings(batch.column(i)) for i in (1, 2, 3))
            tokens = [len(x) for x in _encoded(tree, texts)]
            cells = [None] * len(sources)
            open_ = [i for i, s in enumerate(sources) if s is None] if model else []
            if open_:
                for i, c in zip(open_, model.cells(np.stack([features(texts[i], langs[i]) for i in open_]).astype(float))):
                    cells[i] = int(c)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cells, pa.int32()), pa.array(tokens, pa.int64())], ["doc_id", "source", "cell", "tokens"]
            )

    kept = docs.select("doc_id", "source", "text", "lang")
    return kept.mapInArrow(run, "doc_id bigint, source string, cell int, tokens bigint")


@dataclass
class Plan:
    """What the mixes ask for, by mix and source, and the residuals of the steps so far."""

    mixes: list[str]
    sources: list[str]
    share: np.ndarray  # asked for, of 1 a mix
    feasible: np.ndarray  # the same over the sources that have tokens
    cap: np.ndarray
    target: np.ndarray  # in tokens
    held: np.ndarray  # tokens by source, expected
    steps: list[np.ndarray] = field(default_factory=list)

    def rates(self, p: np.ndarray, assigned: np.ndarray) -> np.ndarray:
        """Rates (rows x mixes) of documents with these posteriors, from all steps so far.

        A step divides the gradient by the tokens that the document's sources hold. That
        diagonal bounds the squared operator, so a full step never overshoots, and it meets
        the targets at once where every document has one source and no cap binds.
        """
        cap = self.cap[:, assigned].T
        scale = np.maximum(p @ self.held, 1e-300)[:, None]
        r = np.zeros(cap.shape)
        for residual in self.steps:
            r = np.clip(r - (p @ residual.T) / scale, 0, cap)
        return r


def make_plan(targets: list, hard: dict, soft: np.ndarray, sources: list[str], total: float | None) -> Plan:
    """Targets of each mix; without ``total`` the most for which no source needs more than its repeats."""
    mixes = sorted({t["mix_name"] for t in targets})
    shape = (len(mixes), len(sources))
    weight, cap = np.zeros(shape), np.zeros(shape)
    for t in targets:
        i, j = mixes.index(t["mix_name"]), sources.index(t["source"])
        weight[i, j] += max(0.0, t["weight"] or 0.0)
        cap[i, j] = max(cap[i, j], t["max_repeats"] or 0)
    held = np.array([float(hard.get(s, 0)) for s in sources])
    share = weight / np.maximum(weight.sum(axis=1, keepdims=True), 1e-300)
    usable = np.where((held > 0) & (cap > 0), weight, 0)
    feasible = usable / np.maximum(usable.sum(axis=1, keepdims=True), 1e-300)
    with np.errstate(divide="ignore", invalid="ignore"):
        most = np.where(feasible > 0, cap * held / feasible, np.inf).min(axis=1)
    size = np.where(np.isfinite(most), most, 0.0) if total is None else np.full(len(mixes), float(total))
    return Plan(mixes, sources, share, feasible, cap, feasible * size[:, None], held + soft)


def mix_sources(
    documents: DataFrame, targets: DataFrame, total: float | None = None, folder: str = FOLDER, vocabulary: str = VOCABULARY
) -> tuple[DataFrame, DataFrame]:
    """Documents put together to the weights of ``targets``; the copies taken, and the shares.

    ``documents`` has doc_id, text, lang and source; ``targets`` a few rows of mix_name,
    source, weight and max_repeats. Weights are relative within a mix. A source without
    tokens can't contribute: it is reported with nothing taken, and the others keep their
    proportions. Negative or null weights count as 0, null repeats as none. Documents of a
    null source count for every source by its share in their cell, are named by the likeliest one and repeat no
    more than it. Documents without tokens (null and empty texts) are taken at the rate of
    their source, which changes no share. ``total`` asks for a size in tokens; if a source can't fill
    its part of it, its documents are all taken as often as allowed.

    Returns ``mix_name, doc_id, source, tokens, copies`` (copies of 1 or more), and
    ``mix_name, source, max_repeats, target_share, feasible_share, tokens_held,
    tokens_target, tokens_taken, actual_share, expected_share, docs_taken, most_copies`` for every
    row asked for. ``actual_share`` is by the source named in the first table, ``expected_share``
    divides the documents of a null source by their cell.
    """
    spark = documents.sparkSession
    docs = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")]
    )
    asked = [r for r in targets.select("mix_name", "source", "weight", "max_repeats").collect() if r["mix_name"] is not None and r["source"] is not None]
    model = fit_classifier(docs)
    known = model.sources if model else []
    members, _ = materialize(memberships(docs, model, folder, vocabulary))
    sources = known + sorted({t["source"] for t in asked} - set(known))
    k = len(sources)

    # One row for each membership: the sources themselves, then the cells.
    held = {(r["source"], r["cell"]): r["n"] or 0 for r in members.groupBy("source", "cell").agg(F.sum("tokens").alias("n")).collect()}
    shares = np.pad(model.shares, ((0, 0), (0, k - len(known)))) if model else np.zeros((0, k))
    p = np.concatenate([np.eye(k), shares])
    likeliest = p.argmax(axis=1) if k else np.zeros(len(p), int)
    hard = {s: held.get((s, None), 0) for s in sources}
    tokens = np.array([float(hard[s]) for s in sources] + [float(held.get((None, c), 0)) for c in range(len(shares))])
    plan = make_plan(asked, hard, tokens[k:] @ shares, sources, total)
    last = None
    for _ in range(MAX_STEPS if plan.mixes else 0):
        residual = (plan.rates(p, likeliest) * tokens[:, None]).T @ p - plan.target
        off = np.abs(residual).max(axis=1) / np.maximum(plan.target.sum(axis=1), 1.0)
        if off.max() < TOLERANCE or (last is not None and np.abs(last - off).max() < TOLERANCE):
            break
        last = off
        plan.steps.append(residual)
    rates = plan.rates(p, likeliest) if plan.mixes else np.zeros((len(p), 0))

    # A rate is whole copies and a chance of one more; a document gets it if its place, a
    # hash, lies below a bound. For cells that is the chance itself.
    whole = np.floor(rates + 1e-9)
    bound = np.where(whole < plan.cap[:, likeliest].T, np.clip(rates - whole, 0, 1), 0.0)
    every = [(i, j) for i in range(len(plan.mixes)) for j in range(len(p))]

    def with_rates(chosen: list[tuple[int, int]]) -> DataFrame:
        """The documents of these mixes and memberships, with their place; mixes x memberships rows are broadcast."""
        rows = [
            (plan.mixes[i], sources[j] if j < k else None, None if j < k else j - k, sources[likeliest[j]], int(whole[j, i]), float(bound[j, i]))
            for i, j in chosen
        ]
        table = spark.createDataFrame(rows, "mix_name string, _s string, _c int, named string, whole bigint, bound double")
        on = F.col("source").eqNullSafe(F.col("_s")) & F.col("cell").eqNullSafe(F.col("_c"))
        place = F.shiftrightunsigned(F.xxhash64("mix_name", "doc_id"), 11) / float(1 << 53)
        return members.join(F.broadcast(table), on).withColumn("place", place)

    def taken_of(rows: DataFrame) -> DataFrame:
        copies = F.col("whole") + F.when(F.col("place") < F.col("bound"), 1).otherwise(0)
        return rows.withColumn("copies", copies).where("copies > 0")

    # What the cells give is summed first; the labelled documents make up the rest of each target.
    soft = np.zeros((len(plan.mixes), k))
    if len(shares) and plan.mixes and tokens[k:].any():
        given = taken_of(with_rates([(i, j) for i, j in every if j >= k and rates[j, i] > 0]))
        for r in given.groupBy("mix_name", "cell").agg(F.sum(F.col("tokens") * F.col("copies")).alias("n")).collect():
            soft[plan.mixes.index(r["mix_name"])] += (r["n"] or 0) * shares[r["cell"]]
    part = [(i, j) for i, j in every if j < k and bound[j, i] > 0]
    if part:
        missing = plan.target - soft - (whole[:k] * tokens[:k, None]).T
        _bounds(lambda: with_rates(part), plan, sources, part, missing, bound)

    taken = taken_of(with_rates([(i, j) for i, j in every if rates[j, i] > 0]))
    taken = taken.select("mix_name", "doc_id", F.col("named").alias("source"), "tokens", "copies")
    goal = spark.createDataFrame(
        [
            (m, s, int(plan.cap[i, j]), float(plan.share[i, j]), float(plan.feasible[i, j]), int(hard[s]), float(plan.target[i, j]), float(soft[i, j]))
            for i, m in enumerate(plan.mixes) for j, s in enumerate(sources) if any(t["mix_name"] == m and t["source"] == s for t in asked)
        ],
        "mix_name string, source string, max_repeats int, target_share double, feasible_share double, tokens_held bigint, tokens_target double, _soft double",
    )
    named = with_rates([(i, j) for i, j in every if rates[j, i] > 0])
    by_source = taken_of(named).groupBy("mix_name", F.col("named").alias("source")).agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens_taken"),
        F.sum(F.when(F.col("cell").isNull(), F.col("tokens") * F.col("copies"))).alias("_own"),
        F.count(F.lit(1)).alias("docs_taken"), F.max("copies").alias("most_copies"),
    )
    by_mix = by_source.groupBy("mix_name").agg(F.sum("tokens_taken").alias("size"))
    told = goal.join(by_source, ["mix_name", "source"], "left").join(by_mix, "mix_name", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    share = lambda c: F.coalesce(c / F.nullif("size", F.lit(0)), F.lit(0.0))
    expected = share(F.coalesce("_own", F.lit(0)) + F.col("_soft")).alias("expected_share")
    return taken, told.select(
        *[c for c in goal.columns if c != "_soft"], zero("tokens_taken"), share(F.col("tokens_taken")).alias("actual_share"), expected, zero("docs_taken"), zero("most_copies")
    )


def _bounds(rows: Callable[[], DataFrame], plan: Plan, sources: list[str], part: list[tuple[int, int]], missing: np.ndarray, bound: np.ndarray) -> None:
    """Move the bounds of labelled documents (``part``: mix, source) to where the tokens taken come nearest to ``missing``.

    Tokens are summed by place in PLACES bins, then in PLACES bins of the one in which the sum is met; all places are below 1.
    """
    low, high = np.zeros(missing.shape), np.ones(missing.shape)
    left = missing.copy()
    for final in (False, True):
        span = rows().sparkSession.createDataFrame(
            [(plan.mixes[i], sources[j], float(low[i, j]), float(high[i, j])) for i, j in part], "mix_name string, _at string, lo double, hi double"
        )
        docs = rows()
        bin_ = F.least(F.floor((F.col("place") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PLACES), F.lit(PLACES - 1)).cast("int")
        sums = (
            docs.select("mix_name", F.col("_s").alias("_at"), "tokens", "place")
            .join(F.broadcast(span), ["mix_name", "_at"])
            .where("place >= lo and place < hi")
            .groupBy("mix_name", "_at", bin_.alias("bin"))
            .agg(F.sum("tokens").alias("n"))
        )
        got = np.zeros((*missing.shape, PLACES))
        for r in sums.collect():  # mixes x sources x PLACES rows at most
            got[plan.mixes.index(r["mix_name"]), sources.index(r["_at"]), r["bin"]] = r["n"]
        for i, j in part:
            upto, width = np.cumsum(got[i, j]), (high[i, j] - low[i, j]) / PLACES
            b = int(np.searchsorted(upto, left[i, j], side="right"))
            if b >= PLACES:  # all of them
                low[i, j] = high[i, j]
                continue
            before = upto[b - 1] if b else 0.0
            if final:  # to the nearer side of the bin
                b += bool(left[i, j] - before > upto[b] - left[i, j])
            low[i, j], high[i, j] = low[i, j] + b * width, low[i, j] + (b + 1) * width
            left[i, j] -= before
    for i, j in part:
        bound[j, i] = low[i, j]
