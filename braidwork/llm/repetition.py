"""Repetition inside single documents.

:func:`repeated_words` measures it exactly, document by document, from runs of successive
words that started earlier in the same text. :func:`language_divergence` is the cheaper
signal of distributions: how far a document's character classes and common words are from
those of its language. That distance can't tell a text that was written twice from one
written once, as both have the same histograms, so it only accompanies the exact measure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.llm.texts import strings
from braidwork.llm.topn import top_n_per_group

WORD = regex.compile(r"\p{L}+")
RUN = 5
MIN_WORDS = 20
MIN_SHARE = 0.3
COMMON_WORDS = 100
#: Character classes of the histograms, as Java patterns.
CLASSES = ["\\p{Lu}", "\\p{Ll}", "\\p{Lo}", "\\p{M}", "\\p{N}", "\\s", "[\\p{P}\\p{S}]"]


def words_of(text: str) -> list[str]:
    """The maximal runs of letters, each in lower case."""
    found = WORD.findall(text)
    return "\0".join(found).lower().split("\0") if found else []


def count_repeated(words: list[str], run: int = RUN) -> int:
    """How many words stand in ``run`` successive words that also start at an earlier word."""
    grams = list(zip(*[words[i:] for i in range(run)]))
    if len(set(grams)) == len(grams):
        return 0
    seen, marked, upto = set(), 0, 0
    for i, gram in enumerate(grams):
        if gram in seen:
            marked += i + run - max(i, upto)
            upto = i + run
        else:
            seen.add(gram)
    return marked


def repeated_words(df: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """``doc_id, n_words, n_repeated, share`` of every document.

    A word is repeated if it stands in ``run`` successive words which, in this order, also
    start at an earlier word of the same text. Null, empty and letterless texts have no
    words and the share 0. Whole texts are read; no row leaves its partition.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, repeated = [], []
            for t in strings(batch.column(1)):
                words = words_of(t) if t else []
                n.append(len(words))
                repeated.append(count_repeated(words, run) if len(words) > run else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(repeated, pa.int64())],
                ["doc_id", "n_words", "n_repeated"],
            )

    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.mapInArrow(measure, "doc_id bigint, n_words bigint, n_repeated bigint")
    share = F.when(F.col("n_words") > 0, F.col("n_repeated") / F.col("n_words")).otherwise(F.lit(0.0))
    return rows.withColumn("share", share)


def repetitive(measured: DataFrame, min_words: int = MIN_WORDS, tenths: int = 3) -> DataFrame:
    """The documents of :func:`repeated_words` with enough words and a large share repeated."""
    return measured.where((F.col("n_words") >= min_words) & (10 * F.col("n_repeated") >= tenths * F.col("n_words")))


def _language(lang: Column) -> Column:
    """The first two letters in lower case, or '--': a bounded set."""
    two = F.regexp_extract(F.lower(F.trim(lang)), "^([a-z]{2})", 1)
    return F.when(two != "", two).otherwise("--")


def language_divergence(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", min_words: int = MIN_WORDS
) -> DataFrame:
    """Jensen-Shannon distance (base 2, from 0 to 1) of a document from its language.

    References are counted over all documents of a language: shares of character classes,
    and of its COMMON_WORDS most frequent words with one place for all others. Documents of
    fewer than ``min_words`` words, null texts among them, have no distance (null).
    Returns ``doc_id, language, n_words, js_chars, js_words``.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    docs = df.select(F.col(doc_id).alias("doc_id"), _language(F.col(lang)).alias("language"), body.alias("body"))
    chars = F.array(*[F.regexp_count("body", F.lit(c)).cast("bigint") for c in CLASSES])
    words = F.regexp_extract_all(F.lower("body"), F.lit("\\p{L}+"), F.lit(0))
    docs = docs.select("doc_id", "language", chars.alias("chars"), words.alias("words"))

    char_sums = docs.groupBy("language").agg(
        *[F.sum(F.element_at("chars", i + 1)).alias(f"c{i}") for i in range(len(CLASSES))]
    )
    counted = docs.select("language", F.explode("words").alias("word")).groupBy("language", "word").count()
    word_sums = counted.groupBy("language").agg(F.sum("count").alias("n")).collect()
    common = top_n_per_group(counted, "language", [("count", "desc"), ("word", "asc")], COMMON_WORDS, repeated=False)
    # At most 26 * 26 + 1 languages, each with COMMON_WORDS words: a bounded reference.
    reference: dict[str, dict] = {r["language"]: {"chars": list(r)[1:]} for r in char_sums.collect()}
    for r in word_sums:
        reference[r["language"]] |= {"n": r["n"], "words": {}}
    for r in common.select("language", "word", "count").collect():
        reference[r["language"]]["words"][r["word"]] = r["count"]
    shared = df.sparkSession.sparkContext.broadcast(reference)

    def distance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for language, chars, words in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)]):
                ref = shared.value[language]
                if len(words) < min_words:
                    rows.append((len(words), None, None))
                    continue
                place = {w: i for i, w in enumerate(ref["words"])}
                own = np.bincount([place.get(w, len(place)) for w in words], minlength=len(place) + 1)
                theirs = list(ref["words"].values())
                rows.append((len(words), jensen_shannon(chars, ref["chars"]), jensen_shannon(own, [*theirs, ref["n"] - sum(theirs)])))
            n, c, w = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(c, pa.float64()), pa.array(w, pa.float64())],
                ["doc_id", "language", "n_words", "js_chars", "js_words"],
            )

    return docs.mapInArrow(distance, "doc_id bigint, language string, n_words bigint, js_chars double, js_words double")


def jensen_shannon(p, q) -> float:
    """Distance of two histograms; 0 if either is empty."""
    p, q = np.asarray(p, float), np.asarray(q, float)
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    kl = lambda a: float(np.sum(a[a > 0] * np.log2(a[a > 0] / m[a > 0])))
    return float(np.sqrt(max(0.0, (kl(p) + kl(q)) / 2)))
