import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from braidwork.llm.repetition import count_repeated, jensen_shannon, language_divergence, repeated_words, repetitive, words_of


def brute(text):
    words, now = [], ""
    for ch in text + " ":
        if unicodedata.category(ch).startswith("L"):
            now += ch
        elif now:
            words.append(now.lower())
            now = ""
    marked = set()
    for i in range(len(words) - 4):
        if any(words[j : j + 5] == words[i : i + 5] for j in range(i)):
            marked |= set(range(i, i + 5))
    return len(words), len(marked)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "É", "日本", "x1y"]), max_size=60), st.sampled_from([" ", "-", "\n", "1"]))
def test_against_brute_force(words, gap):
    text = gap.join(words)
    found = words_of(text)
    assert (len(found), count_repeated(found)) == brute(text)


def test_table(spark):
    rows = [
        (1, "one two three four five " * 5, "en"),
        (2, "a b c d e f g h i j k l m n o p q r s t u", "EN "),
        (3, None, None),
        (4, "", "xx"),
        (5, "123 !!", "en"),
        (6, "same " * 30, "de"),
        (7, "w" * 100_000, "en"),
        (8, "Un deux trois quatre cinq. " * 3, "fr"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumnRenamed("lang", "share")
    got = {r["doc_id"]: (r["n_words"], r["n_repeated"], r["share"]) for r in repeated_words(df).collect()}
    assert got[1] == (25, 20, 0.8) and got[2] == (21, 0, 0.0) and got[6] == (30, 29, 29 / 30) and got[8][0] == 15
    assert got[3] == got[4] == got[5] == (0, 0, 0.0) and got[7] == (1, 0, 0.0)
    assert {r["doc_id"] for r in repetitive(repeated_words(df)).collect()} == {1, 6}
    assert repeated_words(df.limit(0)).count() == 0


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: (r["n_words"], r["n_repeated"]) for r in repeated_words(docs).collect()}
    assert got == {d: brute(t or "") for d, t in texts.items()}


def test_divergence(spark):
    rows = [(i, "the cat sat on the mat and the dog ran off to the big house by the old sea again", "en") for i in range(20)]
    rows += [(50, "XQZ " * 40, "en"), (51, "short", "en"), (52, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in language_divergence(df).collect()}
    assert got[50]["js_chars"] > got[0]["js_chars"] and got[50]["js_words"] > got[0]["js_words"]
    assert got[51]["js_chars"] is None and got[52]["n_words"] == 0
    assert language_divergence(df.limit(0)).count() == 0
    assert jensen_shannon([1, 0], [0, 1]) == 1 and jensen_shannon([2, 2], [1, 1]) == 0 and jensen_shannon([], [1]) == 0
