import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from braidwork.llm.encode import FOLDER, TreeEncoder, decode_ids, encode_texts

SMALL = TreeEncoder(leaf=7, window=2)
TRICKY = st.text(alphabet=list("abz 'srtvel d\n\t  　.,!?19é́日本語😀﻿"), max_size=120)


@settings(max_examples=1500, deadline=None)
@given(TRICKY)
def test_tree_equals_plain(text):
    assert SMALL.encode(text) == SMALL.plain.encode_ordinary(text)
    assert SMALL.decode(SMALL.encode(text)) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_unicode(text):
    assert SMALL.encode(text) == SMALL.plain.encode_ordinary(text)


def test_long_texts():
    tree = TreeEncoder(leaf=64)
    for text in ("x" * 5000, "a b " * 3000, " " * 3000 + "x", "we'll " * 2000, "日本" * 3000, "'" * 999 + "ll"):
        assert tree.encode(text) == tree.plain.encode_ordinary(text)


def test_whole_table_equals_other_library(spark, sf_dir):
    other = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["ids"] for r in encode_texts(docs).collect()}
    assert got == {d: other.encode(t or "", add_special_tokens=False).ids for d, t in texts.items()}


def test_null_empty_special_and_round_trip(spark):
    long = "word " * 4000 + "ünï 日本 <|endoftext|>"
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "<|endoftext|>", 0), (4, long, 0), (None, "a", 0)], "doc_id bigint, text string, ids int")
    ids = encode_texts(df)
    got = {r["doc_id"]: r["ids"] for r in ids.collect()}
    assert got[1] == [] and got[2] == [] and 50256 not in got[3] and len(got) == 5
    back = {r["doc_id"]: r["text"] for r in decode_ids(ids).collect()}
    assert back == {1: "", 2: "", 3: "<|endoftext|>", 4: long, None: "a"}
    assert encode_texts(df.limit(0)).count() == 0


def test_missing_vocabulary():
    with pytest.raises(OSError):
        TreeEncoder(folder="/nowhere")
