import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ripplework.llm.bpe import Words, encode_decode, vocabulary_path

TOKENIZER = Tokenizer.from_file(vocabulary_path())
WORDS = Words()
ODD = ["", " ", "  ", "a", "it's  we'll\n\n x", "<|endoftext|>", "a <|endoftext|>  b", "x<|endoftext|><|endoftext|>", "\x1c\x1d a\x85b 　c​", "Ünïcödé 漢字 ٣٤ 🙂🙂", "a" * 3000, "\t\n \r\n", "<|endoftext|", "é ﻿\x00z"]


def expected(text):
    ids = TOKENIZER.encode(text, add_special_tokens=False).ids
    return ids, TOKENIZER.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_words_encode_as_whole_texts(text):
    split = WORDS.split(text)
    assert "".join(split) == text
    assert [i for ids in WORDS.encode(split) for i in ids] == expected(text)[0]


def test_equal_rows_are_dealt(spark):
    """Equal blocks have names of their own: their rows aren't one task's work."""
    from ripplework.llm.bpe import _blocks
    from ripplework.llm.common import map_chunks

    df = spark.range(0, 4000, 1, 4).selectExpr("7L AS doc_id", "repeat('same words again ', 400) AS text")
    blocks = map_chunks(df, "block binary, doc_ids array<long>, sizes array<int>, numbers binary", _blocks("byte_bpe_50k.json", 1)[1], limit=1 << 20)
    assert blocks.select("block").distinct().count() == blocks.count() >= 8
    got = encode_decode(df).groupBy("doc_id", "n_tokens", "ids_sha256").count().collect()
    assert len(got) == 1 and got[0]["count"] == 4000


def test_documents(spark):
    texts = [*ODD, None, ODD[4], "extra words, it is " * 50]
    rows = [(i % 17 if i != 3 else None, t, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(3)
    got = sorted((str(r[0]), r[1], r[2], r[3]) for r in encode_decode(df).collect())
    want = []
    for doc_id, text, *_ in rows:
        ids, back = expected(text or "")
        want.append((str(doc_id), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want)


def test_outputs_and_round_trip(spark):
    df = spark.createDataFrame([(1, "one two  two"), (2, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in encode_decode(df, schema="doc_id long, ids array<int>, decoded string").collect()}
    assert got[1]["ids"] == expected("one two  two")[0] and got[1]["decoded"] == "one two  two"
    assert got[2]["ids"] == [] and got[2]["decoded"] == ""


def test_empty_table(spark):
    assert encode_decode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("text", ODD)
def test_pieces_join(text):
    pieces = WORDS.pieces()
    ids, back = expected(text)
    assert b"".join(pieces[i] for i in ids).decode("utf-8", "replace") == back
