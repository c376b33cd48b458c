from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from ripplework.llm.bpe import vocabulary_path
from ripplework.llm.quality_rules import judge_documents

from .test_pii import naive as naive_pii
from .test_shingle_join import naive as naive_join

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    clean = {r["doc_id"]: r["cleaned"] for r in judge_documents(docs).where("kept").collect()}
    kept = set(clean)
    now = P.materialize(P.quality(spark, docs, SF), "t1")
    assert {r["doc_id"]: r["text"] for r in now.collect()} == clean and now.columns == docs.columns
    assert clean != {k: rows[k]["text"] for k in kept}  # failed lines are gone

    # lines
    held = defaultdict(set)
    key = lambda x: x.strip(" \t\n\v\f\r").encode().lower().decode()
    for k in kept:
        for x in clean[k].split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(k)
    texts = {k: "\n".join(x for x in clean[k].split("\n") if len(held[key(x)]) < 3 or k == max(held[key(x)])) for k in kept}
    now = P.materialize(P.lines(spark, now, SF), "t2")
    got = now.collect()
    assert {r["doc_id"]: r["text"] for r in got} == texts and all(r["n_chars"] == len(r["text"]) for r in got)

    # near duplicates
    first = {d for d, _, c, _ in naive_join(list(texts.items())) if d == c}
    now = P.materialize(P.near_duplicates(spark, now, SF), "t3")
    assert {r["doc_id"]: r["text"] for r in now.collect()} == {k: texts[k] for k in first}

    # personal data: every base span is gone, texts without any are as they were
    now = P.materialize(P.personal_data(spark, now, SF), "t4")
    out = {r["doc_id"]: r["text"] for r in now.collect()}
    assert out.keys() == first
    for k, text in out.items():
        spans = naive_pii(texts[k])
        assert not naive_pii(text)
        assert spans or text == texts[k] or "[id]" in text
        if spans and "[id]" not in text:
            assert sum(text.count(f"[{kind}]") for kind, *_ in spans[:1]) >= 1

    # packing, over what run() makes of the whole
    tokenizer = Tokenizer.from_file(vocabulary_path())
    want = Counter()
    for k, text in out.items():
        want[k] = len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
    packed = P.run(spark, SF).collect()
    got = Counter()
    for r in packed:
        got[r["doc_id"]] += r["length"]
    assert got == want
    by = defaultdict(int)
    for r in packed:
        by[r["sequence_id"]] += r["length"]
    assert max(by.values()) <= 1024 and len(by) <= -(-sum(by.values()) // 1024) + 2
    assert np.mean(list(by.values())) > 900


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES])
def test_empty_table(spark, stage):
    docs = spark.createDataFrame([], spark.read.parquet(f"{SF}/documents.parquet").schema)
    assert stage(spark, docs, SF).count() == 0


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES])
def test_clashing_columns_and_a_very_long_text(spark, stage):
    """Extra columns under names that stages use themselves go no further; a long text is taken whole."""
    names = ("key", "id", "tid", "drop", "kept", "cleaned", "kept_text", "base", "spans", "more", "f_id", "n", "length", "shard", "rank")
    long = " ".join(f"word{k % 5003} and{k} so." for k in range(12_000))
    rows = [(1, long, "en", "s", 5, *names), (2, "a short text of ten words or more that stays as it is here", "en", "s", 1, *names)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    got = stage(spark, spark.createDataFrame(rows, schema), SF)
    if stage is P.packing:
        lengths = Counter()
        for r in got.collect():
            lengths[r["doc_id"]] += r["length"]
        assert lengths[1] == len(Tokenizer.from_file(vocabulary_path()).encode(long, add_special_tokens=False).ids) + 1
    else:
        assert got.columns == list(P.COLUMNS) and {r["doc_id"]: r["text"] for r in got.collect()} == {r[0]: r[1] for r in rows}


def test_repeated_rows_and_nulls(spark):
    base = " ".join(f"word{k} more{k}." for k in range(40))
    rows = [(1, base, "en", "s", 5), (1, base, "en", "s", 5), (1, None, None, None, None), (None, base + " end", "en", "s", 9), (2, "", "", "", 0), (3, base.replace("word7", "other"), "de", "t", 1)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    assert P.quality(spark, docs, SF).count() == 4
    assert P.lines(spark, docs, SF).count() == 6
    near = sorted(P.near_duplicates(spark, docs, SF).select("doc_id", "text").collect(), key=str)
    assert sorted(str(r["doc_id"]) + str(len(r["text"] or "")) for r in near) == sorted(["1" + str(len(base)), "10", "20"])
    assert P.personal_data(spark, docs, SF).count() == 6
    assert {r["doc_id"] for r in P.packing(spark, docs, SF).collect()} == {1, 2, 3, None}
