import hashlib
import random
from collections import Counter

import pytest

from ripplework.llm import repeats
from ripplework.llm.repeats import remove_repeats


def naive(rows, window):
    raws = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(r[k : k + window] for _, r in raws for k in range(len(r) - window + 1))
    out = Counter()
    for d, r in raws:
        gone = bytearray(len(r))
        for k in range(len(r) - window + 1):
            if seen[r[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        rest = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[d, len(r), sum(gone), spans, hashlib.sha256(rest).hexdigest()] += 1
    return out


def run(spark, rows, **how):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, tid int").repartition(4)
    return Counter(tuple(r) for r in remove_repeats(df, **how).drop("starts", "ends", "kept").collect())


def corpus(seed, window):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 9)))
    text = lambda n: "".join(word() for _ in range(n))
    passages = [text(rng.randint(window // 8, window)) for _ in range(6)]
    texts = [text(rng.randint(0, 20)) + "".join(rng.choice(passages)[rng.randint(0, 9) :] + text(rng.randint(0, 12)) for _ in range(rng.randint(0, 4))) for _ in range(40)]
    texts += [texts[0], texts[0], texts[1][:-3] + "x", "a" * (3 * window), "ab" * window + "c", "a" * window, "a" * (window - 1), "é" * window, "", None, "short", "short"]
    rng.shuffle(texts)
    return [(i if i % 9 else 5, t) for i, t in enumerate(texts)] + [(None, texts[3])]


@pytest.mark.parametrize(("seed", "window", "gram"), [(1, 40, 20), (2, 30, 5), (3, 200, 100)])
def test_against_every_window(spark, seed, window, gram):
    rows = corpus(seed, window)
    assert run(spark, rows, window=window, gram=gram) == naive(rows, window)


def test_segments_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 50)
    rows = corpus(4, 40)
    assert run(spark, rows, window=40, gram=10) == naive(rows, 40)


@pytest.mark.parametrize("seed", [5, 6])
def test_runs_left_to_the_last_pass(spark, monkeypatch, seed):
    for name, value in (("ONE_DIGIT", 2), ("BLOCK_ROWS", 60), ("BLOCK_BYTES", 3000), ("BUCKET_BYTES", 4000), ("SEGMENT", 150)):
        monkeypatch.setattr(repeats, name, value)
    rows = corpus(seed, 40)
    assert run(spark, rows, window=40, gram=20) == naive(rows, 40)


def dealt(spark, monkeypatch, texts):
    """Bytes of first digits in each bucket of each pass, for texts that come in one input split; and what is wrong in the result."""
    passes, plain = [], repeats.map_chunks

    def noted(df, schema, *args, **how):
        out = plain(df, schema, *args, **how)
        if schema.startswith("bucket"):
            passes.append(out)
        return out

    monkeypatch.setattr(repeats, "map_chunks", noted)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = Counter(tuple(r) for r in remove_repeats(df).drop("starts", "ends", "kept").collect())
    sizes = []
    for made in passes:
        sizes.append(Counter())
        for r in made.select("bucket", "one").collect():
            sizes[-1][r[0]] += len(r[1])
    return sizes, got - naive(rows, 200)


def noise(rng, n):
    return "".join(rng.choices("abcdefgh ", k=n))


def test_buckets_grow_in_number_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 20_000, raising=False)
    rng = random.Random(7)
    sizes, wrong = dealt(spark, monkeypatch, [noise(rng, 2000) for _ in range(600)])
    assert not wrong
    assert sum(sizes[0].values()) > 100_000
    assert max(sizes[0].values()) < 8_000  # 8 of a row's 40 bytes are counted: twice what 20,000 would make


def test_a_passage_in_every_document_is_not_one_buckets_work(spark, monkeypatch):
    monkeypatch.setattr(repeats, "MIN_BUCKETS", 400)
    rng = random.Random(8)
    passage = noise(rng, 300)
    sizes, wrong = dealt(spark, monkeypatch, [noise(rng, 150) + passage + noise(rng, 150) for _ in range(400)])
    assert not wrong
    assert max(sizes[0].values()) < 8 * 100


def test_real_rows(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == naive(rows, 200)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
