import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from ripplework.llm.bpe import vocabulary_path
from ripplework.llm import packing
from ripplework.llm.packing import pack, pack_documents, plan


def best_fit_decreasing(lengths, capacity):
    rooms = Counter()
    bins = 0
    for x in sorted(lengths, reverse=True):
        room = min((r for r, n in rooms.items() if n and r >= x), default=None)
        if room is None:
            bins, room = bins + 1, capacity
        else:
            rooms[room] -= 1
        rooms[room - x] += 1
    return bins


def checked(bins, histogram, capacity):
    used = Counter()
    for config, times in bins:
        assert times > 0 and sum(k * n for k, n in config.items()) <= capacity
        for k, n in config.items():
            used[k] += n * times
    assert used == Counter({k: v for k, v in histogram.items() if v})
    return sum(t for _, t in bins)


def test_plans_are_whole_and_tight():
    rng = random.Random(5)
    for case in range(40):
        capacity = rng.choice([10, 64, 1024])
        n = rng.choice([1, 5, 60, 3000])
        draw = rng.choice([lambda: rng.randint(1, capacity), lambda: min(capacity, 1 + int(rng.expovariate(8 / capacity))), lambda: rng.randint(capacity // 3, capacity // 2 + 1)])
        histogram = Counter(max(1, draw()) for _ in range(n))
        got = checked(plan(histogram, capacity), histogram, capacity)
        lengths = list(histogram.elements())
        assert got >= -(-sum(lengths) // capacity)
        assert got <= best_fit_decreasing(lengths, capacity) * 1.01 + 1, case
    assert plan({}) == []


def test_huge_counts_cost_nothing_more():
    histogram = {k: 10**10 + k for k in range(1, 1025)}
    got = checked(plan(histogram), histogram, 1024)
    assert got <= 1.001 * sum(k * v for k, v in histogram.items()) / 1024


def test_plans_come_from_groups_of_several_lengths(monkeypatch):
    """Every plan is made of rounded sizes, and rounding joins lengths; the result is near the floor all the same."""
    rng = random.Random(8)
    histogram = Counter(min(1024, 1 + int(rng.expovariate(1 / 400))) for _ in range(30_000))
    made = []
    real = packing._round_up
    monkeypatch.setattr(packing, "_round_up", lambda large, groups: made.append(real(large, groups)) or made[-1])
    got = checked(plan(histogram), histogram, 1024)
    assert len(made) == len(packing.GROUPS) and all(packing.GROUPS)
    for rounded in made:
        assert all(k <= top for k, top in rounded.items())
        assert sum(n > 1 for n in Counter(rounded.values()).values()) > 50  # groups of two lengths or more
    assert got <= 1.01 * sum(k * v for k, v in histogram.items()) / 1024


def test_documents(spark):
    tokenizer = Tokenizer.from_file(vocabulary_path())
    texts = ["", None, "one two", "word " * 1500, "x y z " * 900, "one two", "a" * 40, "tie"] * 3
    rows = [(i if i % 5 else 7, t, 1) for i, t in enumerate(texts)] + [(None, "no id", 2)]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3)).collect()
    want = Counter()
    for doc_id, text, _ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in got)
    assert len(by) <= -(-total // 1024) + 1


def test_hot_length_is_ranked_in_shards(spark):
    df = spark.range(1000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "CAST(CASE WHEN id % 3 = 0 THEN 600 ELSE 100 + id % 50 END AS long) AS length", "0L AS ids_crc32")
    got = pack(df).collect()
    assert len(got) == 1000 and len({(r["sequence_id"], r["offset"]) for r in got}) == 1000


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
