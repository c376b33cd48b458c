import random
from collections import Counter

import numpy as np
import pytest

from ripplework.llm import shingle_join
from ripplework.llm.components import components
from ripplework.llm.shingle_join import PrefixTree, shingle_components


def naive(rows):
    """Every pair, by words as they are."""
    sets = []
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        own = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
        sets.append((doc_id, own))
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * len(sets)
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[top(i)] = top(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, (d, _) in enumerate(sets):
        least[top(i)] = min((x for x in (least.get(top(i)), d) if x is not None), default=None)
    return Counter((d, len(s), least[top(i)], links[i]) for i, (d, s) in enumerate(sets))


def corpus(seed, n_families=6, members=14, hot=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = []
    for _ in range(n_families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 150]))]
        for _ in range(members):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                at = rng.randrange(len(words))
                words[at:at] = passage
            texts.append(" ".join(words))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(20)]
    texts += [" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(0, 9))]) for _ in range(hot)]
    texts += ["", None, "  \n ", "One  TWO three", "one two\tthree", "a b c d e", "A b c d e", "é É x"]
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, id int, home string").repartition(5)
    return Counter(tuple(r) for r in shingle_components(df).drop("text_hash").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == naive(rows)


def test_cells_frequent_shingles_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "CELL", 7)
    monkeypatch.setattr(shingle_join, "FREQUENT_ONE_IN", 20)
    monkeypatch.setattr(shingle_join, "BROADCAST_ROWS", 0)
    rows = corpus(3, n_families=3, members=25, hot=40)
    rows += rows[:9]
    rows += [(None, rows[0][1]), (None, "only here with no id at all"), (rows[4][0], "another text under the same id here")]
    assert run(spark, rows) == naive(rows)


def test_real_rows(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == naive(rows)


def test_empty_table(spark):
    assert shingle_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tree_prunes():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 3000, 40)) for _ in range(200)]
    sets += [np.unique(np.concatenate([sets[0][:-3], rng.integers(0, 3000, 3)])) for _ in range(20)]
    sets = [np.array(x) for x in {tuple(s.tolist()) for s in sets}]
    tree, room = PrefixTree(sets), np.zeros(3000, bool)
    for q in sets:
        got, _ = tree.linked(q, room)
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 75 * len(np.union1d(q, s))]
        assert sorted(got) == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(30)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    want = {(x, top(x)) for x in up if any(top(x) == top(y) and x != y for y in up)}
    assert {tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()} == want
