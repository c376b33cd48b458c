import hashlib
import random

import numpy as np
import pytest

from ripplework.llm import spotsigs
from ripplework.llm.spotsigs import ANCHORS, compare, fingerprints, length_partition, likeness, near_duplicates, pruned_jaccard, signature_sets, signatures_of

MARKS = ".,;:!?()[]{}\"'|<>#*$%&=-_/\\"


def naive_set(text):
    """Signatures as tuples of words."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text if c not in MARKS).encode().split()
    out = set()
    for i, w in enumerate(low):
        rest = [x for x in low[i + 1 :] if x not in ANCHORS][:2]
        if w in ANCHORS and len(rest) == 2:
            out.add((w, *rest))
    if not out:
        out = {tuple(low[i : i + 3]) for i in range(len(low) - 2)}
    return out or ({tuple(low)} if low else set())


def naive(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (d, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = map(naive_set, (t, edited, after))
        near = lambda x, y: float(not x and not y) if not x or not y else len(x & y) / len(x | y)
        out.append((str(d), len(t), hashlib.sha256(edited.encode()).hexdigest(), len(a), len(b), round(near(a, b), 9), round(near(a, c), 9)))
    return sorted(out)


def run(spark, rows, parts=5):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, part long, guest string").repartition(parts)
    got = fingerprints(df).collect()
    return sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], len(r["fingerprint"]) // 12, len(r["edited_fingerprint"]) // 12, round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got)


def corpus():
    rng = random.Random(3)
    words = ["the", "of", "Und", "la", "is", *(f"w{i}é" for i in range(60))]
    text = lambda: " ".join(rng.choice(words) + rng.choice(["", ".", ","]) for _ in range(rng.randint(0, 80)))
    texts = [text() for _ in range(60)] + ["", None, "alone", "two words", "x y z", "...", "the of the", "🙂 the 🙂 a b"]
    return [(i * 7 % 61, t) for i, t in enumerate(texts)] + [(None, "no id the one two three"), (3, texts[0]), (3, texts[0])]


def test_against_words(spark):
    rows = corpus()
    assert run(spark, rows) == naive(rows)


def test_real_rows(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == naive(rows)


@pytest.mark.parametrize("rows", [[(1, "the one two three")], [(None, None)], [(5, "a"), (5, "a")]])
def test_few_rows(spark, rows):
    assert run(spark, rows, 2) == naive(rows)


def test_empty_table(spark):
    assert fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pruning_loses_nothing():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = np.unique(rng.integers(0, 400, rng.integers(0, 200)).astype(np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[: int(len(a) * rng.uniform(0.6, 1))], rng.integers(0, 400, rng.integers(0, 30)).astype(np.uint64)]))
        want = likeness(a, b)
        assert pruned_jaccard(a, b, step=8) == (want if want >= 0.75 else None)
        if want >= 0.75 and len(a):
            assert abs(length_partition(len(a)) - length_partition(len(b))) <= 1


def test_comparisons_are_partitioned_and_pruned(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 120)).astype(np.int64)) for _ in range(60)]
    sets += [np.unique(np.append(s[2:], 500)) for s in sets]
    find = spotsigs.spot_finder(sets, 600)
    for q, own in enumerate(sets):
        assert sorted(find(own)) == [k for k, s in enumerate(sets) if likeness(own, s) >= 0.75]
        assert compare(own, sets[(q + 60) % 120]) == likeness(own, sets[(q + 60) % 120])
    assert compare(sets[0], sets[60], 0.999) == 0
    monkeypatch.setattr(spotsigs, "pruned_jaccard", lambda *_: None)
    assert not any(find(s) for s in sets) and compare(sets[0], sets[60]) == 0


def test_fingerprints_read_back():
    sets = signature_sets(["the quick brown fox of the lazy dog is the one", ""])
    from ripplework.llm.spotsigs import fingerprint

    assert all((signatures_of(fingerprint(s)) == s).all() for s in sets)


def test_near_duplicates(spark):
    rows = [(i, t) for i, (d, t) in enumerate(corpus())]
    base = " ".join(["the alpha{0} beta{0} of gamma{0}".format(i) for i in range(40)])
    rows += [(500, base), (501, base + " the end here"), (502, base.replace("alpha3 ", "other "))]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[501] == got[502] == 500
    sets = [(d, naive_set(t or "")) for d, t in rows]
    alone = [d for d, s in sets if not any(e != d and s and u and len(s & u) >= 0.75 * len(s | u) for e, u in sets)]
    assert alone and all(got[d] == d for d in alone)
