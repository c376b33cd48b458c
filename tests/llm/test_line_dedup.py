import random
from collections import Counter, defaultdict

import numpy as np

from ripplework.llm import line_dedup
from ripplework.llm.line_dedup import CuckooFilter, LineIndex, dedup_lines

SPACE = " \t\n\v\f\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def naive(rows):
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(d)
    rank = lambda d: -1 if d is None else d
    gone = lambda d, x: len(held.get(key(x), ())) >= 3 and d != max(held[key(x)], key=rank)
    return Counter((d, len((t or "").split("\n")), sum(gone(d, x) for x in (t or "").split("\n")), "\n".join(x for x in (t or "").split("\n") if not gone(d, x))) for d, t in rows)


def corpus(n=60):
    rng = random.Random(2)
    lines = [f"A shared LINE of some length, number {k} é" for k in range(12)] + ["short", "", "  \t", "exactly twenty chars", "é" * 20, "é" * 19]
    rows = [(i % 50, "\n".join(rng.choice(["", "  "]) + rng.choice([str.upper, str])(rng.choice(lines)) if rng.random() < 0.6 else f"own {rng.random()}" for _ in range(rng.randint(0, 9)))) for i in range(n)]
    return rows + [rows[0], (None, lines[0]), (3, None), (4, ""), (None, lines[0] + "\n" + lines[0])]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, key string").repartition(3)


def got(df):
    return Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in df.collect())


def test_against_brute_force(spark, monkeypatch):
    rows = corpus()
    assert got(dedup_lines(frame(spark, rows))) == naive(rows)
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    assert got(dedup_lines(frame(spark, rows))) == naive(rows)
    assert dedup_lines(frame(spark, [])).count() == 0


def test_index_is_reversible(spark, tmp_path):
    rows = [r for r in corpus() if r[0] is not None]
    first, second = [r for r in rows if r[0] < 30], [r for r in rows if r[0] >= 30]
    index = LineIndex(spark, str(tmp_path), 4)
    index.insert(frame(spark, first))
    assert got(index.clean(frame(spark, first))) == naive(first)
    index.insert(frame(spark, second))
    assert got(index.clean(frame(spark, rows))) == naive(rows)
    assert index.clean(frame(spark, rows)).sparkSession is spark and got(LineIndex(spark, str(tmp_path)).clean(frame(spark, rows))) == naive(rows)  # opened again
    index.delete(frame(spark, second))
    assert got(index.clean(frame(spark, first))) == naive(first)
    held = Counter(k for d in {d for d, _ in first} for k in {key(x) for e, t in first if e == d for x in (t or "").split("\n") if len(key(x)) >= 20})
    assert all(index.maybe_dropped(k) for k, n in held.items() if n >= 3)


def test_queries_and_index_ask_the_filters(spark, tmp_path, monkeypatch):
    """Lines reach the exact counts through the filters alone: with filters that let nothing through, nothing goes."""
    rows = [(d, "the very same line for all of them\nand another one") for d in range(5)]
    docs = frame(spark, rows)
    index = LineIndex(spark, str(tmp_path), 2)
    index.insert(docs)
    dropped = lambda df: sum(r["n_dropped"] for r in df.collect())
    assert dropped(dedup_lines(docs)) == dropped(index.clean(docs)) == 4
    monkeypatch.setattr(line_dedup, "screened", lambda lines, *_: lines.limit(0))
    assert dropped(dedup_lines(docs)) == dropped(index.clean(docs)) == 0


def test_changes_touch_their_shards_alone(spark, tmp_path):
    index = LineIndex(spark, str(tmp_path), 32)
    index.insert(frame(spark, [(d, "\n".join(f"a line of some length, number {k}" for k in range(200))) for d in range(3)]))
    index.insert(frame(spark, [(9, "one line alone comes with this document")]))
    assert sorted(index.versions.values()).count(2) == 1 and len(index.versions) == 32
    assert index.filters().agg({"n_keys": "sum"}).first()[0] == 200


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    cuckoo = CuckooFilter(3000)
    for h in hashes.tolist():
        cuckoo.insert(h)
    cuckoo = CuckooFilter.from_bytes(cuckoo.to_bytes())
    assert cuckoo.contains(hashes).all()
    assert cuckoo.contains(rng.integers(0, 1 << 63, 20000, dtype=np.uint64)).mean() < 0.01
    assert all(cuckoo.delete(h) for h in hashes[:1500].tolist())
    assert cuckoo.contains(hashes[1500:]).all() and cuckoo.contains(hashes[:1500]).mean() < 0.02
