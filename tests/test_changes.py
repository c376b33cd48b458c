"""The change log, the delta feed and the runtime."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from ripplework.plans.view import Cell
from ripplework.streaming.changes import apply, diff, fold, mint, splice
from ripplework.streaming.runtime import Engine, debounce_stream, debounced, to_call, to_list, to_table, to_view

BASE = "key string, num double"
LOG = "seq long, type string, key string, value struct<num:double>"


def log(spark, *writes, start=0):
    return spark.createDataFrame([(start + i, t, k, None if v is ... else (v,)) for i, (t, k, v) in enumerate(writes)], LOG)


def state(df):
    return {r["key"]: r["num"] for r in df.collect()}


def test_fold(spark):
    base = spark.createDataFrame([("1", 1.0), ("2", 2.0), ("3", 3.0)], BASE)
    writes = [("update", "3", 4.0), ("remove", "1", ...), ("remove", "7", ...), ("insert", "8", 8.0), ("update", "9", None), ("patch", "2", 5.0), ("patch", "8", None), ("remove", "3", ...), ("update", "3", 6.0)]
    assert state(fold(base, log(spark, *writes))) == {"2": 5.0, "3": 6.0, "8": 8.0, "9": None}
    cleared = [("update", "1", 9.0), ("remove", None, ...), ("insert", "4", 4.0)]
    assert state(fold(base, log(spark, *cleared))) == {"4": 4.0}
    assert state(fold(base, log(spark).limit(0))) == {"1": 1.0, "2": 2.0, "3": 3.0}


def test_fold_agrees_with_one_write_after_another(spark):
    rng = random.Random(7)
    base = {str(k): float(k) for k in range(6)}
    df = spark.createDataFrame(list(base.items()), BASE)
    for _ in range(4):
        writes, want = [], dict(base)
        for _ in range(25):
            kind, k, v = rng.choice(["update", "insert", "remove", "patch", "remove-all"] if rng.random() < 0.3 else ["update", "remove", "patch"]), str(rng.randrange(9)), rng.choice([None, 1.0, 2.5])
            if kind == "remove-all":
                writes.append(("remove", None, ...))
                want = {}
            elif kind == "remove":
                writes.append(("remove", k, ...))
                want.pop(k, None)
            elif kind == "patch" and k not in want:
                continue
            else:
                writes.append((kind, k, v))
                want[k] = v if kind != "patch" else want[k] if v is None else v
        assert state(fold(df, log(spark, *writes))) == want


def test_diff(spark):
    a = spark.createDataFrame([("1", 1.0), ("2", None), ("3", 3.0)], BASE)
    b = spark.createDataFrame([("2", None), ("3", 4.0), ("5", 5.0)], BASE)
    got = sorted((r["type"], r["key"]["key"], r["value"]["num"]) for r in diff(a, b, ["key"]).collect())
    assert got == [("insert", "5", 5.0), ("remove", "1", 1.0), ("update", "3", 4.0)]
    assert diff(a, a, ["key"]).count() == 0
    assert state(apply(a, diff(a, b, ["key"]), ["key"])) == state(b)


def test_one_move_for_one_row(spark):
    rows = lambda *ks: spark.createDataFrame([(k, i) for i, k in enumerate(ks)], "key string, pos int")
    kinds = lambda a, b: sorted((r["type"], r["key"]["key"]) for r in diff(a, b, ["key"], "pos").collect())
    assert kinds(rows("4", "3", "2", "1"), rows("4", "3", "2")) == [("remove", "1")]
    assert kinds(rows("4", "3"), rows("9", "4", "3")) == [("insert", "9")]  # a shift is no move
    assert ("move", "1") in kinds(rows("4", "3", "2", "1"), rows("1", "4", "3", "2"))


def test_fewest_moves(spark):
    rng = random.Random(5)
    rows = lambda ks: spark.createDataFrame([(k, i) for i, k in enumerate(ks)], "key string, pos int")
    for before, after in [("4321", "1432"), ("4321", "3214"), ("abcd", "abcd"), *(("abcdefg", "".join(rng.sample("abcdefgxy", 7))) for _ in range(4))]:
        moved = [r["key"]["key"] for r in diff(rows(before), rows(after), ["key"], "pos", fewest=True).where("type = 'move'").collect()]
        old, new = [k for k in before if k in after], [k for k in after if k in before]
        least = min(len(c) for n in range(len(old) + 1) for c in itertools.combinations(old, n) if [k for k in old if k not in c] == [k for k in new if k not in c])
        assert len(moved) == least
        assert [k for k in old if k not in moved] == [k for k in new if k not in moved]


def test_minted_keys(spark):
    writes = log(spark, ("insert", None, 4.0), ("insert", None, 5.0), ("insert", "7", 7.0), ("remove", None, ...))
    got = [r["key"] for r in mint(writes).orderBy("seq").collect()]
    assert got[2:] == ["7", None] and len(set(got)) == 4 and got == [r["key"] for r in mint(writes).orderBy("seq").collect()]
    named = mint(writes.where("type = 'insert'"), make=lambda seq: F.concat(F.lit("k"), seq.cast("string")))
    assert len([k for k in state(fold(spark.createDataFrame([], BASE), named)) if k[0] == "k"]) == 2


def test_maps_compare(spark):
    df = lambda v: spark.createDataFrame([("1", {"a": v})], "key string, m map<string,int>")
    assert diff(df(1), df(1), ["key"]).count() == 0 and diff(df(1), df(2), ["key"]).first()["type"] == "update"


def test_engine_keeps_views_current(spark, tmp_path):
    rng = random.Random(3)
    base = spark.createDataFrame([(str(k), float(k * 7 % 50)) for k in range(12)], BASE)
    engine = Engine(spark, str(tmp_path), base)
    bounds, seen, called = Cell([10.0, 40.0]), [], []
    engine.register("mid", lambda v: v.between("num", bounds), to_list(seen), to_view("mid"))
    engine.register("top", lambda v: v.za("num", 4), to_call(called.append))
    engine.register("hist", lambda v: v.length((F.floor(F.col("num") / 10) * 10).cast("long")), to_table(f"{tmp_path}/hist"))
    copy = spark.createDataFrame([], BASE)
    done = 0
    for step in range(4):
        writes = [(rng.choice(["update", "insert", "remove"]), str(rng.randrange(16)), rng.choice([5.0, 15.0, 25.0, 45.0])) for _ in range(5)]
        engine.apply(log(spark, *writes, start=100 * step))
        if step == 2:
            bounds.set([0.0, 20.0])
            engine.refresh()
        delta = spark.createDataFrame([(r["type"], r["key"], r["value"]) for r in seen[done:]], "type string, key struct<key:string>, value struct<num:double>") if seen[done:] else None
        if delta is not None and step != 2:  # step 2 told two changes
            copy = spark.createDataFrame(apply(copy, delta, ["key"]).collect(), BASE)
        elif delta is not None:
            copy = spark.createDataFrame(engine.states["mid"].select("key", "num").collect(), BASE)
        done = len(seen)
        assert state(copy) == state(engine.states["mid"].select("key", "num")) == {k: v for k, v in state(engine.base()).items() if v is not None and bounds.value[0] <= v <= bounds.value[1]}
        assert [r["key"] for r in engine.states["top"].orderBy("pos").collect()] == [k for k, v in sorted(state(engine.base()).items(), key=lambda x: (-x[1], x[0]))][:4]
    assert spark.table("mid").count() == engine.states["mid"].count()
    count = len(seen)
    engine.apply(log(spark).limit(0))
    assert len(seen) == count and called
    engine.disconnect("top")
    assert "top" not in engine.states


def test_stream(spark, tmp_path):
    engine = Engine(spark, f"{tmp_path}/engine", spark.createDataFrame([("1", 1.0)], BASE))
    seen = []
    engine.register("all", lambda v: v, to_list(seen))
    log(spark, ("insert", "2", 2.0), ("update", "1", 3.0)).write.parquet(f"{tmp_path}/in")
    query = engine.start(spark.readStream.schema(LOG).parquet(f"{tmp_path}/in"), f"{tmp_path}/check", availableNow=True)
    query.awaitTermination(120)
    assert state(engine.base()) == {"1": 3.0, "2": 2.0}
    assert sorted(r["type"] for r in seen) == ["insert", "insert", "update"]


def test_debounce(spark):
    rows = [("a", t, v) for t, v in [(0, 1), (300, 2), (900, 3), (1500, 3), (2600, 4), (9000, 4)]]
    got = debounced(spark.createDataFrame(rows, "k string, at long, v long"), "k", "at", "v", 1000).orderBy("fired").collect()
    assert [(r["fired"], r["value"]) for r in got] == [(1000, 3), (3600, 4)]


def test_debounce_agrees_with_a_throttle(spark):
    rng = random.Random(11)
    rows = [(k, t, rng.choice([None, 1.0, 2.0])) for k in (None, 2**60 + 1, 3) for t in rng.sample(range(20_000), 60)]
    rows += [(9, t, 1.0) for t in range(0, 5000, 10)] + [(9, None, 7.0)]
    want = []
    for key in (None, 2**60 + 1, 3, 9):
        until, latest, last = None, None, object()
        for t, v in [*sorted((t, v) for k, t, v in rows if k == key and t is not None), (10**9, None)]:
            if until is not None and t > until:
                if latest != last:
                    want.append((key, until, latest))
                last, until = latest, None
            until, latest = t + 700 if until is None else until, v
    got = debounced(spark.createDataFrame(rows, "k long, at long, v double"), "k", "at", "v", 700).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_debounce_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1.0), ("a", 2.0)], "k string, v double").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = debounce_stream(spark.readStream.schema("k string, v double").parquet(f"{tmp_path}/in"), "k", "v", 500)
    query = stream.writeStream.format("memory").queryName("quiet").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        for _ in range(60):  # not processAllAvailable(): a query with timers never has nothing to do
            time.sleep(0.5)
            if spark.table("quiet").count():
                break
        assert [tuple(r) for r in spark.table("quiet").collect()] == [("a", 2.0)]
    finally:
        query.stop()


def _engine_log(spark, *rows):
    return spark.createDataFrame(rows, "seq long, type string, key string, value struct<v: int>")


def test_engine_goes_on_after_a_restart(spark, tmp_path):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    big, seen = (lambda view: view.filter(F.col("v") > 1)), []
    one = Engine(spark, str(tmp_path), base)
    one.register("big", big, to_list(seen))
    one.apply(_engine_log(spark, (0, "update", "a", (5,))), 0)
    two, later = Engine(spark, str(tmp_path)), []
    assert {tuple(r) for r in two.base().collect()} == {("a", 5), ("b", 2)} and two.batch == 0
    two.register("big", big, to_list(later))
    assert not later  # nothing has changed since the last commit
    two.apply(_engine_log(spark, (0, "update", "a", (5,))), 0)  # a batch that was committed before
    two.apply(_engine_log(spark, (1, "remove", "b", None)), 1)
    assert [(r["type"], r["key"]["key"]) for r in later] == [("remove", "b")]
    assert {tuple(r) for r in Engine(spark, str(tmp_path)).base().collect()} == {("a", 5)}


def test_a_failed_sink_loses_no_change(spark, tmp_path):
    base = spark.createDataFrame([("a", 1)], "key string, v int")
    seen, fails = [], [True]

    def flaky(batch, delta, state):
        if batch >= 0 and fails:
            fails.clear()
            raise OSError("the sink is away")
        seen.extend(delta.collect())

    engine = Engine(spark, str(tmp_path), base)
    engine.register("all", lambda view: view.filter(F.col("v") > 0), flaky)
    log = _engine_log(spark, (0, "insert", "b", (2,)))
    with pytest.raises(OSError):
        engine.apply(log, 0)
    assert engine.base().count() == 1
    engine.apply(log, 0)
    assert [(r["type"], r["key"]["key"]) for r in seen] == [("insert", "a"), ("insert", "b")] and engine.base().count() == 2


def test_patches_roots_and_splices(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "key string, v int, w string")
    log = lambda *rows: spark.createDataFrame(rows, "seq long, type string, key string, value struct<v: int, w: string>, fields array<string>")
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(fold(base, log((1, "remove", "a", (1, "x"), None), (2, "patch", "a", (7, None), None)))) == {("a", 7, None), ("b", 2, "y")}
    assert rows(fold(base, log((1, "patch", "a", (None, None), ["w"]), (2, "patch", "z", (3, None), ["v"])))) == {("a", 1, None), ("b", 2, "y"), ("z", 3, None)}
    assert rows(fold(base, log((1, "update", "b", (9, "q"), None), (2, "update", None, None, None), (2, "insert", "n", (4, "n"), None), (3, "patch", "n", (5, None), None)))) == {("n", 5, "n")}
    array = spark.createDataFrame([(0, 10), (1, 11), (2, 12)], "pos int, v int")
    writes = spark.createDataFrame([(1, "insert", 1, (5,)), (2, "remove", 2, None), (3, "insert", None, (6,)), (4, "remove", 9, None), (5, "update", 0, (1,))], "seq long, type string, at int, value struct<v: int>")
    assert sorted(rows(splice(array, writes))) == [(0, 1), (1, 5), (2, 12), (3, 6)]
    assert rows(splice(array.limit(0), writes)) == {(0, 1)}
