"""Views: operators on small collections, checked row by row."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ripplework import operators
from ripplework.plans.view import Cell, Link, View, register_operator
from ripplework.sources import array, objects


@pytest.fixture(scope="module")
def todos(spark):
    rows = {"10": (True, "a", 1.0, ("x", True)), "20": (False, "", 0.0, ("y", False)), "30": (True, None, float("nan"), None), "40": (None, "d", None, ("x", None))}
    data = [(k, *v, i) for i, (k, v) in enumerate(rows.items())]
    return View.over(spark.createDataFrame(data, "key string, completed boolean, task string, weight double, tags struct<name:string,hot:boolean>, at int"), "key", "at")


def keys(view, name="key"):
    return [r[name] for r in view]


def test_filters(todos):
    assert keys(todos.filter("completed")) == ["10", "30"]
    assert keys(todos.filter("task")) == ["10", "40"]
    assert keys(todos.filter("weight")) == ["10"]
    assert keys(todos.filter("tags")) == ["10", "20", "40"]
    assert keys(todos.filter("completed", False)) == ["20"]
    assert keys(todos.filter("completed", 1)) == [] and keys(todos.filter("weight", "1.0")) == []
    assert keys(todos.filter("task", None)) == ["30"]
    assert keys(todos.filter(["tags", "hot"])) == ["10"]
    assert keys(todos.filter(["tags", "name"], "x")) == ["10", "40"]
    assert keys(todos.filter({"completed": True, "tags": {"name": "x"}})) == ["10"]
    assert keys(todos.filter({"tags": {"hot": None}})) == ["30", "40"]
    assert keys(todos.filter(lambda r: r["key"] > "20")) == ["30", "40"]
    assert keys(todos.filter(F.col("weight") >= 0)) == ["10", "20", "30"]  # NaN is above all numbers in Spark
    with pytest.raises(TypeError):
        todos.filter("tags", object()).df  # noqa: B018


@pytest.fixture(scope="module")
def numbers(spark):
    return objects(spark, {"1": {"num": 90.0}, "2": {"num": 10.0}, "3": {"num": 50.0}, "4": {"num": None}, "5": {"num": float("nan")}}, "key string, num double")


def test_moving_bounds(numbers):
    low, high = Cell(20.0), Cell(80.0)
    view = numbers.between("num", [low, high])
    assert keys(view) == ["3"]
    for cell, value, want in [(low, 5.0, ["2", "3"]), (high, 6.0, []), (high, 100.0, ["1", "2", "3"]), (low, 99.0, []), (low, 90.0, ["1"]), (high, 90.0, ["1"]), (low, None, ["1", "2", "3"]), (high, None, ["1", "2", "3", "4", "5"])]:
        cell.set(value)
        assert keys(view) == want
    pair = Cell([50.0, 50.0])
    assert keys(numbers.between("num", pair)) == ["3"] and keys(numbers.between("num", pair, "empty")) == []


def test_ranks_and_limits(spark):
    day = datetime.datetime
    rows = array(spark, [{"n": x, "t": day(2024, 1, 1 + i % 3)} for i, x in enumerate([3, 1, None, 3, 2])], "n int, t timestamp_ntz")
    assert [(r["pos"], r["n"]) for r in rows.map({"n": F.col("n")}).za("n", 3)] == [(0, 3), (1, 3), (2, 2)]
    assert [r["n"] for r in rows.za("n")] == [3, 3, 2, 1, None]
    assert [r["n"] for r in rows.az("n")] == [1, 2, 3, 3, None]
    assert [r["t"].day for r in rows.za("t")] == [3, 2, 2, 1, 1]
    assert [r["value"] for r in rows.map({"value": F.col("n")}).top(2)] == [3, 3]
    assert [(r["pos"], r["n"]) for r in rows.limit(3, present="n")] == [(0, 3), (1, 1), (2, 3)]
    assert keys(rows.limit(0)) == []


def test_ranks_of_the_whole(spark):
    rng = random.Random(2)
    rows = [{"i": i, "n": rng.choice(["a", "a", "a", "b", "", None, "\u00e9"]), "x": rng.choice([float("nan"), 1.0, 1.0, -0.0, 0.0, None])} for i in range(300)]
    view = array(spark, rows, "i int, n string, x double")
    for col in ("n", "x"):
        none = [r["i"] for r in rows if r[col] is None or r[col] != r[col]]
        some = [r["i"] for r in rows if r["i"] not in none]
        for made, down in ((view.za(col), True), (view.az(col), False)):
            got = made.df.orderBy("pos").collect()
            assert [r["pos"] for r in got] == list(range(300))
            assert [r["i"] for r in got] == sorted(some, key=lambda i: rows[i][col], reverse=down) + none
    assert [r["pos"] for r in view.limit(5).za("n")] == [0, 1, 2, 3, 4]
    assert [r["pos"] for r in view.limit(5).za("n", 3)] == [0, 1, 2]


def test_folds_and_groups(spark, numbers):
    rows = objects(spark, {str(i + 1): {"num": x} for i, x in enumerate([1.1, 2.2, 1.9, 2.6, 1.7])}, "key string, num double")
    by = F.floor("num").cast("long")
    assert int(float(rows.length())) == 5 and str(numbers.length()) == "5"
    assert {r["bucket"]: r["value"] for r in rows.length(by)} == {1: 3, 2: 2}
    zeros = spark.createDataFrame([(1,), (9,)], "bucket long")
    assert {r["bucket"]: r["value"] for r in rows.length(by, keep_zero=zeros)} == {1: 3, 2: 2, 9: 0}
    assert {r["group"]: [x["key"] for x in r["rows"]] for r in rows.group(by, "array")} == {1: ["1", "3", "5"], 2: ["2", "4"]}
    assert {r["group"]: {k: v["num"] for k, v in r["rows"].items()} for r in rows.group(by, "object")} == {1: {"1": 1.1, "3": 1.9, "5": 1.7}, 2: {"2": 2.2, "4": 2.6}}
    assert [(r["group"], r["idx"], r["key"]) for r in rows.group(by)] == [(1, 0, "1"), (1, 1, "3"), (1, 2, "5"), (2, 0, "2"), (2, 1, "4")]
    assert float(rows.to(lambda df: df.agg(F.round(F.sum("num"), 1).alias("value")))) == 9.5


def test_map(spark, numbers):
    assert [r["x"] for r in numbers.map({"x": F.col("num") * 10}, drop_null=True)][:3] == [900.0, 100.0, 500.0]
    assert [(r["key"], r["value"]) for r in numbers.map(lambda r: None if r["num"] is None else str(r["num"]), "string")][:2] == [("1", "90.0"), ("2", "10.0")]
    assert [r["value"] for r in numbers.path("num", key="3")] == [50.0]


def test_intersections(spark):
    a = objects(spark, {"10": {"v": "a"}, "20": {"v": "b"}, "30": {"v": "c"}}, "key string, v string")
    b = objects(spark, {"10": {"v": "x"}, "20": {"v": "y"}, "99": {"v": "z"}}, "key string, v string")
    assert [(r["key"], r["v"]) for r in a.intersect(b)] == [("10", "a"), ("20", "b")]
    assert keys(a.intersect(a)) == ["10", "20", "30"] and keys(a.intersect(b, b.filter("v", "y"))) == ["20"]
    assert keys(operators.filter(a, "v", "c").intersect(operators.between(a, "v", ["b", "c"]))) == ["30"]


def test_fused_intersection_scans_once(spark):
    view = View.over(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), "event_id").check_keys()
    parts = view.between("value", [10, 60]), view.between("user_id", [5, 90]), view.filter("event_type", "click")
    fused, joined = parts[0].intersect(*parts[1:]), parts[0].intersect(*parts[1:], fuse=False)
    assert sorted(keys(fused, "event_id")) == sorted(keys(joined, "event_id"))
    plan = fused.df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "PushedFilters: [" in plan and "GreaterThanOrEqual(value" in plan
    with pytest.raises(ValueError, match="not a key"):
        View.over(view.df, "user_id").check_keys()


def test_links_and_registry(spark, numbers):
    link = Link(numbers.between("num", [0, 60]))
    view = link.za("num", 5)
    assert keys(view) == ["3", "2"]
    link.point(numbers.between("num", [60, 95]))
    assert keys(view) == ["1"]
    register_operator("evens", lambda v: v.filter(F.col("num") % 20 == 10))
    assert keys(numbers.evens()) == ["1", "2", "3"]
    with pytest.raises(AttributeError):
        numbers.odds()
