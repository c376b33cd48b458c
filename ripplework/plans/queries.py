"""Named queries over the views, with the SQL that says the same."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import bucket, clamp, day, day_label, hour_of, month_day_time, number, spread
from ..sources import table
from ..streaming.changes import diff, fold, mint, splice
from ..streaming.runtime import debounced
from .view import Cell, Link, View

VALUE, USER, DAYS = [50, 300], [2, 120], [19724, 19747]
E_COLS = ["event_id", "event_type", "value", "user_id"]


def events(spark: SparkSession, sf: str) -> View:
    return table(spark, f"{sf}/events.parquet", "event_id")


def orders(spark: SparkSession, sf: str) -> View:
    return table(spark, f"{sf}/orders.parquet", "o_orderkey")


def _typed(spark: SparkSession, sf: str) -> View:
    """events with the JSON in props parsed, and a flag."""
    return events(spark, sf).map({"event_type": F.col("event_type"), "value": F.col("value"), "user_id": F.col("user_id"), "flag": F.col("user_id") % 2 == 0, "props": F.from_json("props", "k long")})


def _flights(spark: SparkSession, sf: str) -> View:
    """The crossfilter's rows: time of day, clamped value, day and its number."""
    return events(spark, sf).map({"ts": F.col("ts"), "time": hour_of(F.col("ts")), "value": clamp(F.col("value"), 5, 450), "user_id": F.col("user_id"), "date": day(F.col("ts")), "day": F.unix_date(F.to_date("ts")), "event_type": F.col("event_type")})


def _crossfilter(spark: SparkSession, sf: str) -> tuple[View, dict[str, View]]:
    rows = _flights(spark, sf)
    ranges = {"time": [6, 20], "value": VALUE, "user_id": USER, "day": DAYS}
    return rows, {k: rows.between(k, Cell(v)) for k, v in ranges.items()}


def _active(spark: SparkSession, sf: str, without: str | None = None) -> View:
    rows, parts = _crossfilter(spark, sf)
    return rows.intersect(*(v for k, v in parts.items() if k != without))


def _chart(dim: str, width: float):
    return lambda s, d: _active(s, d, dim).length(bucket(F.col(dim), width)).df


def _charts(s: SparkSession, d: str) -> DataFrame:
    """All four charts by one scan: each row counts in the charts whose other three ranges hold it."""
    rows = _flights(s, d).df
    holds = {"time": F.col("time").between(6, 20), "value": F.col("value").between(*VALUE), "user_id": F.col("user_id").between(*USER), "day": F.col("day").between(*DAYS)}
    buckets = {"time": bucket(F.col("time"), 1), "value": bucket(F.col("value"), 10), "user_id": bucket(F.col("user_id"), 50), "day": F.col("day").cast("long")}
    marks = []
    for dim, of in buckets.items():
        others = F.lit(True)
        for k, held in holds.items():
            others = others & held if k != dim else others
        marks.append(F.when(others, F.struct(F.lit(dim).alias("dim"), of.alias("bucket"))))
    return rows.select(F.explode(F.array_compact(F.array(*marks))).alias("x")).where("x.bucket IS NOT NULL").groupBy("x.dim", "x.bucket").agg(F.count(F.lit(1)).alias("value"))


def _small_log(s: SparkSession, d: str, writes: str) -> DataFrame:
    """fold() of events (value, user_id) after log rows made by SQL from the table e."""
    e = events(s, d).df.select("event_id", "value", "user_id")
    e.createOrReplaceTempView("ripplework_events")
    return fold(e, s.sql(writes.replace("FROM e", "FROM ripplework_events")), "event_id")


def _nested(s: SparkSession, d: str) -> DataFrame:
    """Patches that set a field inside a struct, and one to null."""
    e = events(s, d).df.select("event_id", F.struct("value", F.struct("user_id", "event_type").alias("who")).alias("row"))
    none = lambda k: F.lit(None).cast(k)
    value = F.struct(F.struct(none("double").alias("value"), F.struct(F.lit(-5).cast("long").alias("user_id"), none("string").alias("event_type")).alias("who")).alias("row"))
    log = e.where("event_id % 4 = 0").select((F.col("event_id") + 1).alias("seq"), F.lit("patch").alias("type"), "event_id", value.alias("value"), F.array(F.lit("row.value"), F.lit("row.who.user_id")).alias("fields"))
    return fold(e, log, "event_id").select("event_id", "row.value", "row.who.user_id", "row.who.event_type")


def _spliced(s: SparkSession, d: str) -> DataFrame:
    """An array after an insert at 2, a removal at 0, an update at 3 and an insert at the end."""
    base = orders(s, d).az("o_orderkey", 1000).df.select("pos", "o_orderkey")
    log = s.createDataFrame([(1, "insert", 2, (-1,)), (2, "remove", 0, None), (3, "update", 3, (-2,)), (4, "insert", None, (-3,)), (5, "remove", 5000, None)], "seq long, type string, at int, value struct<o_orderkey: long>")
    return splice(base, log).select(F.col("pos").cast("long").alias("pos"), "o_orderkey")


def _scalars(s: SparkSession, d: str) -> DataFrame:
    text = F.date_format("ts", "MMddHHmm")
    made = {
        "parsed": number(F.concat(F.col("user_id").cast("string"), F.lit(".5"))),
        "none": number(F.col("event_type")),
        "at": month_day_time(text, 2001),
        "label": day_label(F.col("ts")),
        "spread": spread(F.col("value"), F.col("user_id")),
        "kind": F.substring("event_type", 1, 3),
        "shown": F.concat(F.lit("#"), F.when(F.col("value") > 100, F.lit("high")).otherwise(F.lit("low"))),
    }
    return events(s, d).map(made).df


def _keep_zero(s: SparkSession, d: str) -> DataFrame:
    """Counts of the rows in range, with every bucket of the whole."""
    every = events(s, d).length(bucket(F.col("value"), 10)).df
    return events(s, d).between("value", [100, 140]).length(bucket(F.col("value"), 10), keep_zero=every).df


def _log(s: SparkSession, d: str) -> DataFrame:
    """A change log from events: every seventh row is removed, every fifth updated, each third patched, and new rows come."""
    e = events(s, d).df
    row = lambda v, u: F.struct(v.alias("value"), u.alias("user_id"))
    none = F.lit(None).cast("double"), F.lit(None).cast("long")
    up = e.where("event_id % 5 = 0").select(F.col("event_id").alias("seq"), F.lit("update").alias("type"), "event_id", row(F.col("value") * 2, F.col("user_id")).alias("v"))
    rm = e.where("event_id % 7 = 0").select((F.col("event_id") + 1_000_000_000).alias("seq"), F.lit("remove").alias("type"), "event_id", row(*none).alias("v"))
    patch = e.where("event_id % 3 = 0").select((F.col("event_id") + 500_000_000).alias("seq"), F.lit("patch").alias("type"), "event_id", row(none[0], F.lit(-1).cast("long")).alias("v"))
    new = e.where("event_id % 100 = 1").select((F.col("event_id") + 2_000_000_000).alias("seq"), F.lit("insert").alias("type"), (-F.col("event_id")).alias("event_id"), row(F.col("value"), F.col("user_id")).alias("v"))
    return up.unionByName(rm).unionByName(patch).unionByName(new).withColumnRenamed("v", "value")


def _bounds_delta(s: SparkSession, d: str) -> DataFrame:
    bounds = Cell([10, 60])
    view = events(s, d).between("value", bounds)
    before = view.df
    bounds.set([20, 80])
    return diff(before, view.df, ["event_id"]).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("key.event_id").cast("long").alias("ids"))


def _topn_moves(s: SparkSession, d: str) -> DataFrame:
    rows = events(s, d)
    first = rows.za("value", 50)
    later = rows.map({"value": F.when(F.col("event_id") % 4 == 0, F.col("value") * 0.99).otherwise(F.col("value"))}).za("value", 50)
    pick = lambda v: v.df.select("event_id", "value", "pos")
    return diff(pick(first), pick(later), ["event_id"], "pos").select("type", F.col("key.event_id").alias("event_id"), F.col("from").alias("from_pos"), F.col("to").alias("to_pos"))


def _single_move(s: SparkSession, d: str) -> DataFrame:
    """The first of fifty rows goes to the end: one move, though all ranks change."""
    first = events(s, d).za("value", 50).df.select("event_id", "value", "pos")
    later = first.withColumn("pos", F.pmod(F.col("pos") - 1, F.lit(50)))
    return diff(first, later, ["event_id"], "pos", fewest=True).select("type", F.col("key.event_id").alias("event_id"), F.col("from").alias("from_pos"), F.col("to").alias("to_pos"))


def _minted(s: SparkSession, d: str) -> DataFrame:
    """Inserts without a key get one that is made from their seq."""
    e = events(s, d).df.select("event_id", "value", "user_id")
    log = e.where("event_id % 50 = 0").select(F.col("event_id").alias("seq"), F.lit("insert").alias("type"), F.lit(None).cast("long").alias("event_id"), F.struct("value", F.lit(-3).cast("long").alias("user_id")).alias("value"))
    return fold(e, mint(log, "event_id", lambda seq: -1 - seq), "event_id")


def _linked(s: SparkSession, d: str) -> DataFrame:
    link = Link(events(s, d).between("value", [0, 100]))
    counted = link.length(F.col("event_type"))
    link.point(events(s, d).between("value", [100, 200]))
    return counted.df


def _to_share(df: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return df.agg(F.count_if(F.col("event_type") == "click").alias("clicks"), n.alias("rows"), F.round(100.0 * F.count_if(F.col("event_type") == "click") / n, 4).alias("share"))


def _list(s: SparkSession, d: str) -> DataFrame:
    """The first 40 active rows, newest first, by day."""
    rows, parts = _crossfilter(s, d)
    newest = rows.intersect(*parts.values()).za("ts", 40)
    return newest.group(F.col("date")).df.select("group", "idx", "event_id", "pos")


QUERIES = {
    "filter_fn": lambda s, d: events(s, d).filter(F.col("value") > 2 * F.col("user_id")).df.select(*E_COLS),
    "filter_key_truthy": lambda s, d: _typed(s, d).filter("flag").df.select(*E_COLS),
    "filter_key_eq": lambda s, d: events(s, d).filter("event_type", "click").df.select(*E_COLS),
    "filter_path_truthy": lambda s, d: _typed(s, d).filter(["props", "k"]).df.select(*E_COLS),
    "filter_path_eq": lambda s, d: _typed(s, d).filter(["props", "k"], 42).df.select(*E_COLS),
    "filter_shape": lambda s, d: _typed(s, d).filter({"event_type": "view", "props": {"k": 7}}).df.select(*E_COLS),
    "between_closed": lambda s, d: events(s, d).between("value", VALUE).df.select(*E_COLS),
    "between_open": lambda s, d: events(s, d).between("value", [None, 40.5]).df.select(*E_COLS),
    "between_swapped": lambda s, d: events(s, d).between("value", [60, 10]).df.select(*E_COLS),
    "between_reactive": lambda s, d: events(s, d).between("value", [Cell(30), Cell(70)]).df.select(*E_COLS),
    "map_project": lambda s, d: events(s, d).map({"scaled": F.col("value") * 10, "day": day(F.col("ts"))}).df,
    "map_drop_null": lambda s, d: events(s, d).map({"high": F.when(F.col("value") > 400, F.col("value"))}, drop_null=True).df,
    "length_scalar": lambda s, d: events(s, d).between("value", VALUE).length().df,
    "length_bucket": lambda s, d: events(s, d).length(bucket(F.col("value"), 10)).df,
    "za_col_n": lambda s, d: events(s, d).za("value", 25).df.select("pos", "event_id", "value"),
    "za_col_all": lambda s, d: events(s, d).za("value").df.select("pos", "event_id", "value"),
    "za_scalar_n": lambda s, d: events(s, d).map({"value": F.col("value")}).za(20).df,
    "az_col_n": lambda s, d: events(s, d).az("value", 25).df.select("pos", "event_id", "value"),
    "top_n": lambda s, d: events(s, d).map({"value": F.col("value")}).top(15).df,
    "limit_source_order": lambda s, d: events(s, d).between("value", VALUE).limit(30).df.select("pos", "event_id"),
    "intersect_fused": lambda s, d: (lambda e: e.between("value", VALUE).intersect(e.between("user_id", USER), e.filter("event_type", "click")).df.select(*E_COLS))(events(s, d)),
    "intersect_semi": lambda s, d: (lambda e: e.between("value", VALUE).intersect(e.between("user_id", USER), e.filter("event_type", "click"), fuse=False).df.select(*E_COLS))(events(s, d)),
    "group_flat": lambda s, d: orders(s, d).group(F.col("o_orderpriority")).df.select("group", "idx", "o_orderkey"),
    "group_array": lambda s, d: orders(s, d).group(F.col("o_orderstatus"), "array").df.select("group", F.size("rows").cast("long").alias("n"), F.md5(F.array_join(F.transform("rows", lambda r: r["o_orderkey"].cast("string")), ",")).alias("keys_md5")),
    "group_object": lambda s, d: orders(s, d).group(F.col("o_orderstatus"), "object").df.select("group", F.size("rows").cast("long").alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.map_keys("rows")), lambda k: k.cast("string")), ",")).alias("keys_md5")),
    "group_limit": lambda s, d: orders(s, d).limit(50).group(F.col("o_orderpriority")).df.select("group", "idx", "o_orderkey", "pos"),
    "path_value": lambda s, d: _typed(s, d).path("props", "k").df,
    "path_of_row": lambda s, d: _typed(s, d).path("event_type", key=17).df,
    "to_sum": lambda s, d: orders(s, d).to(lambda df: df.agg(F.round(F.sum("o_totalprice"), 2).alias("total"))).df,
    "to_share": lambda s, d: events(s, d).to(_to_share).df,
    "to_all_match": lambda s, d: orders(s, d).to(lambda df: df.agg(F.every(F.col("o_totalprice") > 0).alias("all_positive"), F.every(F.col("o_orderstatus") == "F").alias("all_done"))).df,
    "to_max_bucket": lambda s, d: events(s, d).length(bucket(F.col("value"), 10)).za("value", 1).df,
    "linked_view_swap": _linked,
    "xf_active": lambda s, d: _active(s, d).df.select("event_id", "time", "value", "user_id"),
    "xf_chart_time": _chart("time", 1),
    "xf_chart_value": _chart("value", 10),
    "xf_chart_user": _chart("user_id", 50),
    "xf_chart_date": lambda s, d: _active(s, d, "day").length(F.col("date")).df,
    "xf_list": _list,
    "xf_charts": _charts,
    "filter_python_fn": lambda s, d: events(s, d).filter(lambda r: r.value > 2 * r.user_id, columns=["value", "user_id"]).df.select(*E_COLS),
    "map_python_fn": lambda s, d: events(s, d).map(lambda r: r.value * 2 if r.user_id % 2 else None, "double", columns=["value", "user_id"]).df,
    "path_of_composite_key": lambda s, d: table(s, f"{d}/conversations.parquet", ["conv_id", "turn"]).path("role", key=(3, 1)).df,
    "dense_filter": lambda s, d: events(s, d).filter("event_type", "click").az("event_id").df.select("pos", "event_id"),
    "length_keep_zero": _keep_zero,
    "scalars": _scalars,
    "iterated": lambda s, d: s.createDataFrame([(r["event_id"],) for r in itertools.islice(iter(events(s, d).az("value", 5)), 5)], "event_id long"),
    "coerced": lambda s, d: s.createDataFrame([(str(events(s, d).length()), float(events(s, d).length()))], "shown string, number double"),
    "changelog_patch_after_remove": lambda s, d: _small_log(s, d, "SELECT event_id + 10 AS seq, 'remove' AS type, event_id, struct(value, user_id) AS value FROM e WHERE event_id % 3 = 0 UNION ALL SELECT event_id + 1000000000, 'patch', event_id, struct(CAST(NULL AS double), -7L) FROM e WHERE event_id % 6 = 0"),
    "changelog_root_update": lambda s, d: _small_log(s, d, "SELECT DISTINCT 50L AS seq, 'update' AS type, CAST(NULL AS long) AS event_id, CAST(NULL AS struct<value: double, user_id: long>) AS value FROM e UNION ALL SELECT 50L, 'insert', event_id, struct(value + 1, user_id) FROM e WHERE event_id % 10 = 0 UNION ALL SELECT 40L, 'update', event_id, struct(0D, 0L) FROM e"),
    "changelog_nested_null": _nested,
    "array_splice": _spliced,
    "changelog_fold": lambda s, d: fold(events(s, d).df.select("event_id", "value", "user_id"), _log(s, d), "event_id"),
    "diff_between_bounds": _bounds_delta,
    "diff_topn_moves": _topn_moves,
    "diff_single_move": _single_move,
    "changelog_minted": _minted,
    "az_text_all": lambda s, d: events(s, d).az("event_type").df.select("event_id", "event_type", "pos"),
    "za_text_all": lambda s, d: events(s, d).za("event_type").df.select("event_id", "event_type", "pos"),
    "debounce_latest": lambda s, d: debounced(events(s, d).df, "user_id", "ts", "value", 3_600_000),
}

_CHART = lambda dim, of: f"SELECT '{dim}' AS dim, ({of})::BIGINT AS bucket, count(*) AS value FROM ({_F}) WHERE {_X(dim)} GROUP BY ALL"
_E = "SELECT event_id, event_type, value, user_id FROM events WHERE "
_K = "json_extract_string(props, '$.k')::BIGINT"
_F = "SELECT event_id, ts, hour(ts) + minute(ts) / 60.0::DOUBLE AS time, greatest(5, least(450, value)) AS value, user_id, date_trunc('day', ts)::TIMESTAMP AS date, date_diff('day', DATE '1970-01-01', ts::DATE) AS day FROM events"
_ON = {"time": "time BETWEEN 6 AND 20", "value": "value BETWEEN 50 AND 300", "user_id": "user_id BETWEEN 2 AND 120", "day": "day BETWEEN 19724 AND 19747"}
_X = lambda without="": " AND ".join(v for k, v in _ON.items() if k != without)
_HIST = lambda dim, width: f"SELECT (floor({dim} / {width}) * {width})::BIGINT AS bucket, count(*) AS value FROM ({_F}) WHERE {_X(dim)} GROUP BY 1"

ORACLE = {
    "filter_fn": _E + "value > 2 * user_id",
    "filter_key_truthy": _E + "user_id % 2 = 0",
    "filter_key_eq": _E + "event_type = 'click'",
    "filter_path_truthy": _E + f"{_K} <> 0",
    "filter_path_eq": _E + f"{_K} = 42",
    "filter_shape": _E + f"event_type = 'view' AND {_K} = 7",
    "between_closed": _E + "value BETWEEN 50 AND 300",
    "between_open": _E + "value <= 40.5",
    "between_swapped": _E + "value BETWEEN 10 AND 60",
    "between_reactive": _E + "value BETWEEN 30 AND 70",
    "map_project": "SELECT event_id, value * 10 AS scaled, date_trunc('day', ts)::TIMESTAMP AS day FROM events",
    "map_drop_null": "SELECT event_id, value AS high FROM events WHERE value > 400",
    "length_scalar": "SELECT count(*) AS value FROM events WHERE value BETWEEN 50 AND 300",
    "length_bucket": "SELECT (floor(value / 10) * 10)::BIGINT AS bucket, count(*) AS value FROM events GROUP BY 1",
    "za_col_n": "SELECT row_number() OVER (ORDER BY value DESC NULLS LAST, event_id) - 1 AS pos, event_id, value FROM events QUALIFY pos < 25",
    "za_col_all": "SELECT row_number() OVER (ORDER BY value DESC NULLS LAST, event_id) - 1 AS pos, event_id, value FROM events",
    "za_scalar_n": "SELECT event_id, value, row_number() OVER (ORDER BY value DESC NULLS LAST, event_id) - 1 AS pos FROM events QUALIFY pos < 20",
    "az_col_n": "SELECT row_number() OVER (ORDER BY value ASC NULLS LAST, event_id) - 1 AS pos, event_id, value FROM events QUALIFY pos < 25",
    "top_n": "SELECT event_id, value, row_number() OVER (ORDER BY value DESC NULLS LAST, event_id) - 1 AS pos FROM events QUALIFY pos < 15",
    "limit_source_order": "SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, event_id FROM events WHERE value BETWEEN 50 AND 300 QUALIFY pos < 30",
    "intersect_fused": _E + "value BETWEEN 50 AND 300 AND user_id BETWEEN 2 AND 120 AND event_type = 'click'",
    "intersect_semi": _E + "value BETWEEN 50 AND 300 AND event_id IN (SELECT event_id FROM events WHERE user_id BETWEEN 2 AND 120) AND event_id IN (SELECT event_id FROM events WHERE event_type = 'click')",
    "group_flat": "SELECT o_orderpriority AS \"group\", row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS idx, o_orderkey FROM orders",
    "group_array": "SELECT o_orderstatus AS \"group\", count(*) AS n, md5(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)) AS keys_md5 FROM orders GROUP BY 1",
    "group_object": "SELECT o_orderstatus AS \"group\", count(*) AS n, md5(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)) AS keys_md5 FROM orders GROUP BY 1",
    "group_limit": "SELECT o_orderpriority AS \"group\", row_number() OVER (PARTITION BY o_orderpriority ORDER BY pos) - 1 AS idx, o_orderkey, pos FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders QUALIFY pos < 50)",
    "path_value": f"SELECT event_id, {_K} AS value FROM events",
    "path_of_row": "SELECT event_id, event_type AS value FROM events WHERE event_id = 17",
    "to_sum": "SELECT round(sum(o_totalprice), 2) AS total FROM orders",
    "to_share": "SELECT count(*) FILTER (event_type = 'click') AS clicks, count(*) AS rows, round(100.0 * count(*) FILTER (event_type = 'click') / count(*), 4) AS share FROM events",
    "to_all_match": "SELECT bool_and(o_totalprice > 0) AS all_positive, bool_and(o_orderstatus = 'F') AS all_done FROM orders",
    "to_max_bucket": "SELECT bucket, value, 0::BIGINT AS pos FROM (SELECT (floor(value / 10) * 10)::BIGINT AS bucket, count(*) AS value FROM events GROUP BY 1) ORDER BY value DESC, bucket LIMIT 1",
    "linked_view_swap": "SELECT event_type AS bucket, count(*) AS value FROM events WHERE value BETWEEN 100 AND 200 GROUP BY 1",
    "xf_active": f"SELECT event_id, time, value, user_id FROM ({_F}) WHERE {_X()}",
    "xf_chart_time": _HIST("time", 1),
    "xf_chart_value": _HIST("value", 10),
    "xf_chart_user": _HIST("user_id", 50),
    "xf_chart_date": f"SELECT date AS bucket, count(*) AS value FROM ({_F}) WHERE {_X('day')} GROUP BY 1",
    "xf_charts": " UNION ALL ".join([_CHART("time", "floor(time)"), _CHART("value", "floor(value / 10) * 10"), _CHART("user_id", "floor(user_id / 50) * 50"), _CHART("day", "day")]),
    "filter_python_fn": _E + "value > 2 * user_id",
    "map_python_fn": "SELECT event_id, value * 2 AS value FROM events WHERE user_id % 2 = 1",
    "path_of_composite_key": "SELECT conv_id, turn, role AS value FROM conversations WHERE conv_id = 3 AND turn = 1",
    "dense_filter": "SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, event_id FROM events WHERE event_type = 'click'",
    "length_keep_zero": "SELECT (floor(value / 10) * 10)::BIGINT AS bucket, count(*) FILTER (value BETWEEN 100 AND 140) AS value FROM events GROUP BY 1",
    "scalars": "SELECT event_id, user_id + 0.5::DOUBLE AS parsed, NULL::DOUBLE AS \"none\", make_timestamp(2001, month(ts), day(ts), hour(ts), minute(ts), 0) AS \"at\", (month(ts) - 1) || '-' || day(ts) || '-' || year(ts) AS label, round(value - user_id, 2) AS spread, event_type[1:3] AS kind, '#' || CASE WHEN value > 100 THEN 'high' ELSE 'low' END AS shown FROM events",
    "iterated": "SELECT event_id FROM events ORDER BY value, event_id LIMIT 5",
    "coerced": "SELECT count(*)::VARCHAR AS shown, count(*)::DOUBLE AS number FROM events",
    "changelog_patch_after_remove": "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END AS value, CASE WHEN event_id % 6 = 0 THEN -7 ELSE user_id END AS user_id FROM events WHERE event_id % 3 <> 0 OR event_id % 6 = 0",
    "changelog_root_update": "SELECT event_id, value + 1 AS value, user_id FROM events WHERE event_id % 10 = 0",
    "changelog_nested_null": "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value, CASE WHEN event_id % 4 = 0 THEN -5 ELSE user_id END AS user_id, event_type FROM events",
    "array_splice": """WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS p, o_orderkey FROM orders QUALIFY p < 1000),
      b AS (SELECT CASE WHEN p >= 2 THEN p + 1 ELSE p END - 1 AS pos, o_orderkey FROM a WHERE p > 0 UNION ALL SELECT 1, -1)
      SELECT pos, CASE WHEN pos = 3 THEN -2 ELSE o_orderkey END AS o_orderkey FROM b UNION ALL SELECT (SELECT count(*) FROM b), -3""",
    "xf_list": f"SELECT date AS \"group\", row_number() OVER (PARTITION BY date ORDER BY pos) - 1 AS idx, event_id, pos FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id) - 1 AS pos FROM ({_F}) WHERE {_X()} QUALIFY pos < 40)",
    "changelog_fold": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN value * 2 ELSE value END AS value, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS user_id FROM events WHERE event_id % 7 <> 0 UNION ALL SELECT -event_id, value, user_id FROM events WHERE event_id % 100 = 1",
    "diff_between_bounds": "SELECT 'insert' AS type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE value > 60 AND value <= 80 UNION ALL SELECT 'remove', count(*), sum(event_id)::BIGINT FROM events WHERE value >= 10 AND value < 20",
    "diff_single_move": "SELECT 'move' AS type, event_id, 0::BIGINT AS from_pos, 49::BIGINT AS to_pos FROM events QUALIFY row_number() OVER (ORDER BY value DESC, event_id) = 1",
    "changelog_minted": "SELECT event_id, value, user_id FROM events UNION ALL SELECT -1 - event_id, value, -3 FROM events WHERE event_id % 50 = 0",
    "az_text_all": "SELECT event_id, event_type, row_number() OVER (ORDER BY event_type, event_id) - 1 AS pos FROM events",
    "za_text_all": "SELECT event_id, event_type, row_number() OVER (ORDER BY event_type DESC, event_id) - 1 AS pos FROM events",
    "debounce_latest": """WITH RECURSIVE e AS (SELECT user_id AS k, epoch_us(ts) // 1000 AS t, value FROM events),
      armed AS (SELECT k, min(t) AS t FROM e GROUP BY k
        UNION ALL SELECT e.k, min(e.t) FROM armed JOIN e ON e.k = armed.k AND e.t > armed.t + 3600000 GROUP BY e.k),
      fires AS (SELECT armed.k AS key, armed.t + 3600000 AS fired, arg_max(e.value, e.t) AS value FROM armed JOIN e ON e.k = armed.k AND e.t BETWEEN armed.t AND armed.t + 3600000 GROUP BY armed.k, armed.t)
      SELECT key, fired, value FROM fires WINDOW w AS (PARTITION BY key ORDER BY fired) QUALIFY row_number() OVER w = 1 OR value <> lag(value) OVER w""",
    "diff_topn_moves": """WITH a AS (SELECT event_id, value, row_number() OVER (ORDER BY value DESC, event_id) - 1 AS pos FROM events QUALIFY pos < 50),
      b AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN value * 0.99::DOUBLE ELSE value END AS v2, row_number() OVER (ORDER BY v2 DESC, event_id) - 1 AS pos FROM events QUALIFY pos < 50),
      s AS (SELECT event_id, a.pos AS f, b.pos AS t, value <> v2 AS changed, row_number() OVER (ORDER BY a.pos) <> row_number() OVER (ORDER BY b.pos) AS moved FROM a JOIN b USING (event_id))
      SELECT 'remove' AS type, event_id, pos AS from_pos, NULL::BIGINT AS to_pos FROM a WHERE event_id NOT IN (SELECT event_id FROM b)
      UNION ALL SELECT 'insert', event_id, NULL, pos FROM b WHERE event_id NOT IN (SELECT event_id FROM a)
      UNION ALL SELECT 'update', event_id, f, t FROM s WHERE changed UNION ALL SELECT 'move', event_id, f, t FROM s WHERE moved""",
}
