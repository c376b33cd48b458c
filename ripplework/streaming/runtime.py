"""Views kept current over a stream of changes, and debounced values.

Each micro-batch folds its log rows into the base table, which is written to a new folder; registered views are lowered over the new table, and the difference from their last state
goes to their sinks. A batch is one change: consumers see its net effect, never what lies between.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.view import View
from .changes import _comparable, diff, fold

#: Tasks that debounce, for each shuffle partition.
BURST_PARTS = 4
_COMMIT = "batch long, name string, path string"
Sink = Callable[[int, DataFrame, DataFrame], None]


def to_list(out: list) -> Sink:
    """Append each delta's rows; for small views."""
    return lambda batch, delta, state: out.extend(delta.collect())


def to_table(path: str) -> Sink:
    """Write each delta below path, one folder a batch."""
    return lambda batch, delta, state: delta.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def to_view(name: str) -> Sink:
    """Keep the whole state as a temporary view."""
    return lambda batch, delta, state: state.createOrReplaceTempView(name)


def to_call(fn: Callable[[list[Row]], None]) -> Sink:
    return lambda batch, delta, state: fn(delta.collect())


class Engine:
    """A base table, the views over it and their sinks. define(view of the base) gives a view.

    Each change writes new folders and then, after its sinks have run, the commit that names them: a change that fails or is
    repeated starts from what the last commit names, and sinks may see its delta again, but miss none. An engine that is
    made over a folder with commits goes on from the last one; `base` is then not read.
    """

    def __init__(self, spark: SparkSession, folder: str, base: DataFrame | None = None, key: str = "key", order: str | None = None):
        self.spark, self.folder, self.key, self.order = spark, folder, key, order
        self.views: dict[str, tuple[Callable[[View], View], list[Sink]]] = {}
        self.states: dict[str, DataFrame] = {}
        found = self._commits()
        if found:
            self.commit = max(found)
            rows = self.spark.read.schema(_COMMIT).parquet(self._at("commits", self.commit)).collect()  # a row a view, and the base's
            self.batch = rows[0]["batch"]
            self.paths = {r["name"]: r["path"] for r in rows}
        else:
            self.commit, self.batch, self.paths = 0, -1, {}
            path = self._fresh("base")
            base.write.parquet(path)
            self._commit(-1, {None: path})

    def _at(self, what: str, number: int) -> str:
        return f"{self.folder}/{what}/number={number}"

    def _fresh(self, what: str) -> str:
        """A folder that no commit names, whatever failed before."""
        return f"{self.folder}/{what}/{uuid.uuid4().hex}"

    def _commits(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        return [int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(where) if fs.exists(jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]

    def _commit(self, batch: int, paths: dict[str | None, str]) -> None:
        merged = self.paths | paths
        rows = [(batch, name, path) for name, path in merged.items()]
        self.spark.createDataFrame(rows, _COMMIT).coalesce(1).write.mode("overwrite").parquet(self._at("commits", self.commit + 1))
        self.commit, self.batch, self.paths = self.commit + 1, batch, merged

    def base(self) -> DataFrame:
        return self.spark.read.parquet(self.paths[None])

    def register(self, name: str, define: Callable[[View], View], *sinks: Sink) -> None:
        """Sinks first get the present state as inserts; of a view that an earlier engine had here, what has changed since."""
        self.views[name] = (define, list(sinks))
        path, state, view = self._lowered(name, self.base())
        before = self.spark.read.schema(state.schema).parquet(self.paths[name]) if name in self.paths else state.limit(0)
        self._tell(name, before, state, view, self.batch, first=name not in self.paths)
        self._commit(self.batch, {name: path})
        self.states[name] = state

    def disconnect(self, name: str) -> None:
        self.views.pop(name)
        self.states.pop(name)
        self.paths.pop(name)

    def _lowered(self, name: str, base: DataFrame) -> tuple[str, DataFrame, View]:
        view, path = self.views[name][0](View.over(base, self.key, self.order)), self._fresh(f"views/{name}")
        view.df.write.parquet(path)
        return path, self.spark.read.parquet(path), view

    def _tell(self, name: str, before: DataFrame, state: DataFrame, view: View, batch: int, first: bool = False) -> None:
        sinks = self.views[name][1]
        delta = diff(before, state, list(view.node.key), "pos" if view.node.pos else None, fewest=True)
        if sinks and (first or not delta.isEmpty()):
            for sink in sinks:
                sink(batch, delta, state)

    def apply(self, log: DataFrame, batch: int | None = None) -> None:
        """Fold a batch of log rows (seq, type, key, value) and tell the sinks what changed. Empty batches, and those committed before, do nothing."""
        if (batch is not None and batch <= self.batch) or log.isEmpty():
            return
        path = self._fresh("base")
        fold(self.base(), log, self.key).write.parquet(path)
        self._refresh(self.batch + 1 if batch is None else batch, {None: path}, self.spark.read.parquet(path))

    def refresh(self) -> None:
        """Lower all views again, as after a bound has moved, and tell the sinks."""
        self._refresh(self.batch, {}, self.base())

    def _refresh(self, batch: int, paths: dict[str | None, str], base: DataFrame) -> None:
        states = {}
        for name in self.views:
            path, state, view = self._lowered(name, base)
            self._tell(name, self.states[name], state, view, batch)
            paths[name], states[name] = path, state
        self._commit(batch, paths)
        self.states |= states

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Follow a stream of log rows."""
        writer = stream.writeStream.foreachBatch(lambda log, number: self.apply(log, number)).option("checkpointLocation", checkpoint)
        return writer.trigger(**trigger).start() if trigger else writer.start()


def debounced(events: DataFrame, key: str, at: str, value: str, ms: int = 1000) -> DataFrame:
    """What a trailing throttle lets through of recorded events: the first event arms it, later ones don't rearm it, and ms
    later the latest value comes out, unless it is the one that came out last. key, fired (ms), value.

    Where nothing comes for longer than ms, whatever was armed has fired: a key's history falls apart there into bursts, and a
    task holds a hashed share of all bursts, not a key's history. Events without a time are left out.
    """
    kind = dict(events.dtypes)
    millis = (F.unix_micros(F.col(at).cast("timestamp")) / 1000).cast("long") if "timestamp" in kind[at] else F.col(at).cast("long")
    rows = events.select(F.col(key).alias("key"), millis.alias("at"), F.col(value).alias("value")).where("at IS NOT NULL")
    in_time = Window.partitionBy("key").orderBy("at")
    fresh = rows.withColumn("_fresh", F.coalesce(F.col("at") - F.lag("at").over(in_time) > ms, F.lit(True)).cast("int"))
    bursts = fresh.withColumn("_burst", F.sum("_fresh").over(in_time)).drop("_fresh").withColumn("_a", F.xxhash64("key")).withColumn("_b", F.hash("key"))
    parts = BURST_PARTS * int(events.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    names = ["_a", "_b", "_burst"]

    def fire(part: pa.Table) -> pa.Table:
        ids = [part.column(c).to_numpy() for c in names]
        times = part.column("at").to_numpy()
        order = np.lexsort((times, *ids[::-1]))
        first = np.ones(len(order), bool)
        first[1:] = np.any([x[order][1:] != x[order][:-1] for x in ids], axis=0)
        picks, fired, until = [], [], None
        for k, (new, t) in enumerate(zip(first.tolist(), times[order].tolist(), strict=True)):
            if new or t > until:
                if until is not None:
                    picks.append(k - 1)
                    fired.append(until)
                until = t + ms
        picks.append(len(order) - 1)
        fired.append(until)
        some = part.select(["key", "value"]).take(pa.array(order[picks]))
        return some.add_column(1, "fired", pa.array(fired, pa.int64()))

    dealt = bursts.groupBy(F.pmod(F.xxhash64("key", "_burst"), F.lit(parts)).alias("_part"))
    out = dealt.applyInArrow(fire, f"key {kind[key]}, fired long, value {kind[value]}")
    by_key = Window.partitionBy("key").orderBy("fired")
    seen = out.withColumn("_value", _comparable(out, "value"))
    last = F.lag(F.struct("_value")).over(by_key)
    same = F.col("_last._value").eqNullSafe(F.col("_value"))
    if kind[value] in ("double", "float"):
        same = same & ~F.coalesce(F.isnan("value"), F.lit(False))  # NaN is never the value that came out last
    return seen.withColumn("_last", last).where(F.col("_last").isNull() | ~same).select("key", "fired", "value")


def debounce_stream(stream: DataFrame, key: str, value: str, ms: int = 1000) -> DataFrame:
    """The same over a live stream by processing time: (key, value: double)."""

    def fire(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest, last, fired = state.get if state.exists else (None, None, False)
        if state.hasTimedOut:
            if not fired or latest != last:
                yield pd.DataFrame({"key": [name[0]], "value": [latest]})
            state.update((latest, latest, True))
            return
        armed = False
        for part in parts:
            latest, armed = float(part["value"].iloc[-1]), True
        state.update((latest, last, fired))
        if armed:
            state.setTimeoutDuration(ms)

    kind = dict(stream.dtypes)[key]
    rows = stream.select(F.col(key).alias("key"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(fire, f"key {kind}, value double", "latest double, last double, fired boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)
