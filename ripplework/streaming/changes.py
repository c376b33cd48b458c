"""The change log and the delta feed.

A log row is (seq, type, key, value): type is update, insert or remove; key the row's key, null for the whole collection;
value a struct of the row's fields. An update of an absent key inserts it; a removal of an absent key does nothing; a root
removal clears, and what comes after it stands; a root update (null key, type update) clears too, and the rows of its own seq
are the new collection. A patch (type patch) changes some fields: those that the log's column `fields` (array of names) lists,
to null as well, or without such a list those that are not null in value. A name with dots sets a field inside a struct. A
patch of an absent or removed key makes a row of its fields alone.

diff() turns two states into the net change: remove, update, move, insert. Rows are told apart by key; a moved row is one
that is in both states with a changed rank among those that are in both or, with `fewest`, one of the least number of rows
that have to move.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERBS = ("remove", "update", "move", "insert")


def _leaves(df: DataFrame, names: list[str]) -> list[tuple[str, ...]]:
    """Paths of the fields and, inside structs, of theirs."""

    def below(kind: T.DataType, path: tuple[str, ...]) -> list[tuple[str, ...]]:
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in below(f.dataType, (*path, f.name))]
        return [path]

    return [x for n in names for x in below(df.schema[n].dataType, (n,))]


def _at(column: str, path: tuple[str, ...]) -> Column:
    out = F.col(column)
    for name in path:
        out = out[name]
    return out


def fold(base: DataFrame, log: DataFrame, key: str = "key") -> DataFrame:
    """base (key, fields) after the log (seq, type, key, value: struct of the fields[, fields: names that a patch sets]), by one aggregation over keys."""
    fields = [c for c in base.columns if c != key]
    leaves = _leaves(base, fields)
    listed = F.col("fields") if "fields" in log.columns else F.lit(None).cast("array<string>")
    cleared = log.where(f"`{key}` IS NULL AND type IN ('remove', 'update')").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_cleared"))
    flat = lambda of: F.struct(*(of(path).alias(f"f{i}") for i, path in enumerate(leaves)))
    start = base.select(key, F.lit(-1).cast("long").alias("seq"), F.lit("insert").alias("type"), flat(lambda p: _at(p[0], p[1:])).alias("value"), F.lit(None).cast("array<string>").alias("fields"))
    # a removed row's old value is no part of what a later patch makes
    held = flat(lambda p: F.when(F.col("type") != "remove", _at("value", p)))
    every = start.unionByName(log.where(F.col(key).isNotNull()).select(key, F.col("seq").cast("long"), "type", held.alias("value"), listed.alias("fields")))
    live = every.join(F.broadcast(cleared), F.col("seq") >= F.col("_cleared"))
    # the last whole write of each key, then its patches: for each field the last one that sets it
    whole = F.when(F.col("type") != "patch", F.col("seq"))
    marked = live.withColumn("_last", F.max(whole).over(Window.partitionBy(key))).where("_last IS NULL OR seq >= _last")

    def sets(i: int, path: tuple[str, ...]) -> Column:
        names = [".".join(path[: k + 1]) for k in range(len(path))]
        named = F.arrays_overlap("fields", F.array(*map(F.lit, names)))
        return (F.col("type") != "patch") | F.when(F.col("fields").isNull(), F.col(f"value.f{i}").isNotNull()).otherwise(named)

    picks = [F.max_by(F.struct(F.col(f"value.f{i}").alias("v")), F.when(sets(i, path), F.col("seq"))).alias(f"f{i}") for i, path in enumerate(leaves)]
    last, patched = F.max_by(F.struct("type"), whole).alias("_type"), F.count_if(F.col("type") == "patch").alias("_patched")
    state = marked.groupBy(key).agg(last, patched, *picks).where("_type.type IS NULL OR _type.type <> 'remove' OR _patched > 0")
    value = {path: F.col(f"f{i}.v") for i, path in enumerate(leaves)}

    def built(kind: T.DataType, path: tuple[str, ...]) -> Column:
        if not isinstance(kind, T.StructType):
            return value[path]
        own = F.struct(*(built(f.dataType, (*path, f.name)).alias(f.name) for f in kind.fields))
        empty = F.lit(True)
        for x, c in value.items():
            if x[: len(path)] == path:
                empty = empty & c.isNull()
        return F.when(~empty, own)

    return state.select(key, *(built(base.schema[f].dataType, (f,)).alias(f) for f in fields))


def mint(log: DataFrame, key: str = "key", make: Callable[[Column], Column] | None = None) -> DataFrame:
    """log with a key for each insert that has none: make(its seq), or else a hash of the seq, so that a repeated batch gets the same keys."""
    kind = log.schema[key].dataType
    own = make or (lambda seq: F.md5(seq.cast("string")) if isinstance(kind, T.StringType) else F.xxhash64(seq))
    new = F.when((F.col("type") == "insert") & F.col(key).isNull(), own(F.col("seq")).cast(kind))
    return log.withColumn(key, F.coalesce(F.col(key), new))


def splice(base: DataFrame, log: DataFrame, pos: str = "pos") -> DataFrame:
    """An array (dense pos from 0, fields) after positional writes (seq, type: insert, remove or update; at: place as it then is;
    value: struct of the fields). An insert without a place goes to the end; removals and inserts shift what follows.

    The places of writes follow from the earlier ones, so the log, which is one change's, is read by the driver; rows are
    not: each one's new place is its old one moved by the stretches that the writes leave.
    """
    fields = [c for c in base.columns if c != pos]
    n = base.count()
    runs: list[tuple[int, int, int | None]] = [(0, n, None)]  # (first, count, number of the write that made it); None: rows of the base
    for k, w in enumerate(log.select("seq", "type", "at").orderBy("seq").collect()):
        size = sum(c for _, c, _ in runs)
        at = size if w["at"] is None and w["type"] == "insert" else w["at"]
        if at is None or at < 0 or at > size or (at == size and w["type"] != "insert"):
            continue  # no such place
        before, after, left = [], [], at
        for first, count, made in runs:
            take = min(left, count)
            left -= take
            if take:
                before.append((first, take, made))
            if count > take:
                after.append((first + take, count - take, made))
        if w["type"] != "insert":
            first, count, made = after[0]
            after = ([(first + 1, count - 1, made)] if count > 1 else []) + after[1:]
        runs = before + ([(0, 1, k)] if w["type"] != "remove" else []) + after
    rows, at = [], 0
    for first, count, made in runs:
        rows.append((first, first + count, at - first, made))
        at += count
    spark = base.sparkSession
    shifts = spark.createDataFrame([(a, b, d) for a, b, d, made in rows if made is None], "_a long, _b long, _d long")
    old = base.join(F.broadcast(shifts), (F.col(pos) >= F.col("_a")) & (F.col(pos) < F.col("_b"))).select((F.col(pos) + F.col("_d")).cast("int").alias(pos), *fields)
    made_at = spark.createDataFrame([(k, d) for _, _, d, k in rows if k is not None], "_k long, _p int")
    numbered = log.withColumn("_k", (F.row_number().over(Window.orderBy("seq")) - 1).cast("long"))  # one change's writes
    new = numbered.join(F.broadcast(made_at), "_k").select(F.col("_p").alias(pos), *(F.col(f"value.{f}").alias(f) for f in fields))
    return old.unionByName(new)


def _comparable(df: DataFrame, c: str):
    kind = dict(df.dtypes)[c]
    return F.to_json(F.struct(F.col(c))) if "map<" in kind or "variant" in kind else F.col(c)


def _out_of_run(part: pd.DataFrame) -> pd.DataFrame:
    """The places before (a_pos) of all rows but those of one longest run whose places after (b_pos) rise."""
    part = part.sort_values("a_pos")
    after, tails, heads, back = part["b_pos"].tolist(), [], [], []
    for i, x in enumerate(after):
        k = bisect_left(tails, x)
        tails[k : k + 1], heads[k : k + 1] = [x], [i]
        back.append(heads[k - 1] if k else -1)
    stays, i = set(), heads[-1] if heads else -1
    while i >= 0:
        stays.add(i)
        i = back[i]
    return part[["a_pos"]].iloc[[i for i in range(len(after)) if i not in stays]]


def diff(before: DataFrame, after: DataFrame, key: list[str], pos: str | None = None, fewest: bool = False) -> DataFrame:
    """type, key (struct), value (struct, of the removed row for a removal), from, to (ranks, with pos) of the net change.

    fewest: tell the least number of moves; the places of the rows in both states (16 bytes each) then meet in one task.
    """
    fields = [c for c in after.columns if c not in key and c != pos]

    def side(df: DataFrame, name: str) -> DataFrame:
        row = F.struct(*(F.col(c) for c in fields)) if fields else F.struct(F.lit(True).alias("present"))
        print_ = F.struct(*(_comparable(df, c).alias(c) for c in fields)) if fields else F.lit(True)
        rank = F.col(pos).cast("long") if pos else F.lit(None).cast("long")
        return df.select(*key, row.alias(f"{name}_row"), print_.alias(f"{name}_print"), rank.alias(f"{name}_pos"), F.lit(True).alias(name))

    on = F.lit(True)
    a, b = side(before, "a"), side(after, "b")
    a = a.select(*(F.col(k).alias(f"a_{k}") for k in key), "a_row", "a_print", "a_pos", "a")
    for k in key:
        on = on & F.col(f"a_{k}").eqNullSafe(F.col(k))
    both = a.join(b, on, "full")
    if pos:
        # a rank among the rows of both states: a plain shift, from rows that come or go before, is no move
        stay = both.where("a AND b")
        order = lambda c: F.row_number().over(Window.orderBy(c))  # noqa: E731  positional views are bounded by their n
        if fewest:
            shifted = stay.select("a_pos", "b_pos").groupBy(F.lit(0).alias("_all")).applyInPandas(_out_of_run, "a_pos long")
        else:
            shifted = stay.withColumn("_ra", order("a_pos")).withColumn("_rb", order("b_pos")).where("_ra <> _rb")
        shifted = shifted.select(F.col("a_pos").alias("m_pos"), F.lit(True).alias("moved"))
        both = both.join(shifted, (F.col("m_pos") == F.col("a_pos")) & F.col("b"), "left")
    else:
        both = both.withColumn("moved", F.lit(None).cast("boolean"))
    verbs = F.concat(
        F.when(F.col("b").isNull(), F.array(F.lit("remove"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("a") & F.col("b") & ~F.col("a_print").eqNullSafe(F.col("b_print")), F.array(F.lit("update"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("moved"), F.array(F.lit("move"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("a").isNull(), F.array(F.lit("insert"))).otherwise(F.array().cast("array<string>")),
    )
    named = F.struct(*(F.coalesce(F.col(k), F.col(f"a_{k}")).alias(k) for k in key))
    return both.select(F.explode(verbs).alias("type"), named.alias("key"), F.coalesce("b_row", "a_row").alias("value"), F.col("a_pos").alias("from"), F.col("b_pos").alias("to"))


def apply(before: DataFrame, delta: DataFrame, key: list[str], pos: str | None = None) -> DataFrame:
    """The state after a delta: what diff() says, applied. For tests and for consumers that keep a copy."""
    gone = delta.where("type IN ('remove', 'update', 'insert')").select(*(F.col(f"key.{k}").alias(k) for k in key)).distinct()
    fields = [c for c in before.columns if c not in key and c != pos]
    new = delta.where("type IN ('update', 'insert')").select(*(F.col(f"key.{k}").alias(k) for k in key), *(F.col(f"value.{f}").alias(f) for f in fields))
    return before.select(*key, *fields).join(gone, key, "left_anti").unionByName(new)
