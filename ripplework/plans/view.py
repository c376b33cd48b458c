"""Views: chains of operators over a keyed table. Nothing runs until a DataFrame is asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import predicates as P
from .nodes import Common, Kept, Made, Node, Source, ranked, ranked_in_ranges

OPERATORS: dict[str, Callable[..., View]] = {}


def register_operator(name: str, make: Callable[..., View]) -> None:
    """Make `view.name(...)` call make(view, ...)."""
    OPERATORS[name] = make


class Cell:
    """A value that views read when they are lowered, so that a bound or a pair of bounds can move under them."""

    def __init__(self, value: object = None):
        self.value = value

    def set(self, value: object) -> None:
        self.value = value

    def __str__(self) -> str:
        return str(self.value)

    def __float__(self) -> float:
        return float(self.value)


def _called(fn: Callable, kind: str):
    """A function of a Row as one of Arrow batches of rows."""

    def batch(rows: pd.DataFrame) -> pd.Series:
        row = Row(*rows.columns)
        whole = rows.astype(object).where(rows.notna(), None)
        return pd.Series([fn(row(*x)) for x in whole.itertuples(index=False, name=None)], dtype=object)

    batch.__annotations__ = {"rows": pd.DataFrame, "return": pd.Series}
    return F.pandas_udf(batch, kind)


class View:
    def __init__(self, node: Node):
        self.node = node

    @classmethod
    def over(cls, df: DataFrame, key: str | list[str], order: str | list[str] | None = None) -> View:
        """A collection of rows named by key, in the order of `order` and then key. Keys have to be unique."""
        keys = (key,) if isinstance(key, str) else tuple(key)
        first = () if order is None else (order,) if isinstance(order, str) else tuple(order)
        return cls(Source(key=keys, order=tuple(dict.fromkeys((*first, *keys))), df=df))

    @property
    def df(self) -> DataFrame:
        return self.node.frame()

    def __getattr__(self, name: str):
        if name in OPERATORS:
            return lambda *args, **kw: OPERATORS[name](self, *args, **kw)
        raise AttributeError(name)

    def _made(self, make: Callable[[DataFrame], DataFrame], **over) -> View:
        given = {"key": self.node.key, "order": self.node.order, "pos": self.node.pos} | over
        return View(Made(above=self.node, make=make, **given))

    def _kept(self, test) -> View:
        return View(Kept(key=self.node.key, order=self.node.order, pos=self.node.pos, above=self.node, test=test))

    def check_keys(self) -> View:
        """Raise if a key is null or stands twice."""
        null = F.lit(False)
        for k in self.node.key:
            null = null | F.col(k).isNull()
        bad = self.df.groupBy(*self.node.key).count().where((F.col("count") > 1) | null).limit(1).collect()
        if bad:
            raise ValueError(f"not a key: {bad[0]}")
        return self

    # filters

    def filter(self, what: Column | Callable | str | list[str] | dict, *value: object, columns: list[str] | None = None) -> View:
        """Rows by a Column, a function of a Row, a field's truth, a field's value, a nested path's truth or value, or a shape.

        columns: what a function reads; it is called over Arrow batches of these alone.
        """
        if isinstance(what, Column):
            return self._kept(lambda df: F.coalesce(what, F.lit(False)))
        if isinstance(what, dict):
            return self._kept(lambda df: P.matches(df, what))
        if callable(what):
            return self._kept(lambda df: _called(lambda row: bool(what(row)), "boolean")(F.struct(*(columns or df.columns))))
        if value:
            return self._kept(lambda df: P.strictly_equal(df, what, value[0]))
        return self._kept(lambda df: P.truthy(df, what))

    def between(self, col: str, bounds: object, collapsed: str = "inclusive") -> View:
        """Rows with a value in the bounds: a pair, a Cell with a pair, or a pair of Cells; None leaves a side open."""

        def test(df: DataFrame) -> Column:
            pair = bounds.value if isinstance(bounds, Cell) else bounds
            low, high = ((x.value if isinstance(x, Cell) else x) for x in (pair if pair is not None else (None, None)))
            floating = isinstance(P.type_of(df, col), (T.DoubleType, T.FloatType))
            return P.within(P.field(col), low, high, collapsed, floating)

        return self._kept(test)

    def intersect(self, *others: View, fuse: bool = True) -> View:
        """Rows whose key is in every view; values are this view's. Stacks of filters over one source become one scan."""
        return View(Common(key=self.node.key, order=self.node.order, pos=self.node.pos, inputs=(self.node, *(o.node for o in others)), fuse=fuse))

    # rows

    def map(self, make: dict[str, Column] | Callable, schema: str | None = None, drop_null: bool = False, columns: list[str] | None = None) -> View:
        """New columns beside key and order; a function of a Row (of some columns) needs the type of what it returns (None drops the row)."""
        stays = tuple(dict.fromkeys((*self.node.key, *self.node.order)))

        def made(df: DataFrame) -> DataFrame:
            out = df.select(*(c for c in stays if c not in make), *(e.alias(n) for n, e in make.items()))
            return out.dropna("any", subset=list(make)) if drop_null else out

        def rows(df: DataFrame) -> DataFrame:
            called = _called(make, schema)
            return df.select(*stays, called(F.struct(*(columns or df.columns))).alias("value")).where("value IS NOT NULL")

        return self._made(made if isinstance(make, dict) else rows)

    def path(self, *names: str, key: object = None) -> View:
        """A nested field as the column `value`; key: of one row alone, a tuple where several columns are the key."""

        def make(df: DataFrame) -> DataFrame:
            some = df
            if key is not None:
                for name, part in zip(self.node.key, key if isinstance(key, tuple) else (key,), strict=True):
                    some = some.where(F.col(name) == F.lit(part))
            return some.select(*self.node.key, P.field(list(names)).alias("value"))

        return self._made(make, order=self.node.key)

    # ranks

    def _top(self, col: str, n: int | None, down: bool) -> View:
        ties = self.node.order or self.node.key

        def make(df: DataFrame) -> DataFrame:
            c = P.field(col)
            floating = isinstance(P.type_of(df, col), (T.DoubleType, T.FloatType))
            c = F.nanvl(c, F.lit(None)) if floating else c
            if n is None:
                return ranked_in_ranges(df, c, down, ties)
            by = [c.desc_nulls_last() if down else c.asc_nulls_last(), *(F.col(t).asc_nulls_first() for t in ties)]
            return ranked(df.orderBy(*by).limit(n), by)

        return self._made(make, order=("pos",), pos=True)

    def za(self, col: str | int | None = None, n: int | None = None) -> View:
        """Descending, the first n, with `pos`. Without a column, by `value`. Equal values in source order, nulls last."""
        return self._top("value", col, True) if col is None or isinstance(col, int) else self._top(col, n, True)

    def az(self, col: str | int | None = None, n: int | None = None) -> View:
        """Ascending, otherwise as za."""
        return self._top("value", col, False) if col is None or isinstance(col, int) else self._top(col, n, False)

    def top(self, n: int | None = None) -> View:
        return self.za(n)

    def limit(self, n: int, present: str | None = None) -> View:
        """The first n rows in source order, with `pos`; present: a column that must not be null."""
        by = [F.col(c).asc_nulls_first() for c in self.node.order or self.node.key]

        def make(df: DataFrame) -> DataFrame:
            some = df if present is None else df.where(F.col(present).isNotNull())
            first = some.orderBy(*by).limit(n)
            out = ranked(first, by, name="_pos")
            return out.drop("pos").withColumnRenamed("_pos", "pos")

        return self._made(make, order=("pos",), pos=True)

    # folds

    def length(self, bucket: Column | None = None, keep_zero: DataFrame | None = None) -> View:
        """The number of rows as `value`, or by bucket; rows without a bucket don't count. keep_zero: buckets that stay at 0."""
        if bucket is None:
            return self._made(lambda df: df.agg(F.count(F.lit(1)).alias("value")), key=(), order=())

        def make(df: DataFrame) -> DataFrame:
            out = df.select(bucket.alias("bucket")).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("value"))
            if keep_zero is None:
                return out
            return keep_zero.select("bucket").distinct().join(out, "bucket", "full").withColumn("value", F.coalesce("value", F.lit(0)))

        return self._made(make, key=("bucket",), order=("bucket",), pos=False)

    def group(self, by: Column, form: str = "flat") -> View:
        """Rows by group. flat: columns group and idx (place in the group) beside the row; object: map of key to row; array: rows in order."""
        order = self.node.order or self.node.key

        def make(df: DataFrame) -> DataFrame:
            from pyspark.sql import Window

            kept = df.withColumn("group", by).where("group IS NOT NULL")
            if form == "flat":
                place = F.row_number().over(Window.partitionBy("group").orderBy(*(F.col(c).asc_nulls_first() for c in order)))
                return kept.withColumn("idx", (place - 1).cast("long"))
            row = F.struct(*df.columns)
            if form == "object":
                entries = F.sort_array(F.collect_list(F.struct(F.col(self.node.key[0]).alias("key"), row.alias("row"))))
                return kept.groupBy("group").agg(F.map_from_entries(entries).alias("rows"))
            listed = F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("at"), row.alias("row"))))
            return kept.groupBy("group").agg(F.transform(listed, lambda x: x["row"]).alias("rows"))

        key = ("group", *self.node.key) if form == "flat" else ("group",)
        return self._made(make, key=key, order=("group", "idx") if form == "flat" else ("group",), pos=False)

    def to(self, fold: Callable[[DataFrame], DataFrame], key: tuple[str, ...] = ()) -> View:
        """Any transformation of the whole."""
        return self._made(fold, key=key, order=key, pos=False)

    # reading

    def __iter__(self) -> Iterator[Row]:
        df = self.df
        return df.orderBy(*self.node.order).toLocalIterator() if self.node.order else df.toLocalIterator()

    def _scalar(self) -> object:
        row = self.df.first()
        return None if row is None else row["value"]

    def __str__(self) -> str:
        return str(self._scalar())

    def __float__(self) -> float:
        return float(self._scalar())


class Link(View):
    """A view that stands for another one, which can be changed under everything built on it."""

    def __init__(self, target: View):
        self.target = target

    @property
    def node(self) -> Node:
        link = self
        return Made(key=self.target.node.key, order=self.target.node.order, pos=self.target.node.pos, above=_Live(key=self.target.node.key, link=link), make=lambda df: df)

    def point(self, target: View) -> None:
        self.target = target


class _Live(Node):
    def __init__(self, key: tuple[str, ...], link: Link):
        super().__init__(key=key)
        self.link = link

    def frame(self) -> DataFrame:
        return self.link.target.df
