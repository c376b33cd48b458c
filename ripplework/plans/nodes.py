"""The logical plan of a view and its lowering to a DataFrame.

A node holds what to compute, never rows. Filters keep their predicates as functions of the DataFrame they apply to, so
that a stack of filters over one source, or an intersection of such stacks, lowers to one conjunction over one scan.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Predicate = Callable[[DataFrame], Column]
_NUMBERS = itertools.count(1)


@dataclass(eq=False)
class Node:
    """key: columns that name a row; order: columns of the source order, ending with the key; pos: whether a dense `pos` column stands."""

    key: tuple[str, ...]
    order: tuple[str, ...] = ()
    pos: bool = False
    number: int = field(default_factory=lambda: next(_NUMBERS))

    def frame(self) -> DataFrame:
        raise NotImplementedError

    def base(self) -> tuple[Node, tuple[Predicate, ...]]:
        """The node under a stack of row-local predicates, and these."""
        return self, ()


@dataclass(eq=False)
class Source(Node):
    df: DataFrame | None = None

    def frame(self) -> DataFrame:
        return self.df


@dataclass(eq=False)
class Kept(Node):
    """Rows for which the predicate holds."""

    above: Node | None = None
    test: Predicate | None = None

    def base(self) -> tuple[Node, tuple[Predicate, ...]]:
        node, tests = self.above.base()
        return node, (*tests, self.test)

    def frame(self) -> DataFrame:
        node, tests = self.base()
        df = node.frame()
        out = df
        for test in tests:
            out = out.where(test(df))
        return out


@dataclass(eq=False)
class Common(Node):
    """Rows of the first input whose key all others have."""

    inputs: tuple[Node, ...] = ()
    fuse: bool = True

    def fused(self) -> tuple[Node, tuple[Predicate, ...]] | None:
        """One conjunction, if all inputs are stacks of predicates over one source."""
        bases = [n.base() for n in self.inputs]
        if self.fuse and all(b[0] is bases[0][0] for b in bases):
            return bases[0][0], tuple(dict.fromkeys(t for _, tests in bases for t in tests))
        return None

    def base(self) -> tuple[Node, tuple[Predicate, ...]]:
        return self.fused() or (self, ())

    def frame(self) -> DataFrame:
        if fused := self.fused():
            df = fused[0].frame()
            out = df
            for test in fused[1]:
                out = out.where(test(df))
            return out
        out = self.inputs[0].frame()
        for other in self.inputs[1:]:
            out = out.join(other.frame().select(*self.key), list(self.key), "left_semi")
        return out


@dataclass(eq=False)
class Made(Node):
    """What a function makes of the input's DataFrame."""

    above: Node | None = None
    make: Callable[[DataFrame], DataFrame] | None = None

    def frame(self) -> DataFrame:
        return self.make(self.above.frame())


#: Sampled rows for each range of a ranking.
PER_RANGE = 8


def ranked(df: DataFrame, by: list[Column], name: str = "pos") -> DataFrame:
    """df, which the caller vouches to be small, with its dense rank from 0 in the order `by`."""
    return df.withColumn(name, (F.row_number().over(Window.orderBy(*by)) - 1).cast("long"))


def ranked_in_ranges(df: DataFrame, lead: Column, down: bool, ties: tuple[str, ...], name: str = "pos") -> DataFrame:
    """df with its dense rank from 0 by lead (nulls last) and then by the columns `ties` (ascending, nulls first).

    Rows are cut into ranges of the whole order, ties included, and each range is ranked by itself, so that no task sees all
    rows, whatever lead's type and however common one value is. The cuts are rows with the least hashes; where they lie
    changes no rank. A lead that is an array, a map or a struct makes one range.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    placed = df.withColumn("_lead", lead).withColumn("_ties", F.struct(*(F.col(t) for t in ties)))
    by = [F.col("_lead").desc_nulls_last() if down else F.col("_lead").asc_nulls_last(), F.col("_ties").asc()]
    kind, fields = placed.schema["_lead"].dataType, placed.schema["_ties"].dataType.fields
    rows = []
    if n > 1 and not isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        some = placed.select("_lead", "_ties").orderBy(F.xxhash64("_lead", "_ties")).limit(n * PER_RANGE)
        cut = ranked(some, by, "_k").where(F.col("_k") % PER_RANGE == PER_RANGE - 1)
        rows = cut.select("_lead", "_ties").collect()  # at most a row a range
    of = lambda v, t: F.lit(v).cast(t)
    cuts = [F.struct(of(r["_lead"], kind).alias("lead"), F.struct(*(of(r["_ties"][f.name], f.dataType).alias(f.name) for f in fields)).alias("ties")) for r in rows]

    def reached(x: Column) -> Column:
        past = F.col("_lead") < x["lead"] if down else F.col("_lead") > x["lead"]
        past = F.when(x["lead"].isNull(), F.lit(False)).when(F.col("_lead").isNull(), F.lit(True)).otherwise(past)
        return past | (F.col("_lead").eqNullSafe(x["lead"]) & (F.col("_ties") >= x["ties"]))

    dealt = placed.withColumn("_part", F.size(F.filter(F.array(*cuts), reached)) if cuts else F.lit(0))
    sizes = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}  # as many rows as ranges
    starts, at = [], 0
    for p in sorted(sizes):
        starts += [F.lit(p), F.lit(at)]
        at += sizes[p]
    offset = F.create_map(*starts)[F.col("_part")] if starts else F.lit(0)
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return dealt.withColumn(name, (own - 1 + offset).cast("long")).drop("_lead", "_ties", "_part")
