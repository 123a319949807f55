"""Windows for ordered selects: running folds, lag, lead, nth, ord, ordg, ranks, and row suppression.

A group is a run of rows with equal values of the grouping (%) attributes. Where those come first in
the order, runs are partitions; otherwise runs are numbered by a flag at each change. Without any
grouping attribute a window would run in one task; folds that join from parts, and suppression, then
go by ranges of the order, which any number of tasks share. Other functions (lag, lead, nth, ranks, and
folds that gather values) without a grouping attribute do run in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.expr import Fold, Place, Window, column, quoted
from relata.operators.folds import aggregate
from relata.sources.store import settle
from relata.types import RelationError, default


def sort_columns(order: list[tuple[str, bool, bool]], names: list[str]) -> list[Column]:
    """The order's terms (name, descending, grouping), ties broken by all attributes."""
    own = [F.col(quoted(n)).desc() if desc else F.col(quoted(n)).asc() for n, desc, _ in order]
    taken = {n for n, _, _ in order}
    return own + [F.col(quoted(n)).asc() for n in sorted(names) if n not in taken]


class GroupPlace(Place):
    """A select with folds and no order: folds are aggregates; ordered ones go by all attributes."""

    def __init__(self, df: DataFrame, keys: list[Column] | None = None):
        self.df, self.keys = df, keys

    def fold(self, fold: Fold) -> Column:
        c = column(fold.arg, Place())
        return aggregate(fold.op, c, self.df.select(c).schema[0].dataType, self.keys)


class RunPlace(Place):
    """An ordered select: folds run from the group's start to the row."""

    def __init__(self, df: DataFrame, group: list[Column], order: list[Column]):
        self.df = df
        self.sorted = W.partitionBy(*group).orderBy(*order)
        self.running = self.sorted.rowsBetween(W.unboundedPreceding, W.currentRow)
        self.whole = self.sorted.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)

    def _typed(self, x: object) -> tuple[Column, T.DataType]:
        c = column(x, Place())
        return c, self.df.select(c).schema[0].dataType

    def fold(self, fold: Fold) -> Column:
        c, t = self._typed(fold.arg)
        running = lambda a: a.over(self.running)
        if fold.op == "-":
            return -running(F.sum(c))
        if fold.op == "+":
            total = running(F.sum(c))
            return total.cast(T.DecimalType(38, t.scale)) if isinstance(t, T.DecimalType) else total
        if fold.op == "xor":
            return running(F.sum(c.cast("int"))) % 2 == 1
        if fold.op == "&":
            return F.array_join(running(F.collect_list(c)), "")
        lists = running(F.collect_list(c))
        if fold.op in ("*", "/"):
            wide = T.DecimalType(38, 18) if fold.op == "/" and not isinstance(t, T.FractionalType) or isinstance(t, T.DecimalType) else T.LongType() if isinstance(t, T.IntegralType) else t
            return F.aggregate(lists, F.lit(1).cast(wide), lambda a, x: ((a * x) if fold.op == "*" else (a / x)).cast(wide))
        if fold.op == "union":
            return F.array_sort(F.array_distinct(F.flatten(lists)))
        if not isinstance(fold.op, str):
            return F.aggregate(lists, *fold.op)
        return running(aggregate(fold.op, c, t))

    def window(self, call: Window) -> Column:
        if call.name == "ord":
            return F.col("_ord")
        if call.name == "ordg":
            return F.first("_ord").over(self.whole)
        if call.name in ("rank", "dense_rank", "row_number"):
            return getattr(F, call.name)().over(self.sorted)
        c, t = self._typed(call.arg)
        if call.n < 0:
            return default(t)
        if call.name in ("lag", "lead"):
            return F.coalesce(getattr(F, call.name)(c, call.n).over(self.sorted), default(t))
        if call.name == "nth":
            return F.coalesce(F.nth_value(c, call.n + 1).over(self.whole), default(t))
        raise RelationError(f"no window function {call.name}")


class RangePlace(Place):
    """An ordered select over one global order: its folds become columns that running() adds."""

    #: Folds whose running values join from parts.
    JOINED = {"+": F.sum, "-": F.sum, "max": F.max, "min": F.min, "and": F.bool_and, "or": F.bool_or, "bit_or": F.bit_or, "bit_and": F.bit_and, "bit_xor": F.bit_xor}

    def __init__(self, df: DataFrame):
        self.df = df
        self.folds: dict[str, tuple[str, Column]] = {}

    def fold(self, fold: Fold) -> Column:
        c = column(fold.arg, Place())
        t = self.df.select(c).schema[0].dataType
        name = f"_f{len(self.folds)}"
        self.folds[name] = (fold.op, c)
        if fold.op == "-":
            return -F.col(name)
        return F.col(name).cast(T.DecimalType(38, t.scale)) if fold.op == "+" and isinstance(t, T.DecimalType) else F.col(name)


def ranged(df: DataFrame, order: list[tuple[str, bool, bool]]) -> tuple[DataFrame, list[Column]]:
    """df dealt to parts (_part) by range of one global order, and the order's columns.

    Written once: the range sample may differ when a plan runs again, and what follows reads parts twice.
    """
    keys = sort_columns(order, df.columns)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id())), keys


def running(parts: DataFrame, keys: list[Column], folds: dict[str, tuple[str, Column]], before: bool = False) -> DataFrame:
    """parts with running folds over the global order: within each part, joined with what earlier parts fold to."""
    own = W.partitionBy("_part").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1 if before else 0)
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row a part
    use = {n: RangePlace.JOINED[op] for n, (op, _) in folds.items()}
    whole = parts.groupBy("_part").agg(*(use[n](c).alias(f"_whole{n}") for n, (_, c) in folds.items()))
    whole = whole.select("_part", *(use[n](F.col(f"_whole{n}")).over(earlier).alias(f"_from{n}") for n in folds))

    def joined(n: str, op: str, c: Column) -> Column:
        a, b = F.col(f"_from{n}"), use[n](c).over(own)
        if op in ("max", "min"):
            return (F.greatest if op == "max" else F.least)(a, b)
        both = {"+": a + b, "-": a + b, "and": a & b, "or": a | b, "bit_or": a.bitwiseOR(b), "bit_and": a.bitwiseAND(b), "bit_xor": a.bitwiseXOR(b)}[op]
        return F.coalesce(both, a, b)

    return parts.join(whole, "_part").select(*(F.col(quoted(n)) for n in parts.columns), *(joined(n, op, c).alias(n) for n, (op, c) in folds.items()))


def beside(parts: DataFrame, keys: list[Column], value: Column, name: str, ahead: bool) -> DataFrame:
    """parts with the value of the next (ahead) or the previous row in the global order, null at its end.

    A part's border row gets it from the nearest part that has rows.
    """
    own = W.partitionBy("_part").orderBy(*keys)
    near, far = (F.lead, F.lag) if ahead else (F.lag, F.lead)
    border = parts.select("_part", value.alias("_value"), far(F.lit(1)).over(own).alias("_more")).where("_more is null")
    border = border.select("_part", near("_value").over(W.orderBy("_part")).alias("_over"))  # a row a part
    return parts.withColumn("_near", near(value).over(own)).join(border, "_part").select(*(F.col(quoted(n)) for n in parts.columns), F.coalesce("_near", "_over").alias(name))


def runs(df: DataFrame, order: list[tuple[str, bool, bool]]) -> tuple[DataFrame, list[Column]]:
    """df and the columns that tell its groups apart; may add a column _run."""
    grouping = [n for n, _, g in order if g]
    flags = [g for _, _, g in order]
    group = [F.col(quoted(n)) for n in grouping]
    if not grouping or flags == sorted(flags, reverse=True):
        return df, group
    parts, keys = ranged(df, order)
    key = F.struct(*group)
    changed = beside(parts, keys, key, "_previous", ahead=False).withColumn("_change", F.coalesce((F.col("_previous") != key).cast("long"), F.lit(0))).drop("_previous")
    return running(settle(changed), keys, {"_run": ("+", F.col("_change"))}).drop("_change", "_part"), [F.col("_run")]


def numbered(df: DataFrame, order: list[tuple[str, bool, bool]]) -> DataFrame:
    """df with _ord, each row's position from 0 in the given order, by ranges: no task sees all rows."""
    parts, keys = ranged(df, order)
    out = running(parts, keys, {"_ord": ("+", F.lit(1).cast("long"))}, before=True)
    return out.withColumn("_ord", F.coalesce("_ord", F.lit(0).cast("long"))).drop("_part")
