"""Relations: sets of tuples over a DataFrame, with the operators of the algebra.

Every operator returns a set. Duplicates are removed only where they can arise: each relation knows
attribute sets that are unique in it (keys), and an operator whose result still holds a key needs
no distinct. Attributes match by name and type; nulls do not exist.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.expr import Attr, Expr, Fold, Place, Window, column, quoted
from relata.operators.ordered import GroupPlace, RangePlace, RunPlace, beside, numbered, ranged, running, runs, sort_columns
from relata.sources.store import settle, ship
from relata.types import RelationError, default_value, filled, kind, signature, stored

Key = frozenset


def configure(spark: SparkSession) -> SparkSession:
    """Settings the algebra relies on: names differ by case, decimals don't lose digits, errors are raised."""
    spark.conf.set("spark.sql.caseSensitive", "true")
    spark.conf.set("spark.sql.decimalOperations.allowPrecisionLoss", "false")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    ship(spark)
    return spark


class Relation:
    def __init__(self, df: DataFrame | None, keys: Iterable[Iterable[str]] = (), order: Iterable[tuple[str, bool, bool]] = (), *, bag: DataFrame | None = None, raw: tuple | None = None):
        """Takes df as it is: a set without nulls. Use of() for other frames.

        bag: the relation with duplicates, from which df comes by a distinct once it is needed.
        raw: the source before nulls were filled, with its declared keys; filters reach its scan.
        """
        self._df, self.bag, self.raw = df, bag, raw
        self.keys = frozenset(Key(k) for k in keys) or frozenset([Key(self.columns)])
        self.sorting = tuple(order)
        #: The order that the rows had before .order(), by which ord() counts.
        self.incoming: tuple[tuple[str, bool, bool], ...] = ()

    @property
    def df(self) -> DataFrame:
        if self._df is None:
            self._df = self.bag.distinct()
        return self._df

    # --- construction ---

    @classmethod
    def of(cls, df: DataFrame, keys: Iterable[Iterable[str]] = ()) -> Relation:
        """A relation from any frame: defaults for nulls; a distinct unless keys are declared."""
        columns = []
        for f in df.schema:
            c = F.col(quoted(f.name))
            if f.nullable or isinstance(f.dataType, T.ArrayType):
                c = filled(c, f.dataType)
            target = stored(f.dataType)
            columns.append((c if target == f.dataType else c.cast(target)).alias(f.name))
        made, keys = df.select(*columns), [list(k) for k in keys]
        return cls(made, keys, raw=(df, keys)) if keys else cls(None, (), bag=made, raw=(df, keys))

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, keys: Iterable[Iterable[str]] = ()) -> Relation:
        return cls.of(configure(spark).read.parquet(path), keys)

    @classmethod
    def literal(cls, spark: SparkSession, rows: list, schema: T.StructType | str) -> Relation:
        return cls.of(spark.createDataFrame(rows, schema))

    @classmethod
    def seq(cls, spark: SparkSession, n: int) -> Relation:
        """{N} = 0 .. n-1."""
        return cls(spark.range(max(0, n)).withColumnRenamed("id", "N"), [["N"]])

    # --- facts ---

    @property
    def columns(self) -> list[str]:
        return (self.bag if self._df is None else self._df).columns

    @property
    def heading(self) -> dict[str, object]:
        return {f.name: signature(f.dataType) for f in self.df.schema}

    def degree(self) -> int:
        return len(self.columns)

    def count(self) -> int:
        return self.df.count()

    def schema(self) -> Relation:
        """A relation {Name, Type}."""
        rows = [(f.name, kind(f.dataType)) for f in self.df.schema]
        return Relation(self.df.sparkSession.createDataFrame(rows, "Name string, Type string"), [["Name"]])

    def _field(self, name: str) -> T.StructField:
        if name not in self.columns:
            raise RelationError(f"unknown attribute {name}")
        return self.df.schema[name]

    def _has_key(self, names: Iterable[str]) -> bool:
        names = set(names)
        return any(k <= names for k in self.keys)

    def _set(self, df: DataFrame, keys: Iterable[Iterable[str]], order: Iterable = ()) -> Relation:
        """df as a relation: distinct unless it still holds one of keys."""
        held = [k for k in keys if set(k) <= set(df.columns)]
        return Relation(df, held, order) if held else Relation(df.distinct(), (), order)

    # --- monadic operators ---

    def project(self, *names: str) -> Relation:
        for n in names:
            self._field(n)
        source = self.df if self.bag is None or self._has_key(names) else self.bag
        return self._set(source.select(*map(_col, names)), self.keys, [s for s in self.sorting if s[0] in names])

    def rename(self, **new_from_old: str) -> Relation:
        """Renamed attributes alone: rename(X="A"); with all of the heading it is a pure rename."""
        return self.select(**new_from_old)

    def all_but(self, *names: str, **changes: object) -> Relation:
        """All attributes but those named, with renames and extensions applied."""
        return self.select(*names, star=True, **changes)

    def extend(self, **new: object) -> Relation:
        return self.select(star=True, **new)

    def where(self, condition: object) -> Relation:
        if isinstance(condition, Expr) and condition.any(Fold):
            raise RelationError("a fold can't be in a where")
        test, raw, source = column(condition, Place()), None, self
        names = _attributes(condition)
        if self.raw is not None and names and all(stored(t.dataType) == t.dataType and not isinstance(t.dataType, T.ArrayType | T.StructType) for t in self.raw[0].schema if t.name in names):
            # Filled columns hide a filter from the scan. Where none of its attributes is null it says the
            # same of the raw columns, so the scan may drop what fails there.
            maybe = test
            for n in sorted(names):
                maybe = maybe | _col(n).isNull()
            source = Relation.of(self.raw[0].filter(maybe), self.raw[1])
            raw = source.raw
        if source._df is None:
            return Relation(None, self.keys, self.sorting, bag=source.bag.filter(test), raw=raw)
        return Relation(source.df.filter(test), self.keys, self.sorting, raw=raw)

    def order(self, *terms: str) -> Relation:
        """Terms are names, with - for descending and % for grouping before them: "%CITY", "-QTY", "%-A"."""
        parsed = []
        for term in terms:
            name = term.lstrip("%-") if term not in self.columns else term
            marks = term[: len(term) - len(name)]
            self._field(name)
            parsed.append((name, "-" in marks, "%" in marks))
        out = Relation(self.df, self.keys, parsed)
        out.incoming = self.sorting
        return out

    def take(self, n: int) -> Relation:
        """The first n rows by order, ties by all attributes."""
        return Relation(self.df.orderBy(*sort_columns(self.sorting, self.columns)).limit(max(0, n)), self.keys, self.sorting)

    def skip(self, n: int) -> Relation:
        return Relation(self.df.orderBy(*sort_columns(self.sorting, self.columns)).offset(max(0, n)), self.keys, self.sorting)

    def lift(self, expr: object) -> object:
        """A scalar: the expression's first value by order, or its type's default if there is none."""
        plain = not (isinstance(expr, Expr) and (expr.any(Fold) or expr.any(Window)))
        one = (self.take(1) if plain else self).select(_lifted=expr)
        row = one.df.limit(1).collect()
        return row[0][0] if row else default_value(one.df.schema[0].dataType)

    def select(self, *names: str, star: bool = False, **new: object) -> Relation:
        """Projection, renaming (a string), extension (an expression), folds and windows at once.

        With star, all attributes stay but those named; without it, those named are what stays.
        """
        return self.transform(names, star, new)

    def transform(self, names: Iterable[str], star: bool, new: dict[str, object]) -> Relation:
        """select() for names that Python's keywords can't hold."""
        for n in names:
            self._field(n)
        renames = {k: v for k, v in new.items() if isinstance(v, str)}
        exprs = {k: v for k, v in new.items() if not isinstance(v, str)}
        for old in renames.values():
            self._field(old)
        plain = [n for n in self.columns if (n not in names and n not in renames.values() and n not in exprs) == star and (star or n in names)]
        kept = {n: n for n in plain} | {k: v for k, v in renames.items()}
        folds = [v for v in exprs.values() if isinstance(v, Expr) and v.any(Fold)]
        windows = [v for v in exprs.values() if isinstance(v, Expr) and v.any(Window)]
        if windows or (folds and self.sorting):
            return self._ordered(kept, exprs, bool(windows))
        if folds:
            return self._grouped(kept, exprs)
        back = {old: k for k, old in kept.items()}
        keys = [[back[n] for n in key] for key in self.keys if key <= back.keys()]
        source = self.df if keys or self.bag is None else self.bag  # the result gets its own distinct
        out = source.select(*(_col(old).alias(k) for k, old in kept.items()), *(self._made(column(v, Place()), source).alias(k) for k, v in exprs.items()))
        return self._set(out, keys, [(back[n], d, g) for n, d, g in self.sorting if n in back])

    def _made(self, c: Column, df: DataFrame | None = None) -> Column:
        t = (self.df if df is None else df).select(c).schema[0].dataType
        if isinstance(t, T.ArrayType):
            c = F.array_sort(F.array_distinct(c))
        return c if stored(t) == t else c.cast(stored(t))

    def _grouped(self, kept: dict[str, str], exprs: dict[str, object], keys: list[Column] | None = None) -> Relation:
        scalars = {k: v for k, v in exprs.items() if not (isinstance(v, Expr) and v.any(Fold))}
        place = GroupPlace(self.df, keys)
        by = [_col(old).alias(k) for k, old in kept.items()] + [column(v, Place()).alias(k) for k, v in scalars.items()]
        folded = [column(v, place).alias(k) for k, v in exprs.items() if k not in scalars]
        # no keys: grouping by a constant gives no row for an empty input, as the algebra asks
        grouped = self.df.groupBy(*(by or [F.lit(1).alias("_all")])).agg(*folded)
        types = {f.name: f.dataType for f in grouped.schema}
        grouped = grouped.select(*((_col(n) if stored(types[n]) == types[n] else _col(n).cast(stored(types[n]))).alias(n) for n in [*kept, *exprs]))
        return Relation(grouped, [[*kept, *scalars]])

    def _ordered(self, kept: dict[str, str], exprs: dict[str, object], windows: bool) -> Relation:
        order = list(self.sorting)
        constant = not kept and all(isinstance(v, Expr) and v.any(Fold) for v in exprs.values())
        if constant and not windows:  # only folds: a group's last value is its whole value
            descending = any(d for _, d, _ in order)
            grouping = [n for n, _, g in order if g]
            flags = [g for _, _, g in order]
            if not descending and flags == sorted(flags, reverse=True):
                keys = [_col(n) for n, _, g in order if not g] + [_col(n) for n in sorted(self.columns) if n not in {x for x, _, _ in order}]
                out = self._grouped({f"_g{i}": n for i, n in enumerate(grouping)}, exprs, keys)
                return out.project(*exprs) if grouping else out
        df = self.df
        if any(isinstance(v, Expr) and v.any(Window) and _uses(v, ("ord", "ordg")) for v in exprs.values()):
            df = numbered(df, self.incoming)
        if not windows and not any(g for _, _, g in order) and all(f.op in RangePlace.JOINED for v in exprs.values() for f in _folds(v) if isinstance(f.op, str)) and all(isinstance(f.op, str) for v in exprs.values() for f in _folds(v)):
            return self._ranged(df, kept, exprs, order)
        df, group = runs(df, order)
        by = sort_columns(order, self.columns)
        place = RunPlace(df, group, by)
        steady = {k: v for k, v in exprs.items() if not (isinstance(v, Expr) and v.any(Fold))}
        made = df.select("*", *(column(v, place).alias(f"_x_{k}") for k, v in exprs.items()))
        if len(steady) < len(exprs):  # rows that equal the next one but for folds give way to it
            same = F.struct(*(_col(old) for old in kept.values()), *(F.col(quoted(f"_x_{k}")) for k in steady), F.lit(1).alias("_one"))
            following = F.lead(same).over(RunPlace(made, group, by).sorted)
            made = made.withColumn("_same", same).withColumn("_next", following).where("_next is null or _next <> _same")
        out = made.select(*(_col(old).alias(k) for k, old in kept.items()), *(self._made(F.col(quoted(f"_x_{k}")), made).alias(k) for k in exprs))
        return Relation(out.distinct())

    def _ranged(self, df: DataFrame, kept: dict[str, str], exprs: dict[str, object], order: list) -> Relation:
        """Running folds in one global order, by ranges of it."""
        parts, keys = ranged(df, order)
        place = RangePlace(df)
        made = {k: column(v, place) for k, v in exprs.items()}
        steady = {k: v for k, v in exprs.items() if not (isinstance(v, Expr) and v.any(Fold))}
        whole = set(self.columns) <= set(kept.values())
        if not whole:  # rows that equal the next one but for folds give way to it
            same = F.struct(*(_col(old) for old in kept.values()), *(made[k] for k in steady), F.lit(1).alias("_one"))
            parts = settle(beside(parts, keys, same, "_next", ahead=True).withColumn("_gives", F.coalesce(F.col("_next") == same, F.lit(False))).drop("_next"))
        out = running(parts, keys, place.folds)
        out = out if whole else out.where("not _gives")
        out = out.select(*(_col(old).alias(k) for k, old in kept.items()), *(self._made(c, out).alias(k) for k, c in made.items()))
        return Relation(out if whole else out.distinct())

    # --- joins ---

    def _common(self, other: Relation) -> list[str]:
        mine, theirs = self.heading, other.heading
        common = [n for n in self.columns if n in theirs]
        for n in common:
            if mine[n] != theirs[n]:
                raise RelationError(f"duplicate attribute {n}: its types differ")
        return common

    def _only(self, other: Relation) -> list[str]:
        return [n for n in self.columns if n not in other.columns]

    def join(self, other: Relation) -> Relation:
        common = self._common(other)
        keys = [a | b for a in self.keys for b in other.keys]
        if any(k <= set(common) for k in other.keys):
            keys += self.keys
        if any(k <= set(common) for k in self.keys):
            keys += other.keys
        df = self.df.join(other.df, common) if common else self.df.crossJoin(other.df)
        return Relation(df, keys)

    def compose(self, other: Relation) -> Relation:
        return self.join(other).project(*self._only(other), *other._only(self))

    def semijoin(self, other: Relation) -> Relation:
        common = self._common(other)
        df = self.df.join(other.df.select(*map(_col, common)), common, "left_semi") if common else self.df.crossJoin(other.df.select().distinct())
        return Relation(df, self.keys, self.sorting)

    def ajoin(self, other: Relation) -> Relation:
        common = self._common(other)
        df = self.df.join(other.df.select(*map(_col, common)), common, "left_anti") if common else self.df.join(other.df.select(F.lit(1).alias("_one")).limit(1), F.lit(True), "left_anti")
        return Relation(df, self.keys, self.sorting)

    def divide(self, other: Relation) -> Relation:
        """The left's own attributes of rows with a match."""
        return self.semijoin(other).project(*self._only(other))

    def rdivide(self, other: Relation) -> Relation:
        return other.divide(self)

    def rsemijoin(self, other: Relation) -> Relation:
        return other.semijoin(self)

    def rajoin(self, other: Relation) -> Relation:
        return other.ajoin(self)

    def ajoinl(self, other: Relation) -> Relation:
        return self.ajoin(other).project(*self._only(other))

    def rajoinr(self, other: Relation) -> Relation:
        return other.ajoinl(self)

    def full_divide(self, other: Relation) -> Relation:
        """Relational division: the left's own attributes that occur with every row of the right."""
        mine, common = self._only(other), self._common(other)
        need = other.project(*common)
        n = need.df.agg(F.count("*").alias("_need"))
        got = self.project(*self.columns).semijoin(need).df.groupBy(*map(_col, mine)).agg(F.count("*").alias("_got"))
        return Relation(got.crossJoin(n).where("_got = _need").select(*map(_col, mine)), [mine])

    matching = joinlc = semijoin
    notmatching = ajoin
    joinlr, joinl, joinr, joincr = compose, divide, rdivide, rsemijoin

    # --- set operations, over common attributes ---

    def _both(self, other: Relation) -> tuple[Relation, Relation]:
        common = self._common(other)
        a, b = self.project(*common), other.project(*common)
        return a, Relation(b.df.select(*map(_col, common)), b.keys)

    def union(self, other: Relation) -> Relation:
        a, b = self._both(other)
        return Relation(a.df.unionByName(b.df).distinct())

    def intersect(self, other: Relation) -> Relation:
        a, b = self._both(other)
        return Relation(a.df.intersect(b.df), a.keys | b.keys) if a.columns else a.semijoin(b)

    def minus(self, other: Relation) -> Relation:
        a, b = self._both(other)
        return Relation(a.df.subtract(b.df), a.keys) if a.columns else a.ajoin(b)

    def rminus(self, other: Relation) -> Relation:
        return other.minus(self)

    def symdiff(self, other: Relation) -> Relation:
        """One pass: after the union of both sets, tuples that came from one side only."""
        a, b = self._both(other)
        if not a.columns:
            return Relation(a.ajoin(b).df.union(b.ajoin(a).df))
        tagged = a.df.withColumn("_side", F.lit(1)).unionByName(b.df.withColumn("_side", F.lit(2)))
        return Relation(tagged.groupBy(*map(_col, a.columns)).agg(F.sum("_side").alias("_side")).where("_side < 3").drop("_side"))

    # --- comparisons ---

    def subset(self, other: Relation) -> bool:
        self._same_heading(other)
        return self.minus(other).df.isEmpty()

    def superset(self, other: Relation) -> bool:
        return other.subset(self)

    def separate(self, other: Relation) -> bool:
        self._same_heading(other)
        return self.intersect(other).df.isEmpty()

    def equals(self, other: Relation) -> bool:
        return self.heading == other.heading and self.symdiff(other).df.isEmpty()

    def _same_heading(self, other: Relation) -> None:
        if self.heading != other.heading:
            raise RelationError("the headings differ")

    # --- nested relations ---

    def nest(self, **groups: Iterable[str]) -> Relation:
        """nest(parts=["P", "QTY"]): those attributes go into a relation-valued one, by the others."""
        inside = {n for names in groups.values() for n in names}
        by = [n for n in self.columns if n not in inside]
        made = [F.array_sort(F.collect_set(F.struct(*map(_col, names)))).alias(k) for k, names in groups.items()]
        return Relation(self.df.groupBy(*map(_col, by)).agg(*made), [by])

    def unnest(self, name: str) -> Relation:
        rest = [n for n in self.columns if n != name]
        if not isinstance(self._field(name).dataType, T.ArrayType):
            raise RelationError(f"{name} is not a relation")
        return Relation(self.df.select(*map(_col, rest), F.inline(_col(name))).distinct())

    def image(self, name: str, other: Relation) -> Relation:
        """Extends each tuple with the other's matching tuples, less the common attributes; empty if none match."""
        common, rest = self._common(other), other._only(self)
        groups = other.df.groupBy(*map(_col, common)).agg(F.array_sort(F.collect_set(F.struct(*map(_col, rest)))).alias(name))
        t = groups.schema[name].dataType
        df = self.df.join(groups, common, "left") if common else self.df.crossJoin(groups)
        return Relation(df.select(*map(_col, self.columns), F.coalesce(_col(name), F.array().cast(t)).alias(name)), self.keys)

    # --- recursion ---

    def while_(self, step: Callable[[Relation], Relation], max_rounds: int = 1000) -> Relation:
        """self and all that step makes of it and of what it made, until nothing new comes.

        Semi-naive: a round applies step to the last round's new tuples only. Rounds are written to
        the checkpoint folder, so the plan stays short and lost executors cost no recomputation.
        """
        found = settle(self.df)
        delta, files = Relation(found), 1
        for _ in range(max_rounds):
            made = step(delta)
            if made.heading != self.heading:
                raise RelationError("a while must give the heading it starts from")
            new = made.df.select(*(_col(f.name).cast(f.dataType).alias(f.name) for f in self.df.schema)).distinct()
            fresh = settle(new.subtract(found))
            if fresh.isEmpty():
                return Relation(found)
            found, delta, files = found.unionByName(fresh), Relation(fresh), files + 1
            if files == 8:  # what was found is read in every round: keep it in few files
                found, files = settle(found.repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))), 1
        raise RelationError(f"a while did not end in {max_rounds} rounds")

    # --- output ---

    def ordered(self) -> DataFrame:
        """The rows in the relation's order, ties by all attributes; as they come if it has none."""
        return self.df.orderBy(*sort_columns(self.sorting, self.columns)) if self.sorting else self.df

    def rows(self) -> list[Row]:
        return self.ordered().collect()

    def write_csv(self, path: str) -> None:
        """One folder of csv files with a header; relation-valued attributes as JSON."""
        nested = [F.to_json(_col(f.name)).alias(f.name) if isinstance(f.dataType, T.ArrayType | T.StructType) else _col(f.name) for f in self.df.schema]
        self.ordered().select(*nested).write.csv(path, header=True)

    def __repr__(self) -> str:
        return f"Relation({', '.join(f'{n}:{k}' for n, k in self.heading.items())})"


def _col(name: str) -> Column:
    return F.col(quoted(name))


def _attributes(e: object) -> set[str]:
    """Names of the attributes in an expression; none if it holds Columns, whose names can't be told."""
    if isinstance(e, Attr):
        return {e.name}
    parts = [p for p in e.parts] if isinstance(e, Expr) else []
    if any(isinstance(p, Column) for p in parts):
        return set()
    return set().union(*map(_attributes, parts)) if parts else set()


def _folds(e: object) -> list[Fold]:
    return [e] if isinstance(e, Fold) else [f for p in e.parts for f in _folds(p)] if isinstance(e, Expr) else []


def _uses(e: object, names: tuple[str, ...]) -> bool:
    return isinstance(e, Window) and e.name in names or isinstance(e, Expr) and any(_uses(p, names) for p in e.parts)


__all__ = ["Attr", "Relation", "configure"]
