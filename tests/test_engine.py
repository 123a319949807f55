"""The algebra: known facts about suppliers and parts, laws, and cases without rows or attributes."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from relata.expr import Call, attr, count, fold, lag, lead, nth, ord_, ordg
from relata.relation import Relation
from relata.sources import readers
from relata.types import RelationError
from tests.data import write_tables


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    from pyspark.sql import types as T

    from relata.relation import configure

    configure(spark)
    folder = write_tables(tmp_path_factory.mktemp("tables"))
    kinds = {"STATUS": readers.NUMBER, "WEIGHT": readers.NUMBER, "QTY": readers.NUMBER}
    out = {}
    for name in ("S", "P", "SP", "MM"):
        heading = readers.header(spark, f"{folder}/{name}.csv")
        heading = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in heading])
        out[name] = readers.csv(spark, f"{folder}/{name}.csv", heading)
        out[name].df.cache()
    return out


def rows(r):
    return sorted(tuple(x) for x in r.rows())


@pytest.mark.parametrize("op,n,degree", [
    ("join", 12, 6), ("compose", 12, 5), ("divide", 4, 3), ("rdivide", 9, 2), ("semijoin", 4, 4), ("rsemijoin", 12, 3), ("ajoin", 1, 4), ("ajoinl", 1, 3), ("rajoin", 0, 3), ("rajoinr", 0, 2),
    ("minus", 1, 1), ("intersect", 4, 1), ("rminus", 0, 1), ("symdiff", 1, 1), ("union", 5, 1), ("joinlr", 12, 5), ("joinl", 4, 3), ("joinr", 9, 2), ("joincr", 12, 3), ("matching", 4, 4), ("notmatching", 1, 4),
])
def test_dyadic_counts_and_degrees(db, op, n, degree):
    out = getattr(db["S"], op)(db["SP"])
    assert (out.count(), out.degree()) == (n, degree)


def test_no_common_attributes(db):
    s, p, none = db["S"].project("S#"), db["P"].project("P#"), db["P"].project("P#").where(attr("P#") == "")
    assert s.join(p).count() == 30
    assert s.semijoin(p).count() == 5 and s.semijoin(none).count() == 0
    assert s.ajoin(p).count() == 0 and s.ajoin(none).count() == 5


def test_set_operations_with_an_empty_side(db):
    s, none = db["S"].project("CITY"), db["P"].project("CITY", "COLOR").where(attr("COLOR") == "")
    assert s.minus(none).equals(s) and s.symdiff(none).equals(s) and none.symdiff(s).equals(s) and none.minus(s).count() == 0


def test_degree_zero(db):
    dee, dum = db["S"].project(), db["S"].where(attr("CITY") == "").project()
    assert (dee.count(), dum.count(), dee.degree()) == (1, 0, 0)
    assert dee.equals(db["P"].project()) and not dee.equals(dum)
    assert db["S"].join(dee).equals(db["S"]) and db["S"].join(dum).count() == 0
    assert dee.minus(dum).equals(dee) and dee.intersect(dum).equals(dum) and dum.union(dee).equals(dee)


def test_types_must_agree(db):
    with pytest.raises(RelationError):
        db["S"].join(db["P"].select(STATUS="PNAME"))
    with pytest.raises(RelationError):
        db["S"].project("NOTHING")
    with pytest.raises(RelationError):
        db["S"].where(fold("+", attr("STATUS")) > 0)


def test_folds(db):
    s = db["S"]
    assert s.lift(fold("+", attr("STATUS"))) == 110 and s.project("STATUS").lift(fold("+", attr("STATUS"))) == 60
    assert s.lift(fold("*", attr("STATUS"))) == 3600000 and s.lift(fold("max", attr("SNAME"))) == "Smith"
    assert s.lift(fold("+", attr("STATUS")) / count()) == 22
    assert s.order("S#").lift(fold("&", attr("SNAME"))) == "SmithJonesBlakeClarkAdams"
    assert s.order("-S#").lift(fold("&", attr("SNAME"))) == "AdamsClarkBlakeJonesSmith"
    none = s.where(attr("STATUS") < 0)
    assert none.select(n=fold("max", attr("STATUS"))).count() == 0 and none.lift(fold("max", attr("STATUS"))) == 0 and none.lift(attr("SNAME")) == ""
    assert rows(s.select("CITY", t=fold("+", attr("STATUS")))) == [("Athens", 30), ("London", 40), ("Paris", 40)]


def test_ordered(db):
    q = Relation.of(db["S"].df.sparkSession.createDataFrame([(1, "abc", 6), (2, "def", 5), (3, "g", 5), (4, "h", 5), (5, "ijkl", 9)], "A0 int, A1 string, A2 int"))
    one = lambda r: {x[0] for x in r.rows()}
    assert one(q.order("A1").select("A0", N=fold("+", attr("A0"))).project("N")) == {1, 3, 6, 10, 15}
    assert one(q.order("%A2", "A1").select(N=lag(attr("A0"), 1))) == {0, 2, 3}
    assert one(q.order("%A2", "A1").select(N=lead(attr("A0"), 2))) == {0, 4}
    assert one(q.order("%A2", "A1").select(N=nth(attr("A0"), 1))) == {0, 3}
    assert one(q.order("A1").select(N=nth(attr("A0"), 3))) == {4}
    assert one(q.order("A1").select(N=lag(attr("A0"), -1))) == {0}
    assert rows(db["S"].order("CITY").select("CITY", SS=fold("+", attr("STATUS")))) == [("Athens", 30), ("London", 70), ("Paris", 110)]
    # a group is a run: A2 is 6, then 5 three times, then 9
    assert rows(q.order("A0", "%A2").select("A0", N=fold("+", attr("A0")))) == [(1, 1), (2, 2), (3, 5), (4, 9), (5, 5)]
    assert rows(q.order("-A0").select("A0", o=ord_(), g=ordg())) == [(i, i - 1, 4) for i in range(1, 6)]


def test_running_sums_over_many_ranges(spark):
    r = random.Random(4)
    data = [(i, r.randint(0, 99)) for i in range(3000)]
    r.shuffle(data)
    got = dict(rows(Relation.of(spark.createDataFrame(data, "k int, v int")).order("k").select("k", "v", s=fold("+", attr("v"))).project("k", "s")))
    total = 0
    for k, v in sorted(data):
        total += v
        assert got[k] == total


def test_ordered_selects_without_exchange_reuse(spark):
    """Range samples differ from run to run, so nothing may read a range shuffle twice."""
    old = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        many = Relation(spark.range(600_000).select(((F.col("id") * 7919) % 600_000).alias("k"), F.lit(1).alias("one")), [["k"]])
        got = many.order("k").select("k", "one", s=fold("+", attr("one"))).df
        assert got.agg(F.max("s"), F.countDistinct("s"), F.sum((F.col("s") != F.col("k") + 1).cast("int"))).first() == (600_000, 600_000, 0)
        r = random.Random(8)
        data = [(i, r.choice("aab"), r.randint(-9, 9)) for i in range(4000)]
        rel = Relation.of(spark.createDataFrame(r.sample(data, 4000), "k int, c string, v int"))
        kept = rows(rel.order("k").select("c", s=fold("+", attr("v")), m=fold("max", attr("v")), both=fold("+", attr("v")) * 2 + fold("min", attr("v"))))
        total, want = 0, set()
        for i, (_, c, v) in enumerate(data):
            total += v
            if i == len(data) - 1 or data[i + 1][1] != c:
                seen = [x for *_, x in data[: i + 1]]
                want.add((c, total, max(seen), total * 2 + min(seen)))
        assert set(kept) == want and len(kept) == len(want)
        runs = {x.k: x.s for x in rel.order("k", "%c").select("k", "c", s=fold("+", attr("v"))).rows()}
        sums, last = 0, None
        for k, c, v in data:
            sums = sums + v if c == last else v
            last = c
            assert runs[k] == sums
    finally:
        spark.conf.set("spark.sql.exchange.reuse", old)


def test_relation_values_fold(spark):
    df = spark.createDataFrame([(1, [("a", 1), ("b", 2)]), (1, [("b", 2), ("c", 3)]), (2, [("a", 1)]), (3, []), (3, [("a", 1)])], "g int, own array<struct<x:string,n:int>>")
    rel = Relation.of(df)
    as_sets = lambda op: {r.g: sorted(x.x for x in r.o) for r in rel.select("g", o=fold(op, attr("own"))).rows()}
    assert as_sets("union") == {1: ["a", "b", "c"], 2: ["a"], 3: ["a"]}
    assert as_sets("intersect") == as_sets("join") == {1: ["b"], 2: ["a"], 3: []}
    assert as_sets("symdiff") == {1: ["a", "c"], 2: ["a"], 3: ["a"]}
    with pytest.raises(RelationError):
        as_sets("compose")


def test_csv_output(spark, tmp_path):
    rel = Relation.of(spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")).order("-k")
    rel.write_csv(str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "out"), header=True, schema="k int, v string").orderBy("k").collect()] == [(1, "a"), (2, "b")]


def test_nesting(db):
    s, sp = db["S"], db["SP"]
    nested = sp.nest(own=["P#", "QTY"])
    assert nested.count() == 4 and nested.unnest("own").equals(sp)
    image = s.image("parts", sp)
    sizes = {x["S#"]: len(x.parts) for x in image.rows()}
    assert sizes == {"S1": 6, "S2": 2, "S3": 1, "S4": 3, "S5": 0}
    assert s.extend(all=Call(lambda *c: F.array(F.struct(*c)), *map(attr, s.columns))).select(all=fold("union", attr("all"))).unnest("all").count() == 5


def test_while_closure_and_cycles(db, spark):
    mm = db["MM"]
    step = mm.rename(MINOR="MAJOR", Z="MINOR")
    assert mm.while_(lambda d: d.compose(step).rename(MAJOR="MAJOR", MINOR="Z")).count() == 11
    ring = Relation.of(spark.createDataFrame([(i, (i + 1) % 5) for i in range(5)], "a int, b int"))
    assert ring.while_(lambda d: d.compose(ring.rename(b="a", c="b")).rename(a="a", b="c")).count() == 25
    with pytest.raises(RelationError):
        ring.while_(lambda d: d.project("a"))


def test_laws(spark):
    r = random.Random(9)
    for _ in range(4):
        make = lambda names, n: Relation.of(spark.createDataFrame([tuple(r.randint(0, 4) for _ in names) for _ in range(n)], ", ".join(f"{x} int" for x in names)))
        a, b = make("xy", r.choice((0, 6, 12))), make("yz", r.choice((0, 6, 12)))
        c = make("xy", 8)
        assert a.symdiff(c).equals(a.minus(c).union(c.minus(a)))
        assert a.semijoin(b).union(a.ajoin(b)).equals(a)
        assert a.union(a).equals(a) and a.intersect(c).subset(a) and a.minus(c).separate(c)
        assert a.join(b).project("x", "z").equals(a.compose(b))
        assert a.join(b).equals(b.join(a).project("x", "y", "z"))
        assert a.divide(b).equals(a.semijoin(b).project("x"))
        assert a.union(c).superset(a)


def test_keys_save_a_distinct(db):
    keyed = Relation(db["S"].df, [["S#"]])
    plan = lambda r: r.df._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert "Aggregate" not in plan(keyed.project("S#", "CITY")) and "Aggregate" in plan(keyed.project("CITY"))
    assert keyed.join(db["SP"]).keys and frozenset(["S#"]) not in keyed.join(db["SP"]).keys


def test_nulls_become_defaults(spark):
    df = spark.createDataFrame([(None, None, None, None, None), (None, None, None, None, None)], "a int, b string, c boolean, d double, e timestamp_ntz")
    r = Relation.of(df)
    assert r.count() == 1 and tuple(r.rows()[0])[:4] == (0, "", False, 0.0) and r.rows()[0].e.year == 1


def test_take_and_skip_in_all_orders(db):
    s = db["S"]
    names = [x.SNAME for x in s.order("SNAME").take(9).rows()]
    for i, j in itertools.product(range(0, 7), (-1, 0, 2, 9)):
        assert sorted(x.SNAME for x in s.order("SNAME").skip(i).take(j).rows()) == sorted(names[i : i + max(0, j)])


def test_lift_goes_by_order(db):
    s = db["S"]
    assert s.order("-STATUS", "-SNAME").lift(attr("SNAME")) == "Blake" and s.order("STATUS").lift(attr("SNAME")) == "Jones"
    assert s.lift(attr("S#")) == "S5"  # without an order, by all attributes
