"""Queries of the engine's operators over the driver's tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.expr import Call, attr, count, fold, lag, lead, nth, ord_, ordg
from relata.functions import scalar as fn
from relata.relation import Relation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: First id columns, unique in the driver's tables. lineitem and the like have none.
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id"}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> Relation:
        return Relation.from_parquet(self.spark, f"{self.dir}/{name}.parquet", [[KEYS[name]]] if name in KEYS else ())

    def one(self, **values: object) -> DataFrame:
        return self.spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))


def query(sql: str | None) -> Callable:
    def register(f: Callable[[Tables], Relation | DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Tables(spark, sf_dir))
            return out.df if isinstance(out, Relation) else out

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def money(x: object) -> Call:
    return Call(lambda c: F.round(c, 2), x)


def long(x: object) -> Call:
    return Call(lambda c: c.cast("long"), x)


# --- monadic ---


@query("""SELECT s_name, round(sum(l_quantity), 2) AS q FROM supplier JOIN (SELECT DISTINCT * FROM lineitem) ON s_suppkey = l_suppkey GROUP BY s_name""")
def flagship_join_fold(t):
    supplied = t.supplier.select("s_name", k="s_suppkey").join(t.lineitem.all_but(k="l_suppkey"))
    return supplied.select("s_name", q=money(fold("+", attr("l_quantity"))))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def project_distinct(t):
    return t.lineitem.project("l_returnflag", "l_linestatus")


@query("SELECT n_nationkey AS nk, n_name AS nm, n_regionkey AS rk FROM nation")
def rename_all(t):
    return t.nation.rename(nk="n_nationkey", nm="n_name", rk="n_regionkey")


@query("SELECT DISTINCT n_regionkey AS rk FROM nation")
def rename_some(t):
    return t.nation.rename(rk="n_regionkey")


@query("SELECT DISTINCT * EXCLUDE (c_acctbal) FROM customer")
def allbut(t):
    return t.customer.all_but("c_acctbal")


@query("SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) AS rev FROM lineitem")
def extend_expr(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", rev=attr("l_extendedprice") * (1 - attr("l_discount")))


@query("SELECT * REPLACE (c_acctbal * 2 AS c_acctbal) FROM customer")
def extend_replace(t):
    return t.customer.extend(c_acctbal=attr("c_acctbal") * 2)


@query("SELECT * FROM part WHERE p_size < 10 AND p_retailprice > 1000 OR p_size = 50")
def restrict_and_or(t):
    return t.part.where((attr("p_size") < 10) & (attr("p_retailprice") > 1000) | (attr("p_size") == 50))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '[aeiou]{2}')")
def restrict_regex(t):
    return t.part.where(Call(lambda s: fn.matches(s, "[aeiou]{2}"), attr("p_name"))).project("p_partkey", "p_name")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def order_take(t):
    return t.orders.project("o_orderkey", "o_totalprice").order("-o_totalprice", "o_orderkey").take(10)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5 OFFSET 7")
def order_skip_take(t):
    return t.orders.project("o_orderkey", "o_totalprice").order("-o_totalprice", "o_orderkey").skip(7).take(5)


@query("SELECT (SELECT round(max(c_acctbal), 2) FROM customer) AS v, CAST(0 AS DOUBLE) AS none")
def lift_scalar(t):
    top = t.customer.lift(money(fold("max", attr("c_acctbal"))))
    none = t.customer.where(attr("c_custkey") < 0).lift(attr("c_acctbal"))
    return t.one(v=float(top), none=float(none))


# --- joins ---


@query("SELECT DISTINCT n_name, r_name, n_nationkey, r_regionkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_natural(t):
    return t.nation.select("n_name", "n_nationkey", k="n_regionkey").join(t.region.rename(k="r_regionkey", r_name="r_name"))


@query("SELECT DISTINCT s_name, l_partkey FROM supplier JOIN lineitem ON s_suppkey = l_suppkey")
def compose(t):
    return t.supplier.select("s_name", k="s_suppkey").compose(t.lineitem.select("l_partkey", k="l_suppkey"))


@query("SELECT DISTINCT n_regionkey FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)")
def divide_left(t):
    return t.nation.select("n_regionkey", k="n_nationkey").divide(t.supplier.where(attr("s_acctbal") > 5000).select("s_name", k="s_nationkey"))


@query("SELECT DISTINCT s_acctbal FROM supplier WHERE EXISTS (SELECT 1 FROM nation WHERE s_nationkey = n_nationkey AND n_regionkey = 1)")
def rdivide_right(t):
    return t.nation.where(attr("n_regionkey") == 1).select("n_name", k="n_nationkey").rdivide(t.supplier.select("s_acctbal", k="s_nationkey"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semijoin(t):
    return t.customer.select("c_name", c_custkey="c_custkey").matching(t.orders.where(attr("o_totalprice") > 200000).rename(c_custkey="o_custkey"))


@query("SELECT o_orderkey, o_custkey AS k FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE o_custkey = c_custkey AND c_acctbal < 0)")
def rsemijoin(t):
    return t.customer.where(attr("c_acctbal") < 0).select("c_name", k="c_custkey").rsemijoin(t.orders.select("o_orderkey", k="o_custkey"))


@query("SELECT c_custkey AS k, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def ajoin(t):
    return t.customer.select("c_name", k="c_custkey").notmatching(t.orders.where(attr("o_orderpriority") == "1-URGENT").rename(k="o_custkey"))


@query("SELECT o_orderkey, o_custkey AS k FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE o_custkey = c_custkey AND c_acctbal < 5000)")
def rajoin(t):
    return t.customer.where(attr("c_acctbal") < 5000).rename(k="c_custkey").rajoin(t.orders.select("o_orderkey", k="o_custkey"))


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def ajoinl(t):
    return t.customer.select("c_mktsegment", "c_nationkey", k="c_custkey").ajoinl(t.orders.where(attr("o_orderpriority") == "1-URGENT").rename(k="o_custkey"))


@query("SELECT DISTINCT o_orderpriority FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE o_custkey = c_custkey AND c_mktsegment = 'BUILDING')")
def rajoinr(t):
    return t.customer.where(attr("c_mktsegment") == "BUILDING").rename(k="c_custkey").rajoinr(t.orders.select("o_orderpriority", k="o_custkey"))


@query("SELECT r_name, n_name FROM region, nation")
def cross_join(t):
    return t.region.project("r_name").join(t.nation.project("n_name"))


@query("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey WHERE a.n_regionkey = b.n_regionkey")
def theta_join(t):
    a, b = t.nation.rename(x="n_name", xk="n_nationkey", r="n_regionkey"), t.nation.rename(y="n_name", yk="n_nationkey", r="n_regionkey")
    return a.join(b).where(attr("xk") < attr("yk")).project("x", "y")


@query("""SELECT (SELECT count(*) FROM supplier WHERE EXISTS (SELECT 1 FROM nation)) AS semi, (SELECT count(*) FROM supplier WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey < 0)) AS semi_empty,
                 (SELECT count(*) FROM supplier WHERE NOT EXISTS (SELECT 1 FROM nation)) AS anti, (SELECT count(*) FROM supplier WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey < 0)) AS anti_empty""")
def semijoin_no_common(t):
    some, nations = t.supplier.project("s_suppkey"), t.nation
    none = nations.where(attr("n_nationkey") < 0)
    counts = {"semi": some.semijoin(nations), "semi_empty": some.semijoin(none), "anti": some.ajoin(nations), "anti_empty": some.ajoin(none)}
    return t.one(**{k: r.count() for k, r in counts.items()}).select(*(F.col(k).cast("long") for k in counts))


@query("SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey < 0)")
def ajoin_no_common(t):
    return t.supplier.project("s_suppkey").ajoin(t.nation.where(attr("n_nationkey") < 0))


@query("""SELECT l_partkey FROM (SELECT DISTINCT l_partkey, l_returnflag FROM lineitem) GROUP BY l_partkey
          HAVING count(*) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)""")
def full_division(t):
    sold = t.lineitem.project("l_partkey", "l_returnflag")
    return sold.full_divide(t.lineitem.project("l_returnflag"))


# --- set operations ---


def _ab(t):
    a = t.customer.where(attr("c_acctbal") > 0).select("c_name", k="c_nationkey", m="c_mktsegment")
    b = t.customer.where(attr("c_acctbal") < 4000).select("c_acctbal", k="c_nationkey", m="c_mktsegment")
    return a.where(attr("k") < 15), b.where(attr("k") > 8)


_A = "(SELECT c_nationkey AS k, c_mktsegment AS m FROM customer WHERE c_acctbal > 0 AND c_nationkey < 15)"
_B = "(SELECT c_nationkey AS k, c_mktsegment AS m FROM customer WHERE c_acctbal < 4000 AND c_nationkey > 8)"


@query(f"{_A} UNION {_B}")
def union_common(t):
    a, b = _ab(t)
    return a.union(b)


@query(f"{_A} INTERSECT {_B}")
def intersect_common(t):
    a, b = _ab(t)
    return a.intersect(b)


@query(f"{_A} EXCEPT {_B}")
def minus_common(t):
    a, b = _ab(t)
    return a.minus(b)


@query(f"{_B} EXCEPT {_A}")
def rminus_common(t):
    a, b = _ab(t)
    return a.rminus(b)


@query(f"(({_A} EXCEPT {_B}) UNION ({_B} EXCEPT {_A}))")
def symdiff_common(t):
    a, b = _ab(t)
    return a.symdiff(b)


@query(f"{_A} EXCEPT SELECT k, m FROM {_B} WHERE false")
def minus_empty_right(t):
    a, b = _ab(t)
    return a.minus(b.where(attr("k") < 0))


@query(f"SELECT DISTINCT * FROM {_A}")
def symdiff_empty_right(t):
    a, b = _ab(t)
    return a.symdiff(b.where(attr("k") < 0))


@query("""WITH c AS (SELECT NOT EXISTS (SELECT n_regionkey FROM nation EXCEPT SELECT r_regionkey FROM region) AS sub,
                 NOT EXISTS (SELECT r_regionkey FROM region EXCEPT SELECT n_regionkey FROM nation WHERE n_nationkey < 3) AS sup,
                 NOT EXISTS (SELECT r_regionkey FROM region WHERE r_regionkey < 2 INTERSECT SELECT r_regionkey FROM region WHERE r_regionkey > 2) AS sep,
                 NOT EXISTS (SELECT r_regionkey FROM region WHERE r_regionkey < 3 INTERSECT SELECT r_regionkey FROM region WHERE r_regionkey > 1) AS overlap)
          SELECT *, NOT EXISTS ((SELECT r_regionkey FROM region EXCEPT SELECT n_regionkey FROM nation) UNION (SELECT n_regionkey FROM nation EXCEPT SELECT r_regionkey FROM region)) AS eq,
                 NOT EXISTS (SELECT r_regionkey FROM region EXCEPT SELECT n_regionkey FROM nation WHERE n_nationkey < 3) AS eq_few FROM c""")
def comparisons(t):
    regions, used = t.region.rename(k="r_regionkey"), t.nation.rename(k="n_regionkey")
    few = t.nation.where(attr("n_nationkey") < 3).rename(k="n_regionkey")
    low = lambda n: regions.where(attr("k") < n)
    high = lambda n: regions.where(attr("k") > n)
    return t.one(sub=used.subset(regions), sup=few.superset(regions), sep=low(2).separate(high(2)), overlap=low(3).separate(high(1)), eq=regions.equals(used), eq_few=regions.equals(few))


# --- folds ---


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, count(*) AS n FROM (SELECT DISTINCT * FROM lineitem) GROUP BY 1, 2")
def fold_sum_group(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", q=money(fold("+", attr("l_quantity"))), n=count())


@query("SELECT count(*) AS n FROM orders")
def fold_count(t):
    return t.orders.select(n=count())


@query("SELECT o_orderpriority, round(avg(o_totalprice), 4) AS a FROM orders GROUP BY 1")
def fold_avg(t):
    return t.orders.select("o_orderpriority", a=Call(lambda c: F.round(c, 4), fold("+", attr("o_totalprice")) / count()))


@query("SELECT c_mktsegment, max(c_acctbal) AS hi, min(c_acctbal) AS lo, max(c_name) AS last FROM customer GROUP BY 1")
def fold_min_max(t):
    return t.customer.select("c_mktsegment", hi=fold("max", attr("c_acctbal")), lo=fold("min", attr("c_acctbal")), last=fold("max", attr("c_name")))


@query("SELECT l_orderkey, CAST(product(l_linenumber) AS BIGINT) AS p FROM (SELECT DISTINCT * FROM lineitem) GROUP BY 1")
def fold_product(t):
    return t.lineitem.select("l_orderkey", p=fold("*", long(attr("l_linenumber"))))


@query("SELECT n_regionkey, bool_and(n_nationkey > 2) AS every, bool_or(n_nationkey > 20) AS some, sum((n_nationkey % 2 = 1)::INT) % 2 = 1 AS odd FROM nation GROUP BY 1")
def fold_all_any_xor(t):
    return t.nation.select("n_regionkey", every=fold("and", attr("n_nationkey") > 2), some=fold("or", attr("n_nationkey") > 20), odd=fold("xor", Call(lambda c: c % 2 == 1, attr("n_nationkey"))))


@query("SELECT o_custkey, string_agg(o_orderpriority, '' ORDER BY o_orderkey) AS names FROM orders GROUP BY 1")
def fold_concat_ordered(t):
    return t.orders.order("%o_custkey", "o_orderkey").select("o_custkey", names=fold("&", attr("o_orderpriority")))


@query("SELECT o_custkey, CAST(-sum(o_orderkey) AS BIGINT) AS m, 1 / product(o_orderkey % 2 + 1) AS d FROM orders GROUP BY 1")
def fold_minus_divide(t):
    return t.orders.select("o_custkey", m=fold("-", long(attr("o_orderkey"))), d=fold("/", Call(lambda c: (c % 2 + 1).cast("double"), attr("o_orderkey"))))


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ', ' ORDER BY CAST(o_orderkey AS VARCHAR)) AS names FROM orders GROUP BY 1")
def fold_user_comma(t):
    comma = (F.lit(""), lambda a, x: F.when(a == "", x).otherwise(F.concat(a, F.lit(", "), x)))
    return t.orders.select("o_custkey", names=fold(comma, Call(lambda c: c.cast("string"), attr("o_orderkey"))))


@query("SELECT bit_or(n_nationkey) AS o, bit_xor(n_nationkey) AS x FROM nation")
def fold_bits(t):
    return t.nation.select(o=fold("bit_or", attr("n_nationkey")), x=fold("bit_xor", attr("n_nationkey")))


@query("SELECT sum(c_acctbal) AS s FROM customer WHERE false HAVING count(*) > 0")
def fold_empty(t):
    return t.customer.where(attr("c_custkey") < 0).select(s=fold("+", attr("c_acctbal")))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def having_like(t):
    return t.orders.select("o_custkey", n=count()).where(attr("n") > 12)


@query("SELECT o_orderkey, round(o_totalprice - m, 2) AS over FROM orders JOIN (SELECT o_custkey AS k, max(o_totalprice) AS m FROM orders GROUP BY 1) ON o_custkey = k")
def fold_then_join(t):
    best = t.orders.select(k="o_custkey", m=fold("max", attr("o_totalprice")))
    return t.orders.rename(o_orderkey="o_orderkey", k="o_custkey", p="o_totalprice").join(best).select("o_orderkey", over=money(attr("p") - attr("m")))


# --- ordered ---


@query("SELECT o_orderkey, CAST(sum(o_custkey) OVER (ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS s, max(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey) AS m FROM orders")
def running_sum(t):
    return t.orders.order("o_orderdate", "o_orderkey").select("o_orderkey", s=fold("+", attr("o_custkey")), m=fold("max", attr("o_totalprice")))


@query("SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS s FROM orders")
def running_sum_grouped(t):
    return t.orders.order("%o_custkey", "o_orderkey").select("o_orderkey", "o_custkey", s=money(fold("+", attr("o_totalprice"))))


@query("SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS m FROM orders")
def running_max_grouped(t):
    return t.orders.order("%o_custkey", "o_orderkey").select("o_orderkey", m=fold("max", attr("o_totalprice")))


@query("""SELECT DISTINCT o_orderpriority, s FROM (
            SELECT o_orderpriority, CAST(sum(o_orderkey) OVER w AS BIGINT) AS s, lead(o_orderpriority) OVER (ORDER BY o_custkey, o_orderkey) AS nxt
            FROM orders WINDOW w AS (ORDER BY o_custkey, o_orderkey ROWS UNBOUNDED PRECEDING))
          WHERE nxt IS NULL OR nxt <> o_orderpriority""")
def ordered_suppress(t):
    return t.orders.order("o_custkey", "o_orderkey").select("o_orderpriority", s=fold("+", attr("o_orderkey")))


@query("""WITH r AS (SELECT *, CASE WHEN lag(o_orderpriority) OVER (ORDER BY o_orderdate, o_orderkey) IS DISTINCT FROM o_orderpriority THEN 1 ELSE 0 END AS b FROM orders),
               g AS (SELECT *, sum(b) OVER (ORDER BY o_orderdate, o_orderkey) AS run FROM r)
          SELECT o_orderkey, o_orderpriority, CAST(sum(o_custkey) OVER (PARTITION BY run ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS s FROM g""")
def running_sum_in_runs(t):
    return t.orders.order("o_orderdate", "o_orderkey", "%o_orderpriority").select("o_orderkey", "o_orderpriority", s=fold("+", attr("o_custkey")))


@query("SELECT o_orderkey, lag(o_totalprice, 1, 0.0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders")
def lag_default(t):
    return t.orders.order("%o_custkey", "o_orderkey").select("o_orderkey", p=lag(attr("o_totalprice"), 1))


@query("SELECT o_orderkey, lead(o_orderpriority, 2, '') OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders")
def lead_default(t):
    return t.orders.order("%o_custkey", "o_orderkey").select("o_orderkey", p=lead(attr("o_orderpriority"), 2))


@query("SELECT o_orderkey, coalesce(nth_value(o_totalprice, 3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS p FROM orders")
def nth_in_group(t):
    return t.orders.order("%o_custkey", "o_orderkey").select("o_orderkey", p=nth(attr("o_totalprice"), 2))


@query("""WITH o AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rn FROM orders)
          SELECT o_orderkey, CAST(rn AS BIGINT) AS o, CAST(first_value(rn) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS g FROM o""")
def ord_and_ordg(t):
    """Positions count by the order that rows come in, not by the one they are grouped in."""
    return t.orders.order("-o_totalprice", "o_orderkey").order("%o_custkey", "o_orderkey").select("o_orderkey", o=ord_(), g=ordg())


# --- nested relations, recursion ---


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def nest_count(t):
    nested = t.orders.project("o_custkey", "o_orderkey", "o_totalprice").nest(own=["o_orderkey", "o_totalprice"])
    return nested.select("o_custkey", n=Call(lambda c: F.size(c).cast("long"), attr("own")))


@query("SELECT c_custkey, count(o_orderkey) AS n, coalesce(round(sum(o_totalprice), 2), 0) AS s FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def image_relation_sizes(t):
    orders = t.orders.rename(c_custkey="o_custkey", o="o_orderkey", p="o_totalprice")
    seen = t.customer.project("c_custkey").image("own", orders)
    total = Call(lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.p), 2), attr("own"))
    return seen.select("c_custkey", n=Call(lambda c: F.size(c).cast("long"), attr("own")), s=total)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders")
def unnest_union(t):
    return t.orders.project("o_custkey", "o_orderkey", "o_totalprice").nest(own=["o_orderkey", "o_totalprice"]).unnest("own")


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW'")
def nested_union_fold(t):
    one = t.orders.where(attr("o_orderpriority") != "5-LOW").select("o_custkey", own=Call(lambda k, p: F.array(F.struct(k.alias("o_orderkey"), p.alias("o_orderpriority"))), attr("o_orderkey"), attr("o_orderpriority")))
    return one.select("o_custkey", own=fold("union", attr("own"))).unnest("own")


@query("""WITH p AS (SELECT DISTINCT o_custkey, o_orderkey % 4 AS part, o_orderpriority AS x FROM orders), n AS (SELECT o_custkey, count(DISTINCT part) AS m FROM p GROUP BY 1),
               c AS (SELECT o_custkey, x, count(*) AS k FROM p GROUP BY 1, 2)
          SELECT o_custkey, count(*) FILTER (WHERE k = m) AS shared, count(*) FILTER (WHERE k % 2 = 1) AS odd FROM c JOIN n USING (o_custkey) GROUP BY 1""")
def nested_intersect_symdiff(t):
    parts = t.orders.select("o_custkey", part=Call(lambda k: k % 4, attr("o_orderkey")), x="o_orderpriority").nest(own=["x"])
    size = lambda f: Call(lambda c: F.size(c).cast("long"), f)
    return parts.select("o_custkey", shared=size(fold("intersect", attr("own"))), odd=size(fold("symdiff", attr("own"))))


@query("WITH RECURSIVE r AS (SELECT 0 AS a UNION SELECT a + 3 FROM r WHERE a + 3 <= 50) SELECT CAST(a AS BIGINT) AS a FROM r")
def while_integers(t):
    seed = Relation.of(t.spark.range(1).select(F.col("id").alias("a")))
    return seed.while_(lambda d: d.select(a=attr("a") + 3).where(attr("a") <= 50))


_EDGES = "SELECT DISTINCT p_size AS x, (p_size * 7 + p_partkey % 3) % 50 AS y FROM part"


@query(f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x) SELECT x, y FROM r")
def while_closure(t):
    base = t.part.select(x=long(attr("p_size")), y=long(Call(lambda s, k: (s * 7 + k % 3) % 50, attr("p_size"), attr("p_partkey"))))
    step = base.rename(y="x", z="y")
    return base.while_(lambda d: d.compose(step).rename(x="x", y="z"))


@query(f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT 1::BIGINT AS n, 0::BIGINT AS d UNION SELECT CAST(e.y AS BIGINT), d + 1 FROM r JOIN e ON r.n = e.x WHERE d < 4) SELECT n, d FROM r")
def while_levels(t):
    edges = t.part.select(n=long(attr("p_size")), y=long(Call(lambda s, k: (s * 7 + k % 3) % 50, attr("p_size"), attr("p_partkey"))))
    seed = Relation.of(t.spark.range(1).select((F.col("id") + 1).alias("n"), F.col("id").alias("d")))
    return seed.while_(lambda r: r.where(attr("d") < 4).join(edges).select(n="y", d=attr("d") + 1))


# --- scalar functions ---


@query("""SELECT p_partkey, CAST(length(p_name) AS INTEGER) AS len, upper(p_name) AS up, lower(p_brand) AS low, trim('  ' || p_type || ' ') AS tr, p_name || '/' || p_size AS cat,
                 p_name > p_type AS gt, p_type LIKE '%BRASS%' AS re FROM part""")
def text_functions(t):
    a = attr
    return t.part.select(
        "p_partkey", len=Call(fn.length, a("p_name")), up=Call(F.upper, a("p_name")), low=Call(F.lower, a("p_brand")),
        tr=Call(lambda c: fn.trim(F.concat(F.lit("  "), c, F.lit(" "))), a("p_type")), cat=Call(lambda n, s: F.concat(n, F.lit("/"), s.cast("string")), a("p_name"), a("p_size")),
        gt=a("p_name") > a("p_type"), re=Call(lambda c: fn.matches(c, "BRASS"), a("p_type")),
    )


@query("""SELECT p_partkey, rpad(p_name, 12, ' ') AS l, CASE WHEN length(p_name) <= 12 THEN lpad(p_name, 12, ' ') ELSE right(p_name, 12) END AS r,
                 substr(repeat(p_brand, 5), 1, 17) AS f FROM part""")
def pad_cut_fill(t):
    a = attr
    return t.part.select("p_partkey", l=Call(lambda c: fn.left(c, 12), a("p_name")), r=Call(lambda c: fn.right(c, 12), a("p_name")), f=Call(lambda c: fn.fill(c, 17), a("p_brand")))


@query("""SELECT p_partkey, split_part(p_brand, '#', 1) AS b, CASE WHEN instr(p_brand, '#') = 0 THEN '' ELSE substr(p_brand, instr(p_brand, '#') + 1) END AS a,
                 CASE WHEN instr(p_name, 'zz') = 0 THEN p_name ELSE split_part(p_name, 'zz', 1) END AS whole FROM part""")
def before_after(t):
    a = attr
    return t.part.select("p_partkey", b=Call(lambda c: fn.before(c, "#"), a("p_brand")), a=Call(lambda c: fn.after(c, "#"), a("p_brand")), whole=Call(lambda c: fn.before(c, "zz"), a("p_name")))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, CAST(dayofweek(o_orderdate) AS BIGINT) AS w, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS n FROM orders")
def date_parts(t):
    d = attr("o_orderdate")
    return t.orders.select("o_orderkey", y=long(Call(F.year, d)), m=long(Call(F.month, d)), d=long(Call(F.day, d)), w=long(Call(fn.dow, d)), n=long(Call(lambda c: fn.daysdiff(c, F.to_date(F.lit("1995-01-01"))), d)))


@query("""SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) // 7 AS dv, CAST(trunc(c_acctbal) AS BIGINT) % 7 AS md, round(pow(c_nationkey, 2), 3) AS pw,
                 greatest(c_acctbal, 100.0) AS hi, least(c_acctbal, 100.0) AS lo, c_custkey & 12 AS ba, c_custkey | 5 AS bo, xor(c_custkey, 9) AS bx,
                 CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'ok' END AS st FROM customer""")
def math_and_bits(t):
    b, k = attr("c_acctbal"), attr("c_custkey")
    return t.customer.select(
        "c_custkey", dv=long(Call(lambda c: fn.div(c, 7), b)), md=long(Call(lambda c: fn.mod(c, 7), b)), pw=Call(lambda c: F.round(fn.power(c, 2), 3), attr("c_nationkey")),
        hi=Call(lambda c: fn.larger(c, 100.0), b), lo=Call(lambda c: fn.smaller(c, 100.0), b), ba=Call(lambda c: fn.bit_and(c, 12), k), bo=Call(lambda c: fn.bit_or(c, 5), k), bx=Call(lambda c: fn.bit_xor(c, 9), k),
        st=Call(lambda c: fn.choose(c < 0, "debt", "ok"), b),
    )


@query("SELECT CAST(range AS BIGINT) AS N FROM range(37)")
def seq_generate(t):
    return Relation.seq(t.spark, 37)


@query("SELECT * FROM (VALUES ('r_regionkey', 'number'), ('r_name', 'text')) v(Name, Type)")
def schema_of(t):
    return t.region.schema()


@query("SELECT (SELECT count(*) FROM nation) AS n, CAST(3 AS BIGINT) AS d")
def count_degree(t):
    return t.one(n=t.nation.count(), d=t.nation.degree()).select("n", F.col("d").cast("long").alias("d"), ).select(F.col("n").cast("long").alias("n"), "d")


@query("SELECT 1 AS some, 0 AS none")
def degree_zero(t):
    """One empty tuple, as nation has rows; its count is all that can be seen of it."""
    some, none = t.nation.project(), t.nation.where(attr("n_nationkey") < 0).project()
    return t.one(some=some.count(), none=none.count())


# --- programs in the language: statements, functions, updates, open expressions ---


def program(t: Tables, text: str, result: str, **casts: str) -> DataFrame:
    """Runs statements over the tables that they declare, and gives a relation's rows with the types asked for."""
    from relata.gateway import Session

    session = Session(t.spark, source_path=t.dir)
    session.run_script(text)
    df = session.evaluate(result).df
    return df.select(*(F.col(n).cast(casts[n]).alias(n) if n in casts else F.col(n) for n in df.columns))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION SELECT n_nationkey + 100, lower(n_name), n_regionkey FROM nation WHERE n_regionkey = 1")
def update_insert(t):
    return program(t, """
        var nation(parquet)
        update nation union (nation .where(n_regionkey = 1) .{ n_nationkey := n_nationkey + 100, n_name := tolower(n_name), n_regionkey })""", "nation", n_nationkey="int", n_regionkey="int")


@query("SELECT * FROM orders WHERE NOT (o_orderpriority = '5-LOW' AND o_totalprice < 50000)")
def update_delete(t):
    return program(t, "var orders(parquet)\nupdate orders .where(o_orderpriority = '5-LOW' and o_totalprice < 50000) .select{}", "orders")


@query("SELECT * REPLACE (CASE WHEN c_acctbal < 0 THEN 'in debt' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_acctbal < 0 THEN -c_acctbal ELSE c_acctbal END AS c_acctbal) FROM customer")
def update_modify(t):
    return program(t, "var customer(parquet)\nupdate customer .where(c_acctbal < 0) .select{ *c_mktsegment := 'in debt', c_acctbal := -c_acctbal }", "customer")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def update_minus_and_snapshot(t):
    """A snapshot keeps what an update takes away."""
    return program(t, """
        var customer(parquet)
        var orders(parquet)
        var c := customer .{ c_custkey }
        kept := c
        update c minus (orders .where(o_totalprice > 300000) .{ c_custkey := o_custkey })""", "kept intersect c")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 10) AS n FROM customer")
def correlated_extend(t):
    return program(t, "var customer(parquet)\nvar orders(parquet)", "customer .{ c_custkey, n := orders .where(o_custkey = c_custkey and o_totalprice > c_acctbal * 10) .count }", n="long")


@query("SELECT s_suppkey, s_name FROM supplier WHERE (SELECT count(*) FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal > s_acctbal) > 20")
def correlated_where(t):
    return program(t, "var supplier(parquet)\nvar customer(parquet)", "supplier .where(customer .where(c_nationkey = s_nationkey and c_acctbal > s_acctbal) .count > 20) .{ s_suppkey, s_name }")


@query("SELECT r_regionkey, count(c_custkey) AS n, coalesce(max(c_acctbal), 0) AS top FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY 1")
def image_in_program(t):
    return program(t, """
        var region(parquet)
        var nation(parquet)
        var customer(parquet)
        rich => customer .where(c_acctbal > 9000) .{ c_custkey, c_acctbal, n_nationkey := c_nationkey } compose nation .{ n_nationkey, r_regionkey := n_regionkey }""",
        "region .{ r_regionkey, mine := ({{*}} rdivide rich) } .{ r_regionkey, n := mine.count, top := mine .{ (fold(max, c_acctbal)) } }", n="long")


@query("""SELECT o_custkey, count(*) AS n, round(sum(o_totalprice) / count(*), 7) AS mean, round(max(o_totalprice) - min(o_totalprice), 2) AS spread FROM orders GROUP BY 1 HAVING count(*) > 12""")
def functions_of_folds(t):
    made = program(t, """
        var orders(parquet)
        def mean(x:0) => fold(+, x) / fold(+, 1)
        def spread(x:0) => do {
            high := fold(max, x)
            high - fold(min, x)
        }""", "orders .{ o_custkey, n := fold(+, 1), mean := mean(o_totalprice), spread := spread(o_totalprice) } .where(n > 12)", n="long")
    return made.withColumns({"mean": F.round("mean", 7), "spread": F.round("spread", 2)})


@query("SELECT o_custkey, string_agg(o_orderpriority, '+' ORDER BY o_orderkey) AS names FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1")
def user_fold_in_program(t):
    return program(t, """
        var orders(parquet)
        def plus(a:'', b:'') => if(a = '', b, a & '+' & b)""", "orders .where(o_custkey mod 3 = 0) .order(%o_custkey, o_orderkey) .{ o_custkey, names := fold(plus, o_orderpriority) }")


@query("SELECT p_partkey, 'size ' || p_size AS a, upper(p_name) || '!' AS b, p_size * 2 + 1 AS c FROM part")
def overloads_in_program(t):
    return program(t, """
        var part(parquet)
        def shown(a:0) => 'size ' & a
        def shown(a:'') => toupper(a) & '!'
        def shown(a:0, b:0) => a * b + 1""", "part .{ p_partkey, a := shown(p_size), b := shown(p_name), c := shown(p_size, 2) }", c="int")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 5")
def deferred_and_order_in_program(t):
    return program(t, """
        var customer(parquet)
        var least := 1000
        chosen => customer .where(c_acctbal > least) .{ c_custkey, c_acctbal }
        least := 5000""", "chosen .order(-c_acctbal, c_custkey) .skip(5) .take(20)")


@query(f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x) SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM r")
def recursive_function_in_program(t):
    return program(t, """
        var part(parquet)
        base := part .{ x := p_size, y := (p_size * 7 + p_partkey mod 3) mod 50 }
        def closed:base(r:base) => do {
            more := r union ((r .{ x, z := y } compose r .{ z := x, y }))
            if(more = r, r, closed(more))
        }""", "closed(base)", x="long", y="long")


@query(f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT 1 AS n, 0 AS d UNION SELECT e.y, d + 1 FROM r JOIN e ON r.n = e.x WHERE d < 4) SELECT CAST(n AS BIGINT) AS n, CAST(d AS BIGINT) AS d FROM r")
def while_in_program(t):
    return program(t, """
        var part(parquet)
        base := part .{ n := p_size, m := (p_size * 7 + p_partkey mod 3) mod 50 }
        seed := {{ n := 1, d := 0 }}""", "seed .while( ({{*}} .where(d < 4) join base) .{ n := m, d := d + 1 } )", n="long", d="long")


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS size, p_retailprice > 1500 AND p_size >= 30 AS dear FROM part")
def user_type_in_program(t):
    return program(t, """
        var part(parquet)
        type measure(amount:0, label:'')
        def named(n:0) => measure(n, if(n < 10, 'small', if(n < 30, 'middle', 'large')))""",
        "part .{ p_partkey, m := named(p_size), dear := p_retailprice > 1500 and p_size >= 30 } .{ p_partkey, size := m.label, dear }")


@query("SELECT o_orderkey, lag(o_orderkey, 1, 0) OVER w AS before, lead(o_orderpriority, 1, '') OVER w AS next, CAST(sum(o_custkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def windows_in_program(t):
    return program(t, "var orders(parquet)", "orders .order(%o_custkey, o_orderkey) .{ o_orderkey, before := lag(o_orderkey, 1), next := lead(o_orderpriority, 1), s := fold(+, o_custkey) }", before="long", s="long")


@query("SELECT (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM region) AS r, CAST(3 AS BIGINT) AS a, 'ab5' AS t, true AS q")
def scalars_in_program(t):
    return program(t, """
        var nation(parquet)
        var region(parquet)
        pair := { a := 1, b := 'x' } union { c := 2 }""", "rel({ n := nation.count, r := region.count, a := pair.a + pair.c, t := 'ab' & 5, q := pair.b = 'x' and nation .{ k := n_regionkey } = region .{ k := r_regionkey } })", n="long", r="long", a="long")
