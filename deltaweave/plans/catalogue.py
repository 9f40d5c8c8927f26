"""Every query of the recursive engine by name, and the DuckDB SQL of its rows."""

from __future__ import annotations

import io
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import Side
from ..operators.leapers import ExtendAnti, ExtendWith, FilterAnti, FilterWith, LeaperSpec, PrefixFilter, ValueFilter, leapjoin, passthrough
from ..operators.relation import Relation
from ..sources.facts import order_chains, part_tree, table, text_facts, user_edges
from ..sources.scratch import scratch_root
from . import programs
from .fixpoint import Iteration

Q, SQL = {}, {}

PT = "select p_partkey as a, p_partkey//2 as b from part where p_partkey>0"
ON = "select a, b from (select o_orderkey as a, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as b from orders) where b is not null"
UE = "select distinct a, b from (select user_id as a, lead(user_id) over (order by ts, event_id) as b, event_type from events) where b is not null and a<>b"
CLOSURE = "with recursive e as ({}), r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a) select a, b from r"


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("select distinct l_partkey, l_suppkey from lineitem")
def rel_from_vec(spark: SparkSession, d: str) -> DataFrame:
    return Relation(table(spark, d, "lineitem").select("l_partkey", "l_suppkey")).df


@query("select c_nationkey as nationkey from customer where c_acctbal < 0 union select s_nationkey from supplier where s_acctbal < 0")
def rel_merge(spark, d):
    c = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("nationkey"))
    s = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("nationkey"))
    return Relation(c).merge(Relation(s)).df


@query("select distinct o_custkey % 10 as bucket, o_orderpriority from orders")
def rel_from_map(spark, d):
    orders = table(spark, d, "orders")
    # The set isn't made distinct before the projection: the result is the same, without a shuffle of all orders.
    return Relation.from_map(Relation(orders, distinct=False), lambda o: {"bucket": o.o_custkey % 10, "o_orderpriority": o.o_orderpriority}).df


@query("select distinct o_orderkey, c_nationkey from orders join customer on o_custkey = c_custkey")
def rel_from_join(spark, d):
    orders = Relation(table(spark, d, "orders").select("o_orderkey", "o_custkey"), distinct=False)
    customers = Relation(table(spark, d, "customer").select("c_custkey", "c_nationkey"), distinct=False)
    return Relation.from_join(orders, customers, [("o_custkey", "c_custkey")], lambda o, c: {"o_orderkey": o.o_orderkey, "c_nationkey": c.c_nationkey}).df


@query("select distinct o_orderkey, o_custkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def rel_from_antijoin(spark, d):
    orders = Relation(table(spark, d, "orders").select("o_orderkey", "o_custkey"))
    returned = Relation(table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey"), distinct=False)
    return Relation.from_antijoin(orders, returned, [("o_orderkey", "l_orderkey")]).df


@query("select distinct o_custkey, l_partkey from orders join lineitem on o_orderkey = l_orderkey")
def leap_extend(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    items = ExtendWith(table(spark, d, "lineitem"), {"l_orderkey": "o_orderkey"}, ["l_partkey"])
    return Relation(leapjoin(orders, items, lambda t, v: {"o_custkey": t.o_custkey, "l_partkey": v.l_partkey})).df


@query(f"with e as ({UE}) select distinct x.a, x.b, y.b as c from e x join e y on x.b = y.a join e z on z.a = x.a and z.b = y.b")
def leap_triangle(spark, d):
    e = user_edges(spark, d)
    both = [ExtendWith(e, {"a": "b"}, ["b"]), ExtendWith(e, {"a": "a"}, ["b"])]
    return leapjoin(e, both, lambda t, v: {"a": t.a, "b": t.b, "c": v[0]})


@query(f"with e as ({UE}) select distinct x.a, x.b, y.b as c from e x join e y on x.b = y.a where x.a < x.b and not exists (select 1 from e z where z.a = x.a and z.b = y.b)")
def leap_extend_anti(spark, d):
    e = user_edges(spark, d)
    leapers = [PrefixFilter(lambda t: t.a < t.b), ExtendWith(e, {"a": "b"}, ["b"]), ExtendAnti(e, {"a": "a"}, ["b"])]
    return leapjoin(e, leapers, lambda t, v: {"a": t.a, "b": t.b, "c": v[0]})


@query(f"with e as ({UE}) select distinct x.a, x.b, y.b as c from e x join e y on x.b = y.a where not exists (select 1 from e z where z.a = x.a and z.b = y.b)")
def leap_extend_anti_all(spark, d):
    """``leap_extend_anti`` without its prefix filter."""
    e = user_edges(spark, d)
    leapers = [ExtendWith(e, {"a": "b"}, ["b"]), ExtendAnti(e, {"a": "a"}, ["b"])]
    return leapjoin(e, leapers, lambda t, v: {"a": t.a, "b": t.b, "c": v[0]})


@query(f"with e as ({UE}) select a, b from e intersect select b, a from e")
def leap_filter_with(spark, d):
    e = user_edges(spark, d)
    return leapjoin(e, FilterWith(e, {"b": "a", "a": "b"}))


@query(f"with e as ({UE}) select a, b from e except select b, a from e")
def leap_filter_anti(spark, d):
    e = user_edges(spark, d)
    return leapjoin(e, FilterAnti(e, {"b": "a", "a": "b"}))


@query(f"with e as ({UE}) select a, b from e where a < b")
def leap_prefix(spark, d):
    return leapjoin(user_edges(spark, d), PrefixFilter(lambda t: t.a < t.b))


@query(f"with e as ({UE}) select distinct x.a, y.b as c from e x join e y on x.b = y.a where x.a < x.b and x.a < y.b")
def leap_value(spark, d):
    e = user_edges(spark, d)
    leapers = [PrefixFilter(lambda t: t.a < t.b), ExtendWith(e, {"a": "b"}, ["b"]), ValueFilter(lambda t, v: t.a < v[0])]
    return Relation(leapjoin(e, leapers, lambda t, v: {"a": t.a, "c": v[0]})).df


@query(f"with e as ({UE}) select distinct x.a, y.b as c from e x join e y on x.b = y.a where x.a < y.b")
def leap_value_all(spark, d):
    """``leap_value`` without its prefix filter."""
    e = user_edges(spark, d)
    leapers = [ExtendWith(e, {"a": "b"}, ["b"]), ValueFilter(lambda t, v: t.a < v[0])]
    return Relation(leapjoin(e, leapers, lambda t, v: {"a": t.a, "c": v[0]})).df


@query(f"with e as ({UE}) select x.a, x.b from e x where x.a < x.b and exists (select 1 from e z where z.a = x.b and z.b = x.a)")
def leap_passthrough(spark, d):
    e = user_edges(spark, d)
    return leapjoin(e, [PrefixFilter(lambda t: t.a < t.b), FilterWith(e, {"a": "b", "b": "a"}), passthrough()])


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def var_semi_unit(spark, d):
    it = Iteration(spark)
    orders, kept = it.variable("orders"), it.variable("kept")
    orders.insert(table(spark, d, "orders").select("o_orderkey", "o_custkey"))
    building = Relation(table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey"))
    it.fixpoint(lambda: kept.from_semijoin(orders, building, [("o_custkey", "c_custkey")]))
    return kept.complete().df


@query(CLOSURE.format(PT))
def tc_linear_static(spark, d):
    return programs.closure(spark, part_tree(spark, d))


@query(CLOSURE.format(ON))
def tc_nonlinear(spark, d):
    return programs.closure_squared(spark, order_chains(spark, d))


@query(CLOSURE.format(PT))
def tc_leapjoin(spark, d):
    edges = part_tree(spark, d)
    it = Iteration(spark)
    paths = it.variable("paths")
    paths.insert(edges)
    it.fixpoint(lambda: paths.from_leapjoin(paths, ExtendWith(edges, {"a": "b"}, ["b"]), lambda t, v: {"a": t.a, "b": v[0]}))
    return paths.complete().df


@query(f"with recursive e as ({PT}), r as (select a, b from e where b >= 100 union select r.a, e.b from r join e on r.b = e.a where e.b >= 100) select a, b from r")
def join_filtered(spark, d):
    edges = part_tree(spark, d)
    it = Iteration(spark)
    paths = it.variable("paths")
    paths.insert(edges.where("b >= 100"))
    it.fixpoint(lambda: paths.from_join_filtered(paths, edges, [("b", "a")], lambda l, r: r.b >= 100, lambda l, r: {"a": l.a, "b": r.b}))
    return paths.complete().df


@query(f"with recursive e as ({PT}), r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a where r.b % 3 <> 0) select a, b from r")
def antijoin_rec(spark, d):
    edges = part_tree(spark, d)
    stop = Relation(edges.where("b % 3 = 0").select("b"))
    it = Iteration(spark)
    paths, going = it.variable("paths"), it.variable_indistinct("going")
    paths.insert(edges)

    def rules():
        going.from_antijoin(paths, stop, [("b", "b")])
        paths.from_join(going, edges, [("b", "a")], lambda l, r: {"a": l.a, "b": r.b})

    it.fixpoint(rules)
    return paths.complete().df


@query(
    "with recursive r as (select cast(n_nationkey as bigint) as a, cast(n_nationkey as bigint) as b from nation "
    "union select a, case when b % 2 = 0 then b // 2 else 3 * b + 1 end from r where b > 1) select a, b from r"
)
def map_collatz(spark, d):
    it = Iteration(spark)
    seen = it.variable("seen")
    key = F.col("n_nationkey").cast("long")
    seen.insert(table(spark, d, "nation").select(key.alias("a"), key.alias("b")))
    step = lambda t: {"a": t.a, "b": F.when(t.b <= 1, t.b).when(t.b % 2 == 0, F.expr("b div 2")).otherwise(3 * t.b + 1)}
    it.fixpoint(lambda: seen.from_map(seen, step))
    return seen.complete().df


_PURCHASE = UE.replace("a<>b", "a<>b and event_type = 'purchase'")


@query(f"with recursive e as ({_PURCHASE}), r as (select cast(0 as bigint) as a union select e.b from r join e on r.a = e.a) select a from r")
def reach_cyclic(spark, d):
    return programs.reachable(spark, spark.range(1).select(F.col("id").alias("a")), user_edges(spark, d, "purchase"))


_SUPPLY = "select s_suppkey + 1000 as a, s_nationkey + 100 as b from supplier union all select n_nationkey + 100, n_regionkey from nation"


@query(
    f"with recursive e as ({_SUPPLY}), r as (select x.a, y.a as b from e x join e y on x.b = y.b "
    "union select x.a, y.a from r join e x on r.a = x.b join e y on r.b = y.b) select cast(a as bigint) as a, cast(b as bigint) as b from r"
)
def same_generation(spark, d):
    """Suppliers, and nations, of one region, by the tree of suppliers, nations and regions."""
    up = lambda t, a, b: table(spark, d, t).selectExpr(f"cast({a} as long) as a", f"cast({b} as long) as b")
    tree = up("supplier", "s_suppkey + 1000", "s_nationkey + 100").union(up("nation", "n_nationkey + 100", "n_regionkey"))
    return programs.same_generation(spark, tree)


# No SQL: the pairs grow with the square of the parts, which DuckDB's recursion doesn't bear on the larger tables.
@query(None)
def same_generation_all(spark, d):
    """Parts of one generation of the tree of parts."""
    return programs.same_generation(spark, part_tree(spark, d))


@query(f"with recursive e as ({PT}), r as (select a, b, cast(1 as bigint) as par from e union select r.a, e.b, 1 - r.par from r join e on r.b = e.a) select a, b, par from r")
def mutual_parity(spark, d):
    return programs.parity(spark, part_tree(spark, d))


@query(
    f"with recursive e as (select b as a, a as b from ({PT})), r as (select cast(1 as bigint) as a union select e.b from r join e on r.a = e.a where e.b % 7 <> 0) "
    "select p_partkey as a from part where p_partkey not in (select a from r)"
)
def stratified_neg(spark, d):
    down = part_tree(spark, d).where("a % 7 <> 0").select(F.col("b").alias("a"), F.col("a").alias("b"))
    reached = Relation(programs.reachable(spark, spark.range(1, 2).select(F.col("id").alias("a")), down), distinct=False)
    parts = Relation(table(spark, d, "part").select(F.col("p_partkey").alias("a")))
    return Relation.from_antijoin(parts, reached, ["a"]).df


def _flow(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Control flow over five points, and where each region lives."""
    points = spark.range(5)
    cfg = points.select(F.col("id").alias("p"), ((F.col("id") + 1) % 5).alias("q"))
    regions = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("r"))
    live = regions.select("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("p")).where("(r + p) % 4 <> 0")
    return cfg, live


def _subset(spark, d) -> DataFrame:
    cfg, live = _flow(spark, d)
    n, g = F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("long")
    base = table(spark, d, "nation").select(n.alias("r1"), ((n + 5) % 25).alias("r2"), (g % 5).alias("p"))
    return programs.subset(spark, base, cfg, live)


_FACTS = """cfg(p, q) as (select i, (i + 1) % 5 from range(5) t(i)),
live(r, p) as (select cast(n_nationkey as bigint), i from nation, range(5) t(i) where (n_nationkey + i) % 4 <> 0),
base(r1, r2, p) as (select cast(n_nationkey as bigint), cast((n_nationkey + 5) % 25 as bigint), cast(n_regionkey % 5 as bigint) from nation)"""
_SUBSET = """s(r1, r2, p) using key (r1, r2, p) as (select r1, r2, p from base union (select d.r1, d.r2, d.p from (
  select x.r1, y.r2, x.p from s x join recurring.s y on x.r2 = y.r1 and x.p = y.p
  union select x.r1, y.r2, x.p from recurring.s x join s y on x.r2 = y.r1 and x.p = y.p
  union select x.r1, x.r2, c.q from s x join cfg c on c.p = x.p join live l on l.r = x.r1 and l.p = c.q join live m on m.r = x.r2 and m.p = c.q) d(r1, r2, p)
  where not exists (select 1 from recurring.s z where z.r1 = d.r1 and z.r2 = d.r2 and z.p = d.p)))"""


@query(f"with recursive {_FACTS}, {_SUBSET} select r1, r2, p from s")
def subset_prog(spark, d):
    return _subset(spark, d)


@query(
    f"with recursive {_FACTS}, {_SUBSET}, sub as (select r1, r2, p from s), "
    "q(r, b, p) as (select cast(n_nationkey as bigint), cast(n_regionkey as bigint), cast(n_nationkey % 5 as bigint) from nation "
    "union select u.r, u.b, u.p from (select sub.r2 as r, q.b, q.p from q join sub on sub.r1 = q.r and sub.p = q.p "
    "union all select q.r, q.b, c.q from q join cfg c on c.p = q.p join live l on l.r = q.r and l.p = c.q where (q.b + q.p) % 3 <> 0) u) select r, b, p from q"
)
def requires_prog(spark, d):
    cfg, live = _flow(spark, d)
    n, g = F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("long")
    base = table(spark, d, "nation").select(n.alias("r"), g.alias("b"), (n % 5).alias("p"))
    killed = spark.range(25).select(F.expr("id div 5").alias("b"), (F.col("id") % 5).alias("p")).where("(b + p) % 3 = 0")
    return programs.requires(spark, base, _subset(spark, d), killed, cfg, live)


@query(CLOSURE.format(PT))
def resume_insert(spark, d):
    """The closure of half the edges first, then of all, resumed from the first fixpoint."""
    all_edges = part_tree(spark, d)
    return programs.closure_resumed(spark, [all_edges.where("a % 2 = 0"), all_edges.where("a % 2 = 1")])


@query(CLOSURE.format(PT))
def indistinct_temp(spark, d):
    edges = part_tree(spark, d)
    it = Iteration(spark)
    paths, turned = it.variable("paths"), it.variable_indistinct("turned")
    paths.insert(edges)

    def rules():
        turned.from_map(paths, lambda t: {"b": t.b, "a": t.a})
        paths.from_join(turned, edges, [("b", "a")], lambda l, r: {"a": l.a, "b": r.b})

    it.fixpoint(rules)
    return paths.complete().df


@query(
    f"with e as ({UE}) select distinct x.a, x.b, y.b as c from e x join e y on x.b = y.a where x.a < x.b and y.b > x.b "
    "and exists (select 1 from e z where z.a = x.a and z.b = y.b) and not (y.b % 2 = 0 and exists (select 1 from e z where z.a = y.b and z.b = x.a)) "
    "and exists (select 1 from e z where z.a = x.b and z.b = x.a) and not exists (select 1 from e z where z.a = x.a + 1 and z.b = x.b)"
)
def leap_seven(spark, d):
    return _seven(user_edges(spark, d))


@query(SQL["leap_seven"])
def leap_seven_all(spark, d):
    """``leap_seven``, its proposer chosen by fan-out."""
    return _seven(user_edges(spark, d), by_fan_out=True)


def _seven(e: DataFrame, **how) -> DataFrame:
    """Edges through seven leapers over themselves."""
    even = e.where("a % 2 = 0").select(F.col("b").alias("k"), F.col("a").alias("v"))
    leapers = [
        ExtendWith(e, {"a": "b"}, ["b"]),
        ExtendWith(e, {"a": "a"}, ["b"]),
        ExtendAnti(even, {"k": "a"}, ["v"]),
        FilterWith(e, {"a": "b", "b": "a"}),
        FilterAnti(e, {"a": lambda t: t.a + 1, "b": "b"}),
        PrefixFilter(lambda t: t.a < t.b),
        ValueFilter(lambda t, v: v[0] > t.b),
    ]
    return leapjoin(e, leapers, lambda t, v: {"a": t.a, "b": t.b, "c": v[0]}, **how)


@query(
    f"with recursive e as ({PT}), r as (select a, b, 1 as d from e union all select r.a, e.b, d + 1 from r join e on r.b = e.a), "
    "n as (select d, count(*) as c from r group by d union all select max(d) + 1, 0 from r) "
    "select 'paths' as variable, cast(d as bigint) as round, cast(coalesce(sum(c) over (order by d rows between unbounded preceding and 1 preceding), 0) as bigint) as stable, "
    "cast(c as bigint) as recent from n"
)
def stats_trace(spark, d):
    """The rounds of the part tree's closure, from the recorded statistics."""
    out = io.StringIO()
    edges = part_tree(spark, d)
    it = Iteration(spark)
    it.record_stats_to(out)
    paths = it.variable("paths")
    paths.insert(edges)
    it.fixpoint(lambda: paths.from_join(paths, edges, [("b", "a")], lambda l, r: {"a": l.a, "b": r.b}))
    rows = [line.rsplit(",", 3) for line in out.getvalue().splitlines()[1:]]
    return spark.createDataFrame([(n.strip('"'), int(r), int(s), int(x)) for n, r, s, x in rows], "variable string, round long, stable long, recent long")


# Facts from rows, and what a relation can be asked.

_ROWS = [(1, 2), (2, 3), (2, 3), (3, 1), (5, None)]
_VALUES = "select cast(a as bigint) as a, cast(b as bigint) as b from (values (1, 2), (2, 3), (2, 3), (3, 1), (5, null)) t(a, b)"


@query(f"select distinct a, b from ({_VALUES})")
def rel_from_rows(spark, d):
    return Relation.from_rows(spark, _ROWS, "a long, b long").df


@query(f"with recursive e as ({_VALUES}), r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a) select a, b from r")
def var_extend(spark, d):
    """The closure of rows that a variable is extended with, in two parts."""
    it = Iteration(spark)
    paths, edges = it.variable("paths"), it.variable("edges")
    for part in (_ROWS[:2], [], _ROWS[2:]):
        paths.extend(part, "a long, b long")
        edges.extend(part, "a long, b long")
    it.fixpoint(lambda: paths.from_join(paths, edges, [("b", "a")], lambda l, r: {"a": l.a, "b": r.b}))
    return paths.complete().df


@query(f"select a, b from ({PT}) where b % 2 = 0")
def rel_filter(spark, d):
    return Relation(part_tree(spark, d)).filter(lambda t: t.b % 2 == 0).df


@query(f"select * from (select 'first' as what, a, b from ({PT}) order by a, b limit 1) union all select 'count', count(*), count(distinct b) from ({PT}) union all select 'has', 1, 0")
def rel_slices(spark, d):
    """The smallest row, counts, and which of two rows are there."""
    r = Relation(part_tree(spark, d))
    smallest = r.first()
    values = Relation.from_map(r, lambda t: {"b": t.b})
    rows = [("first", smallest["a"], smallest["b"]), ("count", r.count(), values.count()), ("has", int(r.contains(6, 3)), int(r.contains(3, 6)))]
    return spark.createDataFrame(rows, "what string, a long, b long")


@query("select true as same, false as other")
def rel_equality(spark, d):
    edges = part_tree(spark, d)
    r = Relation(edges)
    turned = Relation(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return spark.createDataFrame([(r.equals(Relation(edges.union(edges))), r.equals(turned))], "same boolean, other boolean")


@query(f"with e as ({UE}) select distinct x.a, y.b as c from e x join e y on x.b = y.a join e z on z.a = x.a and z.b = y.b where not exists (select 1 from e w where w.a = y.b and w.b = x.a)")
def rel_from_leapjoin(spark, d):
    """Leapers as methods of a relation."""
    e = Relation(user_edges(spark, d), distinct=False)
    turned = Relation(e.df.select(F.col("b").alias("k"), F.col("a").alias("v")), distinct=False)
    leapers = [e.extend_with({"a": "b"}, ["b"]), e.extend_with({"a": "a"}, ["b"]), turned.extend_anti({"k": "a"}, ["v"])]
    return Relation.from_leapjoin(e, leapers, lambda t, v: {"a": t.a, "c": v[0]}).df


class Steps(LeaperSpec):
    """A leaper of one's own: proposes the numbers below ``n``."""

    stage, proposes = 3, True

    def __init__(self, n: int):
        self.n = n

    def apply(self, df, t, v):
        return df.withColumn("v_step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.n - 1).cast("long")))), Side(["step"], "v_")


@query(f"select a, b, i as step from ({PT}), range(3) t(i) where (a + i) % 5 = 0")
def leap_own(spark, d):
    return leapjoin(part_tree(spark, d), [Steps(3), ValueFilter(lambda t, v: (t.a + v.step) % 5 == 0)])


_NODES = "select cast(n_nationkey as bigint) as a, cast(n_regionkey as bigint) as b from nation"


@query(f"with recursive e as ({_PURCHASE}), r as ({_NODES} union select e.b, r.b from r join e on r.a = e.a) select a, b from r")
def dataflow(spark, d):
    nodes = table(spark, d, "nation").selectExpr("cast(n_nationkey as long) as a", "cast(n_regionkey as long) as b")
    return programs.dataflow(spark, nodes, user_edges(spark, d, "purchase"))


@query(SQL["dataflow"])
def text_dataflow(spark, d):
    """``dataflow`` over facts that were written as lines of text."""
    path = f"{scratch_root(spark)}/deltaweave/{uuid.uuid4().hex}"
    nodes = table(spark, d, "nation").select(F.concat_ws("\t", F.lit(" "), "n_regionkey", "n_nationkey", F.lit("n")).alias("value"))
    edges = user_edges(spark, d, "purchase").select(F.concat_ws(" ", "a", "b", F.lit("e"), F.lit("more")).alias("value"))
    notes = spark.createDataFrame([("# a comment",), ("",), (" \t",)], "value string")
    nodes.union(edges).union(notes).write.text(path)
    n, e = text_facts(spark, path)
    return programs.dataflow(spark, n.df, e.df)


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
