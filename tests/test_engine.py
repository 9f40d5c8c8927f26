"""Goldens, differential tests against sets, traces, errors and nulls of the recursive engine."""

import io
import random

import pytest
from pyspark.sql import functions as F

from deltaweave import (
    ExtendAnti,
    ExtendWith,
    FilterAnti,
    FilterWith,
    Iteration,
    PrefixFilter,
    Relation,
    ValueFilter,
    leapjoin,
    passthrough,
)
from deltaweave.operators import leapers
from deltaweave.plans import catalogue, programs
from deltaweave.plans.fixpoint import Variable
from deltaweave.sources.facts import text_facts

AB = "a long, b long"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, AB)


def both_ways():
    return [(x, x + 1) for x in range(10)] + [(x + 1, x) for x in range(10)]


def closure_of(pairs):
    out = set(pairs)
    while new := {(a, d) for a, b in out for c, d in pairs if b == c} - out:
        out |= new
    return out


def trace(out):
    return [tuple(map(int, line.split(",")[2:])) for line in out.getvalue().splitlines()[1:]]


def test_join_golden_and_trace(spark):
    it, out = Iteration(spark), io.StringIO()
    it.record_stats_to(out)
    v = it.variable("source")
    v.extend(both_ways(), AB)
    it.fixpoint(lambda: v.from_join(v, v, ["a"], lambda l, r: {"a": l.b, "b": r.b}))
    assert trace(out) == [(0, 20), (20, 29), (49, 30), (79, 36), (115, 6), (121, 0)]
    assert out.getvalue().splitlines()[:2] == ["Variable,Round,Stable count,Recent count", '"source",1,0,20']
    assert v.num_stable() == 121 and v.complete().count() == 121


def test_filtered_join_golden(spark):
    it = Iteration(spark)
    v = it.variable("source")
    v.extend(both_ways(), AB)
    it.fixpoint(lambda: v.from_join_filtered(v, v, ["a"], lambda l, r: F.abs(l.b - r.b) <= 3, lambda l, r: {"a": l.b, "b": r.b}))
    assert v.complete().count() == 65


def test_antijoin_and_map_goldens(spark):
    it = Iteration(spark)
    v = it.variable("source")
    v.extend([(x, x + 1) for x in range(10)], AB)
    stop = Relation(spark.createDataFrame([(x,) for x in range(0, 10, 3)], "k long"))
    it.fixpoint(lambda: v.from_antijoin(v, stop, [("a", "k")], lambda t: {"a": t.b, "b": t.a}))
    assert v.complete().count() == 16
    it = Iteration(spark)
    v = it.variable("collatz")
    v.extend([(x, x) for x in range(10)], AB)
    step = lambda t: {"a": t.a, "b": F.when(t.b % 2 == 0, F.expr("b div 2")).otherwise(3 * t.b + 1)}
    rounds = it.fixpoint(lambda: v.from_map(v, step))
    assert v.complete().count() == 74 and rounds == 21


def test_leapjoin_goldens(spark):
    doubles = spark.createDataFrame([(i, 2 * i) for i in range(10)], AB)
    it = Iteration(spark)
    v = it.variable("v")
    v.extend([(2, 2)], AB)
    it.fixpoint(lambda: v.from_leapjoin(v, ExtendWith(doubles, {"a": "a"}, ["b"]), lambda t, x: {"a": t.a, "b": x[0]}))
    assert rows(v.complete().df) == [(2, 2), (2, 4)]
    it = Iteration(spark)
    v = it.variable("v")
    v.extend([(i, i) for i in range(10)], AB)
    it.fixpoint(lambda: v.from_leapjoin(v, [PrefixFilter(lambda t: t.a <= 20), passthrough()], lambda t, _: {"a": t.a * 2, "b": t.b * 2}))
    assert [a for a, _ in rows(v.complete().df)] == [*range(10), *range(10, 20, 2), *range(20, 41, 4)]


def test_leapers_one_by_one(spark):
    source = spark.createDataFrame([(1, 2)], AB)
    values = spark.createDataFrame([(2, 5), (2, 6)], "k long, v long")
    anti = spark.createDataFrame([(1, 6)], "k long, v long")
    extend = ExtendWith(values, {"k": "b"}, ["v"])
    assert rows(leapjoin(source, [extend, ExtendAnti(anti, {"k": "a"}, ["v"])], lambda t, v: {"v": v.v})) == [(5,)]
    assert rows(leapjoin(source, [extend, ValueFilter(lambda t, v: v.v > 5)], lambda t, v: {"v": v.v})) == [(6,)]
    assert rows(leapjoin(source, [extend, ExtendWith(anti, {"k": "a"}, ["v"])])) == [(1, 2, 6)]


@pytest.mark.parametrize("seed", range(3))
def test_formulations_agree(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(rng.randrange(1, 60))]
    other = [(rng.randrange(40), rng.randrange(40)) for _ in range(rng.randrange(1, 60))]
    e, o = edges_of(spark, pairs), edges_of(spark, other)
    want = sorted(closure_of(set(pairs)))
    assert rows(programs.closure(spark, e)) == want
    assert rows(programs.closure_squared(spark, e)) == want
    assert rows(Relation(leapjoin(e, FilterWith(o, {"a": "a", "b": "b"}))).df) == sorted(set(pairs) & set(other))
    assert rows(Relation(leapjoin(e, FilterAnti(o, {"a": "a", "b": "b"}))).df) == sorted(set(pairs) - set(other))
    joined = Relation.from_join(Relation(e), Relation(o), ["a"], lambda l, r: {"k": l.a, "v": l.b * 100 + r.b})
    assert rows(joined.df) == sorted({(a, b * 100 + d) for a, b in pairs for c, d in other if a == c})
    assert rows(Relation(e).merge(Relation(o)).df) == sorted(set(pairs) | set(other))


@pytest.mark.parametrize("large", [1, 60, 10**9])
def test_bucketed_batches_and_unwritten_steps(spark, monkeypatch, large):
    from deltaweave.plans import fixpoint

    monkeypatch.setattr(fixpoint, "_LARGE", large)
    pairs = [(a, a // 2) for a in range(1, 64)] + [(None, 63), (1, None)]
    it = Iteration(spark)
    paths, turned, again = it.variable("paths"), it.variable_indistinct("turned"), it.variable_indistinct("again")
    paths.extend(pairs, AB)

    def rules():
        turned.from_map(paths, lambda t: {"b": t.b, "a": t.a})
        again.from_map(turned, lambda t: {"b": t.b, "a": t.a})
        paths.from_join(again, edges_of(spark, pairs), [("b", "a")], lambda l, r: {"a": l.a, "b": r.b})

    it.fixpoint(rules)
    got = {tuple(r) for r in paths.complete().df.collect()}
    assert got == closure_of(set(pairs)) and turned.num_stable() > 0 and turned.num_recent() == 0


def test_nulls_reach_the_fixpoint(spark):
    it, out = Iteration(spark), io.StringIO()
    it.record_stats_to(out)
    v = it.variable("v")
    v.extend([(1, None), (2, None), (None, 3)], AB)
    it.fixpoint(lambda: v.from_map(v, lambda t: {"a": t.a, "b": t.b}), max_rounds=5)
    assert trace(out) == [(0, 3), (3, 0)]
    null = Relation(spark.createDataFrame([(None,)], "k long"))
    left = Relation(spark.createDataFrame([(None, 1), (2, 2)], AB))
    assert rows(Relation.from_antijoin(left, null, [("a", "k")]).df) == [(2, 2)]
    assert Relation.from_semijoin(left, null, [("a", "k")]).count() == 1
    assert left.contains(None, 1) and not left.contains(None, 2)


def test_proposer_by_fan_out(spark):
    source = spark.createDataFrame([(1, 7)], "s long, k long")
    wide = Relation(spark.createDataFrame([(1, v) for v in range(50)], "k long, w long"))
    slim = Relation(spark.createDataFrame([(7, 3), (7, 99)], "k long, n long"))
    leapers = [wide.extend_with({"k": "s"}, ["w"]), slim.extend_with({"k": "k"}, ["n"])]
    for how in (False, True):
        df = leapjoin(source, leapers, lambda t, v: {"k": t.k, "w": v.w}, by_fan_out=how)
        assert rows(df) == [(7, 3)]
    assert leapers[0].fan_out() == 50 and leapers[1].fan_out() == 2
    assert list(wide)[0]["w"] == 0 and wide.first()["w"] == 0 and wide.filter(lambda t: t.w > 47).count() == 2
    assert Relation.from_rows(spark, [], AB).first() is None


def test_proposed_values_are_not_shuffled(spark, monkeypatch, capsys):
    """The inner join and the checks run in cells: between them and the dealt inputs there is no exchange."""
    monkeypatch.setattr(leapers, "_SMALL", 0)
    monkeypatch.setattr(leapers, "_SHARES", 2)
    rng = random.Random(4)
    node = lambda: rng.choice([None, *range(12)])
    pairs = list({(node(), node()) for _ in range(90)})
    e = edges_of(spark, pairs)
    turned = e.select(F.col("b").alias("k"), F.col("a").alias("v"))
    extend, semi, anti = ExtendWith(e, {"a": "b"}, ["b"]), ExtendWith(e, {"a": "a"}, ["b"]), ExtendAnti(turned, {"k": "a"}, ["v"])
    row = lambda t, v: {"a": t.a, "b": t.b, "c": v[0]}
    edges = set(pairs)
    two = [(a, b, c) for a, b in pairs for x, c in pairs if x == b]
    cases = [
        ([extend, semi], [r for r in two if (r[0], r[2]) in edges]),
        ([extend, anti], [r for r in two if (r[2], r[0]) not in edges]),
        ([extend, semi, anti], [r for r in two if (r[0], r[2]) in edges and (r[2], r[0]) not in edges]),
        ([PrefixFilter(lambda t: t.a < 6), anti, extend, semi, ExtendAnti(e, {"a": "b"}, ["b"])], []),  # the last has a key of its own
    ]
    order = lambda found: sorted(found, key=str)
    for chosen, want in cases:
        df = leapjoin(e, chosen, row)
        capsys.readouterr()
        df.explain()
        joins = [line for line in capsys.readouterr().out.splitlines() if "Join" in line or "Exchange" in line]
        if want:
            assert all("Join" in line for line in joins[: len(chosen)]) and sum("Exchange" in line for line in joins) == len(chosen) + 1
        assert order(tuple(r) for r in df.collect()) == order(want)
    # The fan-out's choice, values under two names, several values, a key of two columns, repeated rows, types that differ.
    assert order(tuple(r) for r in leapjoin(e, [semi, extend], row, by_fan_out=True).collect()) == order(cases[0][1])
    wide = e.select("a", "b", (F.col("a") + 1).alias("c"), F.col("b").alias("d"))
    narrow = turned.select(F.col("k").cast("int").alias("k"), "v")
    for small in (turned, narrow):
        got = leapjoin(e.union(e.limit(0)), [extend, ExtendAnti(small, {"k": "a"}, ["v"])], row)
        assert order(tuple(r) for r in got.collect()) == order(cases[1][1])
    both = [ExtendWith(wide, {"a": "b"}, ["c", "d"]), ExtendWith(wide, {"b": "b", "a": "a"}, ["c", "d"])]
    facts = {(a, b, None if a is None else a + 1, b) for a, b in pairs}
    want = [(a, b, c, d) for a, b in pairs for x, _, c, d in facts if x == b and (a, b, c, d) in facts]
    assert order(tuple(r) for r in leapjoin(e, both, lambda t, v: {"a": t.a, "b": t.b, "c": v[0], "d": v[1]}).collect()) == order(want)
    twice = leapjoin(e.union(e), [extend, semi], row)
    assert order(tuple(r) for r in twice.collect()) == order(2 * cases[0][1])


def test_relation_is_a_set(spark):
    r = Relation.from_rows(spark, [(2, 1), (1, 1), (2, 1)], AB)
    assert r.count() == 2 and [tuple(x) for x in r.collect_sorted()] == [(1, 1), (2, 1)]
    assert r.equals(Relation.from_rows(spark, [(1, 1), (2, 1)], AB)) and not r.is_empty()
    assert not r.equals(Relation.from_rows(spark, [(1, 1)], AB)) and r.pin().count() == 2
    assert Relation.from_map(r, lambda t: {"b": t.b}).count() == 1


def test_resume_and_states(spark):
    it = Iteration(spark)
    v = it.variable("v")
    assert v.is_stable() and v.complete().is_empty()
    body = lambda: v.from_join(v, v, ["a"], lambda l, r: {"a": l.b, "b": r.b})
    v.extend([(x, x + 1) for x in range(10)], AB)
    with pytest.raises(RuntimeError):
        v.complete()
    it.fixpoint(body)
    v.extend([], AB)
    v.insert(spark.createDataFrame([], AB))
    assert v.is_stable()
    v.extend([(x + 1, x) for x in range(10)], AB)
    it.fixpoint(body)
    assert v.complete().count() == 121 and v.num_stable() == 0


def test_resumed_closure_takes_few_rounds(spark, monkeypatch, tmp_path):
    """Four edges a round: the tree of parts of depth 12 by single edges takes 12 rounds and more after each half."""
    rounds, changed = [], Iteration.changed
    monkeypatch.setattr(Iteration, "changed", lambda it: rounds.append(1) or changed(it))
    spark.range(2, 4100).select(F.col("id").alias("p_partkey")).write.parquet(str(tmp_path / "part.parquet"))
    got = catalogue.queries()["resume_insert"](spark, str(tmp_path))
    assert len(rounds) <= 16
    assert set(map(tuple, got.collect())) == {(a, a >> k) for a in range(2, 4100) for k in range(1, a.bit_length() + 1) if (a >> (k - 1)) > 1}
    pairs = [(n, n + 1) for n in range(11)] + [(11, 3), (5, 5), (20, None), (None, 0)]
    closed = programs.closure_resumed(spark, [edges_of(spark, pairs[k::3]) for k in range(3)])
    assert set(map(tuple, closed.collect())) == closure_of(pairs) and closed.count() == len(closure_of(pairs))


def test_squared_closure_derives_a_way_once(spark, monkeypatch):
    """All pairs of a chain are derived from one cut each; with loops and nulls the closure is whole."""
    derived, insert = [], Variable.insert
    monkeypatch.setattr(Variable, "insert", lambda v, df: derived.append(df.count()) or insert(v, df))
    chain = [(n, n + 1) for n in range(21)]
    assert programs.closure_squared(spark, edges_of(spark, chain)).count() == 21 * 22 // 2
    assert sum(derived) == 21 * 22 // 2
    monkeypatch.undo()
    for pairs in ([(n, n + 1) for n in range(7)] + [(7, 2), (4, 4), (9, None), (None, 0)], [(None, None)], []):
        closed = programs.closure_squared(spark, edges_of(spark, pairs + pairs[:2])).collect()
        assert len(closed) == len(closure_of(pairs)) and set(map(tuple, closed)) == closure_of(pairs)


def test_indistinct_repeats_but_completes_as_a_set(spark):
    it = Iteration(spark)
    v = it.variable_indistinct("v")
    v.extend([(1, 1), (1, 1)], AB)
    with pytest.raises(RuntimeError):
        it.fixpoint(lambda: v.from_map(v, lambda t: {"a": t.a, "b": t.b}), max_rounds=3)
    assert v.num_recent() == 1
    while it.changed():
        pass
    assert v.complete().count() == 1


def test_errors(spark):
    e = spark.createDataFrame([(1, 2)], AB)
    for alone in (ExtendAnti(e, {"a": "a"}, ["b"]), ValueFilter(lambda t, v: F.lit(True)), passthrough()):
        with pytest.raises(ValueError):
            leapjoin(e, alone)
    with pytest.raises(ValueError):
        leapjoin(e, [FilterWith(e, {"a": "a"}), PrefixFilter(lambda t: t.a > 0)])
    for keyless in (lambda: ExtendWith(e, {}, ["b"]), lambda: Relation.from_join(Relation(e), Relation(e), [], lambda l, r: {"a": l.a})):
        with pytest.raises(ValueError):
            keyless()
    v = Iteration(spark).variable("v")
    v.insert(e)
    with pytest.raises(TypeError):
        v.insert(e.select("a"))
    with pytest.raises(TypeError):
        v.from_antijoin(v, v, ["a"])


def test_text_facts_and_dataflow(spark, tmp_path):
    path = tmp_path / "facts.txt"
    path.write_text("# c\n\n \t\n\t1\t2 n\n2 3 e extra\n3 4\te\t\n")
    nodes, edges = text_facts(spark, str(path))
    assert rows(nodes.df) == [(2, 1)] and rows(edges.df) == [(2, 3), (3, 4)]
    assert rows(programs.dataflow(spark, nodes.df, edges.df)) == [(2, 1), (3, 1), (4, 1)]
    path.write_text("1 2 x\n")
    with pytest.raises(Exception, match="unknown type"):
        text_facts(spark, str(path))[0].df.collect()


def generations_of(pairs):
    out = new = {(a, c) for a, b in pairs for c, d in pairs if b == d}
    while new:
        new = {(a, c) for a, b in pairs for c, d in pairs if (b, d) in new} - out
        out = out | new
    return out


@pytest.mark.parametrize("block", [3, 8192])
def test_same_generation_by_classes(spark, monkeypatch, block):
    """Trees, a cycle with tails, and nulls, without a variable; a child of two parents by the fixpoint."""
    monkeypatch.setattr(programs, "_BLOCK", block)
    trees = [(n, n // 2) for n in range(1, 40)] + [(100 + n, 99 + n) for n in range(1, 12)] + [(300, 100), (200, 100), (None, 200), (201, None)]
    cycle = [(n, (n + 1) % 5 + 400) for n in range(400, 405)] + [(410, 400), (411, 410), (412, 411), (413, 403), (414, 413)]
    two = [(2, 1), (3, 1), (3, 2), (4, 3), (5, 2)]
    with monkeypatch.context() as m:
        m.setattr(programs, "Iteration", None)
        for pairs in (trees, cycle, trees + cycle, [(7, 7)], trees[:1]):
            assert set(programs.same_generation(spark, edges_of(spark, pairs + pairs[:3])).collect()) == generations_of(pairs)
            assert programs.same_generation(spark, edges_of(spark, pairs)).count() == len(generations_of(pairs))
        assert programs.same_generation(spark, spark.createDataFrame([], AB)).count() == 0
    assert set(programs.same_generation(spark, edges_of(spark, two)).collect()) == generations_of(two)


def shuffled(spark, run):
    """Bytes that the stages of ``run`` shuffle."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = total()
    run()
    return total() - before


def test_pairs_shuffle_in_proportion(spark, monkeypatch):
    """Twice the members of a class are four times the pairs, but about twice the bytes sent."""
    monkeypatch.setattr(programs, "_BLOCK", 8)
    sizes = []
    for n in (2000, 4000):
        pairs = programs.same_generation(spark, spark.range(1, n + 1).selectExpr("id as a", "0L as b"))
        sizes.append(shuffled(spark, lambda: pairs.write.format("noop").mode("overwrite").save()))
        count, both = pairs.agg(F.count(F.lit(1)), F.sum(F.col("a") * F.col("b"))).first()
        assert (count, both) == (n * n, (n * (n + 1) // 2) ** 2)
    assert 0 < sizes[1] < 2.6 * sizes[0]


def test_stream_maintenance(spark, tmp_path):
    from deltaweave.streaming.maintain import into

    src = tmp_path / "in"
    it = Iteration(spark)
    paths, edges = it.variable("paths"), it.variable("edges")

    def body():
        paths.from_map(edges, None)
        paths.from_join(paths, edges, [("b", "a")], lambda l, r: {"a": l.a, "b": r.b})

    for k, pair in enumerate([(1, 2), (2, 3), (0, 1)]):
        spark.createDataFrame([pair], AB).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(AB).parquet(str(src))
        q = stream.writeStream.foreachBatch(into(edges, it, body)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert rows(paths.complete().df) == sorted(closure_of({(1, 2), (2, 3), (0, 1)}))
