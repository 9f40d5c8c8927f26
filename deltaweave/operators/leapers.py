"""Multi-way leapjoins: a source extended with values that several relations agree on.

A leapjoin's result is declarative: rows t of the source that pass the prefix
filters and the tuple filters, with each value v that all extenders propose for
t, no anti-extender lists, and the value filters accept. It is compiled to one
chain of filters, semi-, anti- and inner joins for Catalyst: what can drop a row
of the source comes first, then one inner join, then semi-joins on (key, value).
Where the relations aren't small, the inner join and the semi- and anti-joins of its
values run in cells, so that what is proposed is never shuffled (see ``_in_cells``).

Keys are dicts from a relation's column to what it must equal: a column name of
the source or a callable of its ``Side``. Values are the relation's columns that
are proposed; logic sees them as ``v[0]``, ``v[1]`` or by the first extender's names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import Side, equal, project

Key = Mapping[str, str | Callable[[Side], Column]]

#: Relations of at most this many rows are joined as they are; Catalyst broadcasts them.
_SMALL = 200_000
#: Shares of the rows by each of a cell's three hashes, at least; and rows of a relation in a cell on average, at most.
_SHARES, _CELL_ROWS = 5, 1_500_000


class LeaperSpec:
    """A participant; subclass it and override ``apply`` for one of your own."""

    #: Order of application; and whether it proposes values, and may stand alone.
    stage, proposes, alone = 0, False, True

    def apply(self, df: DataFrame, t: Side, v: Side | None) -> tuple[DataFrame, Side | None]:
        raise NotImplementedError


def _frame(relation) -> DataFrame:
    return getattr(relation, "df", relation)


class _Keyed(LeaperSpec):
    def __init__(self, relation, key: Key, values: Sequence[str] = ()):
        if not key:
            raise ValueError(f"{type(self).__name__} needs a key; without one every row would meet every other")
        self.relation, self.key, self.values = _frame(relation), dict(key), list(values)

    def fan_out(self) -> float:
        """Rows of the relation for each of its keys, on average; one pass with partial aggregation."""
        keys = self.relation.select(*[F.col(f"`{c}`") for c in self.key])
        n, d = keys.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct(*[F.col(f"`{c}`") for c in self.key]))).first()
        return n / max(1, d)

    def joined(self, df: DataFrame, t: Side, v: Side | None, how: str) -> tuple[DataFrame, DataFrame, Column]:
        names = list(dict.fromkeys([*self.key, *self.values]))
        right = self.relation.select(*[F.col(f"`{c}`").alias(f"x_{c}") for c in names])
        same = F.lit(True)
        for name, what in self.key.items():
            wanted = what(t) if callable(what) else t[what]
            same = same & equal(wanted, F.col(f"`x_{name}`"), self.relation.schema[name].nullable)
        for k, name in enumerate(self.values):
            if v is not None:
                same = same & equal(v[k], F.col(f"`x_{name}`"), self.relation.schema[name].nullable)
        return df, right, same


class PrefixFilter(LeaperSpec):
    """Keeps the source rows for which ``test(t)`` holds."""

    stage = 0

    def __init__(self, test: Callable[[Side], Column]):
        self.test = test

    def apply(self, df, t, v):
        return df.where(self.test(t)), v


class FilterWith(_Keyed):
    """Keeps the source rows whose key is in the relation."""

    stage = 1

    def apply(self, df, t, v):
        left, right, same = self.joined(df, t, None, "semi")
        return left.join(right, same, "left_semi"), v


class FilterAnti(_Keyed):
    """Drops the source rows whose key is in the relation."""

    stage = 2

    def apply(self, df, t, v):
        left, right, same = self.joined(df, t, None, "anti")
        return left.join(right, same, "left_anti"), v


class ExtendWith(_Keyed):
    """Proposes the relation's values for the row's key; after the first, keeps those that it has too."""

    stage, proposes = 3, True

    def apply(self, df, t, v):
        left, right, same = self.joined(df, t, v, "extend")
        if v is not None:
            return left.join(right, same, "left_semi"), v
        names = [f"v_{c}" for c in self.values]
        wide = left.join(right, same)
        kept = [F.col(f"`{c}`") for c in df.columns] + [F.col(f"`x_{c}`").alias(n) for c, n in zip(self.values, names, strict=True)]
        return wide.select(*kept), Side(self.values, "v_")


class Passthrough(LeaperSpec):
    """Proposes the empty value once, so that filters alone are a leapjoin."""

    stage, proposes, alone = 4, True, False

    def apply(self, df, t, v):
        return df, v


class ExtendAnti(_Keyed):
    """Drops the values that the relation lists for the row's key."""

    stage, alone = 5, False

    def apply(self, df, t, v):
        left, right, same = self.joined(df, t, v, "anti")
        return left.join(right, same, "left_anti"), v


class ValueFilter(LeaperSpec):
    """Keeps the pairs for which ``test(t, v)`` holds."""

    stage, alone = 6, False

    def __init__(self, test: Callable[[Side, Side], Column]):
        self.test = test

    def apply(self, df, t, v):
        return df.where(self.test(t, v if v is not None else Side([]))), v


def passthrough() -> Passthrough:
    return Passthrough()


def _cheapest_first(leapers: list[LeaperSpec]) -> list[LeaperSpec]:
    """The proposers in order of their fan-out, where there are several and they can tell."""
    own = [k for k, x in enumerate(leapers) if isinstance(x, ExtendWith)]
    if len(own) < 2:
        return leapers
    ranked = sorted((leapers[k] for k in own), key=lambda x: x.fan_out())
    out = list(leapers)
    for k, x in zip(own, ranked, strict=True):
        out[k] = x
    return out


def _sharing(df: DataFrame, t: Side, leapers: list[LeaperSpec]) -> tuple[ExtendWith | None, list[_Keyed]]:
    """The proposer, and the leapers that check its values under one and the same key of the source.

    None check where types differ, as equal values must have equal hashes, or a leaper isn't one of this module's.
    """
    first = next((x for x in leapers if isinstance(x, ExtendWith)), None)
    if first is None or any(type(x).__module__ != __name__ for x in leapers):
        return first, []
    hashed = lambda types: all(isinstance(x, T.IntegralType | T.DateType | T.TimestampType) or x == T.StringType() for x in types)
    types = lambda frame, names: [frame.schema[c].dataType for c in names]
    wanted = [f.dataType for f in df.select(*[what(t) if callable(what) else t[what] for what in first.key.values()]).schema]
    values = types(first.relation, first.values)
    if not values or not hashed(wanted + values) or wanted != types(first.relation, first.key):
        return first, []
    checks = []
    for x in leapers:
        if x is first or not isinstance(x, ExtendWith | ExtendAnti) or any(callable(what) for what in x.key.values()):
            continue
        of_source = types(df, [f"t_{what}" for what in x.key.values()])
        same_key = not checks or sorted(x.key.values()) == sorted(checks[0].key.values())
        if same_key and hashed(of_source) and of_source == types(x.relation, x.key) and values == types(x.relation, x.values):
            checks.append(x)
    return first, checks


def _in_cells(df: DataFrame, t: Side, first: ExtendWith, checks: list[_Keyed], rows: int) -> tuple[DataFrame, Side]:
    """The values that ``first`` proposes and ``checks`` accept, without a shuffle of those proposed.

    A cell is three hashes: of the proposer's key, of the checks' key and of the values.
    A row of the source knows the first two and goes to all cells that have them, a row of the
    proposer's relation knows the first and third, one of a checked relation the last two.
    So a proposed value meets all that accept or drop it in its cell: the source is streamed
    through joins with hash tables of at most about ``_CELL_ROWS`` rows each.
    """
    shares = max(_SHARES, math.ceil(math.sqrt(rows / _CELL_ROWS)))
    share = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(shares)).cast("int")

    def dealt(frame, key, checked, value, cell):
        known = [F.col("every") if part is None else share(part) for part in (key, checked, value)]
        frame = frame.withColumn("every", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        frame = frame.withColumn(cell, (known[0] * shares + known[1]) * shares + known[2]).drop("every")
        return frame.repartitionById(shares**3, cell)

    of = lambda names: [F.col(f"`x_{c}`") for c in names]
    wanted = [what(t) if callable(what) else t[what] for what in first.key.values()]
    in_cell = F.col("cell") == F.col("cell_of_x")
    left, right, same = first.joined(dealt(df, wanted, [t[what] for what in sorted(checks[0].key.values())], None, "cell"), t, None, "extend")
    right = dealt(right, of(first.key), None, of(first.values), "cell_of_x").hint("shuffle_hash")
    proposed = [F.col(f"`x_{c}`").alias(f"v_{c}") for c in first.values]
    df = left.join(right, in_cell & same).select(*[F.col(f"`{c}`") for c in left.columns], *proposed)
    v = Side(first.values, "v_")
    for x in checks:
        left, right, same = x.joined(df, t, v, "check")
        right = dealt(right, None, of(sorted(x.key, key=lambda name: x.key[name])), of(x.values), "cell_of_x").hint("shuffle_hash")
        df = left.join(right, in_cell & same, "left_semi" if isinstance(x, ExtendWith) else "left_anti")
    return df.drop("cell"), v


def leapjoin(source: DataFrame, leapers: LeaperSpec | Sequence[LeaperSpec], logic=None, by_fan_out: bool = False) -> DataFrame:
    """``logic(t, v)`` of the rows and values that all leapers accept (as rows; the caller makes them a set).

    With ``by_fan_out`` the extender with the fewest values for a key proposes, whatever
    its place in the list, which takes a pass over each extender's relation; else the first.
    Without logic the source's columns and the values are returned. A single
    leaper that can't stand alone, or several of which none proposes values, is a
    ``ValueError`` here, before anything runs.
    """
    leapers = [leapers] if isinstance(leapers, LeaperSpec) else list(leapers)
    if not leapers:
        raise ValueError("a leapjoin needs a leaper")
    if len(leapers) == 1 and not leapers[0].alone:
        raise ValueError(f"{type(leapers[0]).__name__} can't be the only leaper")
    if len(leapers) > 1 and not any(x.proposes for x in leapers):
        raise ValueError("none of the leapers proposes values; add passthrough() for filters alone")
    source = _frame(source)
    named = next((x.values for x in leapers if isinstance(x, ExtendWith)), [])
    if by_fan_out:
        leapers = _cheapest_first(leapers)
    df = source.select(*[F.col(f"`{c}`").alias(f"t_{c}") for c in source.columns])
    t, v = Side(source.columns, "t_"), None
    leapers = sorted(leapers, key=lambda x: x.stage)
    first, checks = _sharing(df, t, leapers)
    rows = max(r.count() for r in {id(x.relation): x.relation for x in (first, *checks)}.values()) if checks else 0
    checks = checks if rows > _SMALL else []
    for leaper in leapers:
        if any(leaper is x for x in checks):
            continue
        df, v = _in_cells(df, t, first, checks, rows) if checks and leaper is first else leaper.apply(df, t, v)
        if isinstance(leaper, ExtendWith) and v is not None and v._names != named:
            # Values go by the names of the first extender that was given, whichever proposes.
            kept = [c for c in df.columns if not c.startswith("v_")]
            df = df.select(*[F.col(f"`{c}`") for c in kept], *[v[k].alias(f"v_{n}") for k, n in enumerate(named)])
            v = Side(named, "v_")
    if logic is None:
        names = [] if v is None else v._names
        logic = lambda t, v: {c: t[c] for c in source.columns} | {c: v[c] for c in names}
    return project(df, logic, t, v if v is not None else Side([]))
