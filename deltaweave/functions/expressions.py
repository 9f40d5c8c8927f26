"""User logic as Spark expressions: sides of a join, projections and null-safe keys.

``logic`` is what a rule makes of its inputs: a callable that gets one ``Side``
for each input and returns a dict of names to columns; or a list of SQL strings
or columns over the input's own names (where there is one input).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Side:
    """Columns of one input by name: ``side.a`` or ``side["a"]``; by position: ``side[0]``."""

    def __init__(self, names: Sequence[str], prefix: str = ""):
        self._names, self._prefix = list(names), prefix

    def __getitem__(self, name: str | int) -> Column:
        name = self._names[name] if isinstance(name, int) else name
        if name not in self._names:
            raise KeyError(f"no column {name!r} among {self._names}")
        return F.col(f"`{self._prefix}{name}`")

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]


def prefixed(df: DataFrame, prefix: str) -> tuple[DataFrame, Side]:
    """``df`` with every column renamed, so that a self-join has no name twice."""
    return df.select(*[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in df.columns]), Side(df.columns, prefix)


def columns_of(made: Mapping[str, Column | str] | Sequence[Column | str]) -> list[Column]:
    if isinstance(made, Mapping):
        return [(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in made.items()]
    return [F.expr(c) if isinstance(c, str) else c for c in made]


def project(df: DataFrame, logic, *sides: Side) -> DataFrame:
    """Apply ``logic`` to ``df``; None keeps it as it is."""
    if logic is None:
        return df
    made = logic(*(sides or (Side(df.columns),))) if isinstance(logic, Callable) else logic
    return df.select(*columns_of(made))


def equal(left: Column, right: Column, nullable: bool) -> Column:
    """Equality under which null equals null; the plain operator where there is no null, as its plan is cheaper."""
    return left.eqNullSafe(right) if nullable else left == right


def nullable(df: DataFrame, name: str) -> bool:
    return df.schema[name].nullable


def all_equal(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], nulls: bool = True) -> Column:
    """The condition that the named columns of two frames without common names agree.

    ``nulls`` False says that one of the sides is known to have none, as its
    schema may not: then the plain operator gives the same pairs.
    """
    if not pairs:
        raise ValueError("a join needs a key; without one every row would meet every other")
    each = [equal(F.col(f"`{x}`"), F.col(f"`{y}`"), nulls and nullable(left, x) and nullable(right, y)) for x, y in pairs]
    return reduce(lambda a, b: a & b, each)
