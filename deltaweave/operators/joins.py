"""Equi-, semi- and anti-joins on named keys, null equal to null, left to Catalyst to execute."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.expressions import Side, all_equal, prefixed, project

Keys = Sequence[str | tuple[str, str]]


def pairs_of(on: Keys | str) -> list[tuple[str, str]]:
    return [(k, k) if isinstance(k, str) else tuple(k) for k in ([on] if isinstance(on, str) else on)]


def _sides(left: DataFrame, right: DataFrame, on: Keys | str, nulls: bool):
    a, l = prefixed(left, "l_")  # noqa: E741
    b, r = prefixed(right, "r_")
    return a, b, l, r, all_equal(a, b, [(f"l_{x}", f"r_{y}") for x, y in pairs_of(on)], nulls)


def inner(left: DataFrame, right: DataFrame, on: Keys | str, logic, where=None, nulls: bool = True) -> DataFrame:
    """``logic(l, r)`` of the pairs of rows whose keys agree, and for which ``where(l, r)`` holds.

    Null keys are equal; ``nulls`` False where one side is known to have none.
    """
    a, b, l, r, same = _sides(left, right, on, nulls)  # noqa: E741
    return project(a.join(b, same & where(l, r) if where else same), logic, l, r)


def _kept(left: DataFrame, right: DataFrame, on: Keys | str, how: str, nulls: bool) -> DataFrame:
    names = dict.fromkeys(y for _, y in pairs_of(on))
    a, b, l, _, same = _sides(left, right.select(*names), on, nulls)  # noqa: E741
    return a.join(b, same, how).select(*[l[c].alias(c) for c in left.columns])


def semi(left: DataFrame, right: DataFrame, on: Keys | str, logic=None, nulls: bool = True) -> DataFrame:
    """The rows of ``left`` whose key is in ``right``."""
    return project(_kept(left, right, on, "left_semi", nulls), logic)


def anti(left: DataFrame, right: DataFrame, on: Keys | str, logic=None, nulls: bool = True) -> DataFrame:
    """The rows of ``left`` whose key isn't in ``right``."""
    return project(_kept(left, right, on, "left_anti", nulls), logic)


def minus(left: DataFrame, right: DataFrame, nulls: bool = True) -> DataFrame:
    """Rows of ``left`` that ``right`` lacks, compared by position over all columns."""
    return anti(left, right, list(zip(left.columns, right.columns, strict=True)), nulls=nulls)


__all__ = ["Side", "anti", "inner", "minus", "pairs_of", "semi"]
