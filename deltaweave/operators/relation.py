"""Relations: static sets of rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import Side, equal, project
from ..sources.scratch import materialize
from . import joins
from .leapers import ExtendAnti, ExtendWith, FilterAnti, FilterWith, Key, leapjoin


class Relation:
    """A set of rows: no row twice, nulls equal; lazy until an action needs it.

    Order isn't kept; ``collect_sorted`` gives rows ascending, nulls first.
    """

    def __init__(self, df: DataFrame, distinct: bool = True):
        self.df = df.distinct() if distinct else df

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: Iterable, schema: str) -> Relation:
        return cls(spark.createDataFrame(list(rows), schema))

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, *columns: str) -> Relation:
        df = spark.read.parquet(path)
        return cls(df.select(*columns) if columns else df)

    @classmethod
    def from_map(cls, source: Relation, logic) -> Relation:
        return cls(project(source.df, logic))

    @classmethod
    def from_join(cls, left: Relation, right: Relation, on: joins.Keys, logic, where=None) -> Relation:
        return cls(joins.inner(left.df, right.df, on, logic, where))

    @classmethod
    def from_semijoin(cls, left: Relation, right: Relation, on: joins.Keys, logic=None) -> Relation:
        return cls(joins.semi(left.df, right.df, on, logic), distinct=logic is not None)

    @classmethod
    def from_antijoin(cls, left: Relation, right: Relation, on: joins.Keys, logic=None) -> Relation:
        return cls(joins.anti(left.df, right.df, on, logic), distinct=logic is not None)

    @classmethod
    def from_leapjoin(cls, source: Relation, leapers, logic=None) -> Relation:
        return cls(leapjoin(source.df, leapers, logic))

    def merge(self, other: Relation) -> Relation:
        """The union, columns matched by position."""
        return Relation(self.df.union(other.df))

    def pin(self) -> Relation:
        """The same set as a written table, so that what made it isn't computed again."""
        return Relation(materialize(self.df), distinct=False)

    def count(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def first(self) -> Row | None:
        """The smallest row, nulls first; None of an empty relation."""
        rows = self.df.orderBy(*[F.asc_nulls_first(f"`{c}`") for c in self.df.columns]).head(1)
        return rows[0] if rows else None

    def __iter__(self):
        """Rows ascending, brought to the driver a partition at a time."""
        return self.df.orderBy(*[F.asc_nulls_first(f"`{c}`") for c in self.df.columns]).toLocalIterator()

    def filter(self, test) -> Relation:
        """The rows for which ``test(row)``, a condition over a ``Side``, holds."""
        return Relation(self.df.where(test(Side(self.df.columns))), distinct=False)

    # Leapers over this relation.

    def extend_with(self, key: Key, values: Sequence[str]) -> ExtendWith:
        return ExtendWith(self, key, values)

    def extend_anti(self, key: Key, values: Sequence[str]) -> ExtendAnti:
        return ExtendAnti(self, key, values)

    def filter_with(self, key: Key) -> FilterWith:
        return FilterWith(self, key)

    def filter_anti(self, key: Key) -> FilterAnti:
        return FilterAnti(self, key)

    def contains(self, *values) -> bool:
        same = [equal(F.col(f"`{c}`"), F.lit(v), True) for c, v in zip(self.df.columns, values, strict=True)]
        return not self.df.where(_all(same)).isEmpty()

    def collect_sorted(self) -> list[Row]:
        return self.df.orderBy(*[F.asc_nulls_first(f"`{c}`") for c in self.df.columns]).collect()

    def equals(self, other: Relation) -> bool:
        return joins.minus(self.df, other.df).isEmpty() and joins.minus(other.df, self.df).isEmpty()

    def __repr__(self) -> str:
        return f"Relation({self.df.schema.simpleString()})"


def _all(conditions):
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
