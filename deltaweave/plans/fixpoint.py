"""Variables that grow to a fixpoint, round by round, joining only what is new.

A variable has three stages: rows to be added, recent rows (new in this round)
and stable rows. Rules read the stages of this round and only add; nothing that
they add is seen before the next ``changed()``. Each advance is one Spark job: the
rows to add, made distinct, without those already stable, are written as a table,
counted in the same pass. Stable batches are lists of written tables; merging them is
bookkeeping until they are many small files. A merged batch of ``_LARGE`` rows or more
is bucketed by all columns, and new rows are then dealt out likewise: a bucket is
compared with its own bucket, and the bulk of the stable rows is never shuffled again.

An indistinct variable's new rows aren't compared with anything, so they aren't
written either, unless they are counted or derive from many such: the rules that read
them make one job of both. Whether there are any is seen where a distinct variable
takes them in.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import IO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.expressions import project
from ..operators import joins
from ..operators.leapers import leapjoin
from ..operators.relation import Relation
from ..sources.scratch import dealt, delete, write_bucketed, write_counted

#: More tables than this in one batch are rewritten as one.
_MANY = 48
#: Rows of a batch that is worth a bucketed table.
_LARGE = 5_000_000
#: Unwritten steps on top of each other, at most.
_DEEP = 3


@dataclass
class _Batch:
    df: DataFrame
    rows: int | None = None  # None: not written, not counted
    nulls: bool = True
    paths: tuple[str, ...] = ()  # of plain tables
    table: str | None = None  # of a bucketed one
    depth: int = 0


class Variable:
    """Made by ``Iteration.variable``; handles are shared, as any Python object."""

    def __init__(self, spark: SparkSession, name: str, distinct: bool = True):
        self.spark, self.name, self.distinct = spark, name, distinct
        self.schema: T.StructType | None = None
        self._to_add: list[DataFrame] = []
        self._depth = 0  # unwritten steps below what is to be added
        self._recent: _Batch | None = None
        self._stable: list[_Batch] = []
        self._replaced: list[_Batch] = []
        self.counted = distinct

    # What can be read.

    def _read(self, batches: list[_Batch]) -> DataFrame | None:
        paths = [p for b in batches for p in b.paths]
        frames = [b.df for b in batches if not b.paths]
        if paths:
            frames.append(self.spark.read.schema(self.schema).parquet(*paths) if len(batches) > 1 else batches[0].df)
        return reduce(DataFrame.union, frames) if frames else None

    def _nulls(self) -> bool:
        return bool(self._recent and self._recent.nulls) or any(b.nulls for b in self._stable)

    @property
    def recent(self) -> DataFrame | None:
        """Rows new in this round; None if there are none."""
        return self._recent.df if self._recent else None

    @property
    def stable(self) -> DataFrame | None:
        """Rows of earlier rounds; None if there are none."""
        return self._read(self._stable)

    def stable_batches(self) -> list[DataFrame]:
        return [b.df for b in self._stable]

    def _count(self, batch: _Batch) -> int:
        if batch.rows is None:
            vars(batch).update(vars(self._write(batch.df)))
        return batch.rows

    def num_stable(self) -> int:
        """Rows in stable batches, from their counts; a job only where an indistinct variable's were never written."""
        return sum(self._count(b) for b in self._stable)

    def num_recent(self) -> int:
        return self._count(self._recent) if self._recent else 0

    def is_stable(self) -> bool:
        """Nothing recent and nothing to add; true of a fresh variable, and where only empty frames were inserted."""
        if not self._recent and self._to_add:
            self._to_add = [df for df in self._to_add if not df.isEmpty()]
        return not self._recent and not self._to_add

    # What adds rows.

    def insert(self, rows: Relation | DataFrame) -> None:
        """Add rows; types must be those of the first insert, by position."""
        df = getattr(rows, "df", rows)
        if self.schema is None:
            self.schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
        elif [f.dataType for f in df.schema.fields] != [f.dataType for f in self.schema.fields]:
            raise TypeError(f"variable {self.name!r} holds {self.schema.simpleString()}, not {df.schema.simpleString()}")
        self._to_add.append(df.toDF(*self.schema.names))

    def _derive(self, df: DataFrame, *sources: Variable) -> None:
        self.insert(df)
        self._depth = max(self._depth, *[v._recent.depth + 1 if v._recent else 0 for v in sources], *[b.depth + 1 for v in sources for b in v._stable])

    def extend(self, rows, schema: str | None = None) -> None:
        """Add Python rows; nothing happens where there are none."""
        rows = list(rows)
        if rows:
            self.insert(self.spark.createDataFrame(rows, schema or self.schema))

    def from_map(self, source: Variable, logic) -> None:
        if source.recent is not None:
            self._derive(project(source.recent, logic), source)

    def from_join(self, left: Variable, right: Variable | Relation | DataFrame, on: joins.Keys, logic, where=None) -> None:
        """Pairs of rows with equal keys, at least one of them new; a relation's rows are all old."""
        if not isinstance(right, Variable):
            if left.recent is not None:
                self._derive(joins.inner(left.recent, getattr(right, "df", right), on, logic, where, left._recent.nulls), left)
            return
        nulls = left._nulls() and right._nulls()
        all_right = right._read([*right._stable, *([right._recent] if right._recent else [])])
        if left.recent is not None and all_right is not None:
            self._derive(joins.inner(left.recent, all_right, on, logic, where, nulls), left, right)
        if left.stable is not None and right.recent is not None:
            self._derive(joins.inner(left.stable, right.recent, on, logic, where, nulls), left, right)

    def from_join_filtered(self, left: Variable, right, on: joins.Keys, where, logic) -> None:
        """``from_join`` of the pairs for which ``where(l, r)`` holds."""
        self.from_join(left, right, on, logic, where)

    def from_semijoin(self, left: Variable, keys: Relation | DataFrame, on: joins.Keys, logic=None) -> None:
        if left.recent is not None:
            self._derive(joins.semi(left.recent, getattr(keys, "df", keys), on, logic, left._recent.nulls), left)

    def from_antijoin(self, left: Variable, keys: Relation | DataFrame, on: joins.Keys, logic=None) -> None:
        """New rows whose key isn't in a relation. A variable can't be negated: complete it first."""
        if isinstance(keys, Variable):
            raise TypeError("only a relation can be negated; complete the variable in a stratum of its own")
        if left.recent is not None:
            self._derive(joins.anti(left.recent, getattr(keys, "df", keys), on, logic, left._recent.nulls), left)

    def from_leapjoin(self, source: Variable, leapers, logic=None) -> None:
        if source.recent is not None:
            self._derive(leapjoin(source.recent, leapers, logic), source)

    def complete(self) -> Relation:
        """All rows, once nothing is recent or to be added; the variable is empty then."""
        if not self.is_stable():
            raise RuntimeError(f"variable {self.name!r} isn't at its fixpoint")
        df = self.stable
        self._stable = []
        if df is None:
            df = self.spark.createDataFrame([], self.schema or T.StructType())
        return Relation(df, distinct=not self.distinct)

    # Rounds.

    def _write(self, df: DataFrame, large: bool = False) -> _Batch:
        if large:
            df, rows, nulls, table = write_bucketed(dealt(df))
            return _Batch(df, rows, nulls, table=table)
        path, rows, nulls = write_counted(df)
        return _Batch(self.spark.read.schema(self.schema).parquet(path), rows, nulls, (path,))

    def _merged(self, last: _Batch, batch: _Batch) -> _Batch:
        large = self.distinct and last.rows + batch.rows >= _LARGE
        paths = last.paths + batch.paths
        if self.distinct and not large and len(paths) <= _MANY:
            return _Batch(self.spark.read.schema(self.schema).parquet(*paths), last.rows + batch.rows, last.nulls or batch.nulls, paths)
        both = self._read([last, batch])
        self._replaced += [last, batch]
        return self._write(both if self.distinct else both.distinct(), large)

    def _advance(self) -> bool:
        if self._recent:
            batch = self._recent
            while batch.rows is not None and self._stable and self._stable[-1].rows is not None and self._stable[-1].rows <= 2 * batch.rows:
                batch = self._merged(self._stable.pop(), batch)
            self._stable.append(batch)
            self._recent = None
        if self._to_add:
            new, depth = reduce(DataFrame.union, self._to_add), self._depth
            self._to_add, self._depth = [], 0
            if not self.counted and depth <= _DEEP:
                self._recent = _Batch(new.distinct(), depth=depth)
                return True
            large = [b for b in self._stable if b.table] if self.distinct else []
            new = (dealt(new) if large else new).distinct()
            # Without nulls among the stable rows no null can match, so plain equality is the same.
            for b in large:
                new = joins.minus(new, b.df, b.nulls)
            small = [b for b in self._stable if not b.table] if self.distinct else []
            if small:
                new = joins.minus(new, self._read(small), any(b.nulls for b in small))
            batch = self._write(new)
            self._recent = batch if batch.rows else None
            if not batch.rows:
                self._replaced.append(batch)
        return self._recent is not None


class Iteration:
    """Variables that advance together.

    ``while it.changed(): ...`` runs rules to the fixpoint; more rows may be
    inserted afterwards and the loop run again, which derives only what is new.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.round = spark, 0
        self.variables: list[Variable] = []
        self._stats: IO[str] | None = None

    def variable(self, name: str) -> Variable:
        self.variables.append(Variable(self.spark, name))
        return self.variables[-1]

    def variable_indistinct(self, name: str) -> Variable:
        """A variable whose new rows aren't compared with its stable ones; it may never end by itself."""
        self.variables.append(Variable(self.spark, name, distinct=False))
        self.variables[-1].counted = self._stats is not None
        return self.variables[-1]

    def record_stats_to(self, out: IO[str]) -> None:
        """Write a CSV line for each variable and round to a text file-like object."""
        self._stats = out
        for v in self.variables:
            v.counted = True
        out.write("Variable,Round,Stable count,Recent count\n")

    def changed(self) -> bool:
        """Advance every variable; whether any has new rows. Variables' jobs run side by side."""
        self.round += 1
        busy = [v for v in self.variables if v._to_add]
        with ThreadPoolExecutor(max(1, len(busy))) as pool:
            moved = list(pool.map(Variable._advance, self.variables)) if len(busy) > 1 else [v._advance() for v in self.variables]
        if self._stats:
            for v in self.variables:
                self._stats.write(f"{json.dumps(v.name, ensure_ascii=False)},{self.round},{v.num_stable()},{v.num_recent()}\n")
        return any(moved)

    def fixpoint(self, body, max_rounds: int | None = None) -> int:
        """Run ``body()`` each round until nothing changes; the number of rounds."""
        first = self.round
        while self.changed():
            if max_rounds is not None and self.round - first >= max_rounds:
                raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
            body()
        if all(v.counted for v in self.variables):
            self.tidy()
        return self.round - first

    def tidy(self) -> None:
        """Delete the tables that merges have replaced. Call it at a fixpoint, when no frame that was read before is in use.

        ``fixpoint`` does so itself, unless an indistinct variable's unwritten rows may still read them.
        """
        for v in self.variables:
            for b in v._replaced:
                delete(self.spark, b.paths, b.table)
            v._replaced = []
