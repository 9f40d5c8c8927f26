"""Keep a fixpoint up to date under a stream of insertions.

Variables only grow, so a micro-batch is inserted and the rules run to the next
fixpoint, deriving only what the new rows bring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..plans.fixpoint import Iteration, Variable


def into(variable: Variable, iteration: Iteration, body: Callable[[], None], after: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: insert the batch, run ``body`` to the fixpoint, then call ``after(batch_id)``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            # The batch belongs to the stream's session; the variable's own session reads it as a written table.
            variable.insert(batch)
            iteration.fixpoint(body)
        if after:
            after(batch_id)

    return handle
