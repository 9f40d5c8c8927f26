"""deltaweave: recursive, rule-based analytics over Spark DataFrames."""

from .operators.leapers import (
    ExtendAnti,
    ExtendWith,
    FilterAnti,
    FilterWith,
    LeaperSpec,
    Passthrough,
    PrefixFilter,
    ValueFilter,
    leapjoin,
    passthrough,
)
from .operators.relation import Relation
from .plans.fixpoint import Iteration, Variable

__all__ = [
    "ExtendAnti",
    "ExtendWith",
    "FilterAnti",
    "FilterWith",
    "Iteration",
    "LeaperSpec",
    "Passthrough",
    "PrefixFilter",
    "Relation",
    "ValueFilter",
    "Variable",
    "leapjoin",
    "passthrough",
]
