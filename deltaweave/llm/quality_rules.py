"""Operator 6: quality rules, an ordered decision list learned from labelled documents.

``text_statistics`` measures whole texts with Spark expressions only.
``learn`` runs sequential covering over the statistics of a bounded sample of
labelled rows: a conjunction of thresholds is grown on two thirds of the
sample by information gain, pruned on the other third, kept if it is precise
enough, and the rows that it covers are set aside before the next one.
``apply_rules`` turns the list into one chained ``CASE WHEN``.

Defined results: a null text has no words and fails the base rules; an empty
table gives an empty table; repeated rows are judged each on its own; without
labels of both kinds no rule is learned and only the base rules reject. Extra
columns of the input are kept apart from the statistics, which live in one
struct column, so equal names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty

#: White space of the word pattern, as a Java character class.
_BLANK = "\\x20\\x09-\\x0D"
_WINDOW = 8
_FEATURES = ("n_words", "mean_word", "symbols_per_word", "dup_lines", "repeat_share", "upper_share", "marks_per_word", "bars_per_word")


def text_statistics(docs: DataFrame, text: str = "text", into: str = "quality") -> DataFrame:
    """Add a struct ``into`` of counts over each whole text.

    Each step is a projection of its own, because Catalyst keeps a costly
    expression that is used more than once in the projection that makes it.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    t = text_or_empty(text)
    words = F.filter(F.split(t, f"[{_BLANK}]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{_BLANK}]"))
    left = lambda keep: F.char_length(F.regexp_replace(t, f"[^{keep}]+", "")).cast("long")
    df = docs.select(
        *own,
        words.alias("__words"),
        lines.alias("__lines"),
        left("#*$%&|<>").alias("__symbols"),
        left("A-Z").alias("__upper"),
        left("!?*#$%").alias("__marks"),
        left("|").alias("__bars"),
    )
    df = df.select(
        *own, "__symbols", "__upper", "__marks", "__bars",
        F.size("__words").cast("long").alias("__n"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("__chars"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("__dup"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__h"),
    )
    window = lambda i: F.xxhash64(*[F.get("__h", i + k) for k in range(_WINDOW)])
    starts = F.sequence(F.lit(0), F.size("__h") - _WINDOW)
    df = df.withColumn("__w", F.when(F.size("__h") >= _WINDOW, F.transform(starts, window)).otherwise(F.array().cast("array<long>"))).drop("__h")
    again = F.size(F.array_distinct("__w")) < F.size("__w")
    ordered = F.sort_array(F.transform("__w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__o", F.when(again, ordered)).drop("__w")
    same = lambda x, k: F.coalesce(x["h"] == F.get("__o", k)["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter("__o", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
    df = df.withColumn("__p", places).drop("__o")
    step = lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(_WINDOW), p - a["at"])).alias("n"))
    covered = F.aggregate("__p", F.struct(F.lit(-_WINDOW).alias("at"), F.lit(0).alias("n")), step, lambda a: a["n"].cast("long"))
    # Never null; not deterministic, so that no filter on the counts moves below the steps above and unfolds them.
    counted = F.monotonically_increasing_id() >= 0
    return df.select(
        *own,
        F.struct(
            F.when(counted, F.col("__n")).alias("n_words"),
            F.col("__chars").alias("word_chars"),
            F.col("__symbols").alias("n_symbols"),
            F.col("__dup").alias("n_dup_lines"),
            F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
            F.col("__upper").alias("n_upper"),
            F.col("__marks").alias("n_marks"),
            F.col("__bars").alias("n_bars"),
        ).alias(into),
    )


def base_failed(stats: str = "quality") -> Column:
    s = F.col(stats)
    return (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])


def features(stats: str = "quality") -> dict[str, Column]:
    """The statistics that rules compare with thresholds, as doubles."""
    s = F.col(stats)
    n = F.greatest(s["n_words"], F.lit(1)).cast("double")
    return dict(
        zip(
            _FEATURES,
            (
                s["n_words"].cast("double"),
                s["word_chars"] / n,
                s["n_symbols"] / n,
                s["n_dup_lines"] / n,
                s["n_repeat_words"] / n,
                s["n_upper"] / F.greatest(s["word_chars"], F.lit(1)).cast("double"),
                s["n_marks"] / n,
                s["n_bars"] / n,
            ),
            strict=True,
        )
    )


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, above, threshold): rejects a row that meets all."""

    tests: tuple[tuple[str, bool, float], ...]
    covered: int
    precision: float

    def condition(self, values: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, above, cut in self.tests:
            out = out & (values[name] >= cut if above else values[name] < cut)
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{n} {'>=' if a else '<'} {c:.6g}" for n, a, c in self.tests)


def _mask(rows: np.ndarray, tests) -> np.ndarray:
    out = np.ones(len(rows), bool)
    for name, above, cut in tests:
        column = rows[:, _FEATURES.index(name)]
        out &= column >= cut if above else column < cut
    return out


def _best_test(rows: np.ndarray, bad: np.ndarray, cuts: int):
    """The threshold with the largest information gain for the rejected class."""
    p, n = bad.sum(), (~bad).sum()
    best, test = 1e-9, None
    before = np.log2(p / (p + n))
    for k, name in enumerate(_FEATURES):
        order = np.argsort(rows[:, k], kind="stable")
        x, y = rows[order, k], np.cumsum(bad[order])
        edges = np.flatnonzero(x[1:] > x[:-1])
        if not len(edges):
            continue
        if len(edges) > cuts:
            edges = edges[np.linspace(0, len(edges) - 1, cuts).astype(int)]
        below_p, below = y[edges], edges + 1
        for above in (True, False):
            pp = p - below_p if above else below_p
            tt = len(x) - below if above else below
            gain = np.where(pp > 0, pp * (np.log2(np.maximum(pp, 1) / tt) - before), -1)
            i = int(np.argmax(gain))
            if gain[i] > best:
                best, test = gain[i], (name, above, float((x[edges[i]] + x[edges[i] + 1]) / 2))
    return test


def cover(rows: np.ndarray, bad: np.ndarray, max_rules: int = 12, max_tests: int = 4, precision: float = 0.95, least: int = 5, cuts: int = 256) -> list[Rule]:
    """Sequential covering over a matrix of features; ``bad`` marks rejected rows."""
    grow = np.arange(len(rows)) % 3 != 2
    left, rules = np.ones(len(rows), bool), []
    while len(rules) < max_rules and (left & bad & grow).sum() >= least:
        tests, at = [], left & grow
        while len(tests) < max_tests and (at & ~bad).any() and (at & bad).any():
            if not (test := _best_test(rows[at], bad[at], cuts)):
                break
            tests.append(test)
            at &= _mask(rows, [test])
        held = left & ~grow
        worth = lambda ts: (lambda m: ((m & bad).sum() - (m & ~bad).sum()) / max(1, m.sum()))(held & _mask(rows, ts))  # noqa: B023, E731
        while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
            tests.pop()
        hit = left & _mask(rows, tests)
        share = (hit & bad).sum() / max(1, hit.sum())
        if not tests or (hit & bad).sum() < least or share < precision:
            break
        rules.append(Rule(tuple(tests), int(hit.sum()), float(share)))
        left &= ~hit
    return rules


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 6000, **how) -> list[Rule]:
    """Learn rejections from at most ``sample`` labelled rows, the first by a hash of the key.

    ``sample`` bounds what reaches the driver (a few numbers a row) and the side
    that is broadcast to pick the labelled documents. Rows that the base rules
    reject already teach nothing.
    """
    chosen = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("__key"))
        .agg(F.max(label).alias("__label"))
        .orderBy(F.xxhash64("__key"), "__key")
        .limit(sample)
    )
    picked = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__key")
    measured = text_statistics(picked, "__text").where(~base_failed())
    rows = measured.select("__label", *[v.alias(k) for k, v in features().items()]).orderBy("__key").collect()
    if not rows:
        return []
    data = np.array([[float(x) for x in r] for r in rows])
    return cover(data[:, 1:], data[:, 0] == 0, **how)


def apply_rules(rules: list[Rule], stats: str = "quality") -> tuple[Column, Column]:
    """The verdict (True: keep) and the number of the deciding rule (0: base, null: none)."""
    values = features(stats)
    verdict, which = F.when(base_failed(stats), F.lit(False)), F.when(base_failed(stats), F.lit(0))
    for k, rule in enumerate(rules, 1):
        verdict = verdict.when(rule.condition(values), F.lit(False))
        which = which.when(rule.condition(values), F.lit(k))
    return verdict.otherwise(F.lit(True)), which


def quality_filter(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that neither the base rules nor the learned list reject."""
    verdict, _ = apply_rules(learn(docs, labels, key, text), "__quality")
    return text_statistics(docs, text, "__quality").where(verdict).select(*[f"`{c}`" for c in docs.columns])
