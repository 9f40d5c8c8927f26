"""Operator 9: toxicity by classifier chains of linear models.

Categories are predicted one after the other. Each has a logistic model over
hashed features of a whole text and the probabilities of all earlier categories;
those it is trained with are out-of-fold predictions, so a later model learns how
far an earlier one can be trusted on texts it hasn't seen.

The last category is the labelled one. Earlier ones are kinds of it, found in the
labels alone: the labelled toxic texts are clustered by the features that tell them
from the others, and a text of the sample belongs to a kind if it is toxic and of
that cluster. No list of words is given; nothing depends on the language.

Features are words and beginnings of words (``_PREFIXES`` bytes, of longer words
alone), each with the number of times that it occurs (``_TIMES`` or more): one
odd word means little in a long text, three of a stem a lot. Features that the
labels don't bear out weigh nothing: the best by a likelihood ratio are kept, which
any number of labels and any share of toxic ones can reach; a ridge shrinks the rest.

The models are fitted in numpy on at most ``sample`` labelled rows, the first by
a hash of the key, one text of each key; every row is scored on its whole text in
Arrow batches.

Defined results: a null or wordless text scores by the models' constants alone;
without labels of both kinds every score is the share of positives (0 without
labels); of rows with equal labelled keys the one with the smallest hash of its text
teaches; repeated rows get equal results; an empty table gives no rows. Extra
columns are carried untouched; ``into`` must not be one of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textual
from .shared import fresh_name, lean, row_blocks

TARGET = "toxic"
KINDS = 3
_BLOCK = 2 << 20
_FOLDS = 4
_PREFIXES = (4, 5, 6, 7, 8, 10)
_TIMES = (1, 2, 3)
_SPACE = 1 << 21


@dataclass
class Category:
    name: str
    slots: np.ndarray  # sorted features that weigh
    weights: np.ndarray
    chain: np.ndarray  # of the earlier categories
    constant: float

    def margin(self, text: np.ndarray, slot: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """The linear score of each row of ``earlier`` from its (text, feature) pairs."""
        place, known = _places(self.slots, slot)
        found = np.bincount(text[known], self.weights[place[known]], len(earlier))
        return found + earlier @ self.chain + self.constant


@dataclass
class Chain:
    categories: list[Category]

    def features(self) -> np.ndarray:
        """A flag for each feature that some category weighs."""
        flags = np.zeros(_SPACE, bool)
        for c in self.categories:
            flags[c.slots] = True
        return flags

    def scores(self, text: np.ndarray, slot: np.ndarray, texts: int) -> np.ndarray:
        """Probabilities (text, category)."""
        out = np.zeros((texts, 0))
        for c in self.categories:
            out = np.column_stack([out, _sigmoid(c.margin(text, slot, out))])
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _places(have: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(have):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(have, wanted), len(have) - 1)
    return place, have[place] == wanted


def features(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of a block of texts, each pair once; of the ``wanted`` features alone where given.

    Words are runs of letters in lower case. The features of a number of times lie
    next to each other: the first of them says that the word or stem occurs.
    """
    words = textual.words_of(column, textual.NOT_LETTER, lower=True)
    owner, sizes = words.owner(), words.ends - words.starts
    texts, slots = [], []
    rooms = np.uint64(_SPACE // len(_TIMES))
    for size in (0, *_PREFIXES):
        own = np.flatnonzero(sizes > size)
        ends = words.starts[own] + size if size else words.ends[own]
        hashed = textual.mix(textual.span_hashes(words.body, words.starts[own], ends) + np.uint64(size))
        room = (hashed % rooms).astype(np.int64) * len(_TIMES)
        text = owner[own]
        if wanted is not None:
            some = wanted[room] | wanted[room + 1] | wanted[room + 2]
            text, room = text[some], room[some]
        pairs, times = np.unique(text * np.int64(_SPACE) + room, return_counts=True)
        for k, least in enumerate(_TIMES):
            often = pairs[times >= least]
            texts.append(often // _SPACE)
            slots.append(often % _SPACE + k)
    pairs = np.unique(np.concatenate(texts) * np.int64(_SPACE) + np.concatenate(slots))
    return pairs // _SPACE, pairs % _SPACE


def telling(text: np.ndarray, slot: np.ndarray, target: np.ndarray, rows: np.ndarray, most: int = 600, least: int = 3) -> np.ndarray:
    """The ``most`` features (sorted) that go with the positives by the largest likelihood ratio."""
    inside = np.zeros(len(target), bool)
    inside[rows] = True
    use = inside[text]
    text, slot = text[use], slot[use]
    p = np.bincount(slot, target[text], _SPACE)
    n = np.bincount(slot, minlength=_SPACE) - p
    a, b = target[rows].sum(), len(rows) - target[rows].sum()
    some = np.flatnonzero((p + n >= least) & (p * b > 2 * n * a))
    p, n = p[some], n[some]
    part = lambda x, share: x * np.log(np.maximum(x, 1e-9) / np.maximum(share, 1e-9))
    share = (p + n) / (a + b)
    ratio = part(p, a * share) + part(n, b * share) + part(a - p, a * (1 - share)) + part(b - n, b * (1 - share))
    return np.sort(some[np.argsort(-ratio, kind="stable")[:most]])


def fit_linear(text, slot, slots, extra: np.ndarray, target: np.ndarray, rows: np.ndarray, steps: int = 300, rate: float = 0.5, ridge: float = 3e-4):
    """Logistic regression over ``slots`` and ``extra`` columns on the texts ``rows``: (weights, chain, constant).

    Both classes weigh alike, so a rare one isn't given up.
    """
    place, known = _places(slots, slot)
    inside = np.zeros(len(target), bool)
    inside[rows] = True
    known &= inside[text]
    t, j, n, m = text[known], place[known], len(target), len(slots)
    positive = target[rows].sum()
    use = np.where(target > 0, 0.5 / max(1, positive), 0.5 / max(1, len(rows) - positive)) * inside
    w, chain, b = np.zeros(m), np.zeros(extra.shape[1]), 0.0
    square_w, square_c, square_b = np.full(m, 1e-8), np.full(len(chain), 1e-8), 1e-8
    for k in range(steps):
        d = (_sigmoid(np.bincount(t, w[j], n) + extra @ chain + b) - target) * use
        gw, gc, gb = np.bincount(j, d[t], m) + ridge * w, extra.T @ d + ridge * chain, d.sum()
        square_w, square_c, square_b = square_w + gw * gw, square_c + gc * gc, square_b + gb * gb
        step = rate / (1 + 4 * k / steps)
        w, chain, b = w - step * gw / np.sqrt(square_w), chain - step * gc / np.sqrt(square_c), b - step * gb / np.sqrt(square_b)
    return w, chain, float(b)


def _fitted(name: str, text, slot, held: np.ndarray, target: np.ndarray, rows: np.ndarray) -> Category:
    slots = telling(text, slot, target, rows)
    return Category(name, slots, *fit_linear(text, slot, slots, held, target, rows))


def kinds_of(text, slot, target: np.ndarray, kinds: int, rounds: int = 10) -> np.ndarray:
    """The cluster of each positive text (-1: negative), by k-means over the features that tell positives."""
    slots = telling(text, slot, target, np.arange(len(target)))
    positive = np.flatnonzero(target)
    row = np.full(len(target), -1)
    row[positive] = np.arange(len(positive))
    place, known = _places(slots, slot)
    known &= target[text] > 0
    x = np.zeros((len(positive), max(1, len(slots))), np.float32)
    x[row[text[known]], place[known]] = 1
    x /= np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
    # Centres start at texts as far from the earlier ones as can be.
    centres = x[:1]
    while len(centres) < min(kinds, len(x)):
        centres = np.concatenate([centres, x[[int(np.argmin((x @ centres.T).max(1)))]]])
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, 1)
        centres = np.stack([x[own == k].sum(0) if (own == k).any() else centres[k] for k in range(len(centres))])
        centres /= np.maximum(1e-9, np.linalg.norm(centres, axis=1, keepdims=True))
    out = np.full(len(target), -1)
    out[positive] = own
    return out


def train(texts: list[str], labels: list[int], kinds: int = KINDS, folds: int = _FOLDS) -> Chain:
    column, parts, n = pa.array(texts, pa.string()), [], len(texts)
    for lo, hi in row_blocks(column, _BLOCK):
        text, slot = features(column.slice(lo, hi - lo))
        parts.append((text + lo, slot.astype(np.int32)))
    text, slot = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(2))
    final = np.array(labels, float)
    fold = np.arange(n) % folds
    mixed = n > 0 and final.min() < final.max()
    kind = kinds_of(text, slot, final, kinds) if mixed else np.full(n, -1)
    targets = {f"kind_{k + 1}": (kind == k).astype(float) for k in range(kinds)} | {TARGET: final}
    done: list[Category] = []
    held = np.zeros((n, 0))  # out-of-fold probabilities of the categories so far
    for name, target in targets.items():
        if not n or target.min() == target.max():
            share = float(target.mean()) if n else 0.0
            done.append(Category(name, np.zeros(0, np.int64), np.zeros(0), np.zeros(held.shape[1]), float(np.log((share + 1e-6) / (1 - share + 1e-6)))))
            held = np.column_stack([held, np.full(n, share)])
            continue
        out = np.zeros(n)
        for f in range(folds):
            part = _fitted(name, text, slot, held, target, np.flatnonzero(fold != f))
            out = np.where(fold == f, part.margin(text, slot, held), out)
        done.append(_fitted(name, text, slot, held, target, np.arange(n)))
        held = np.column_stack([held, _sigmoid(out)])
    return Chain(done)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = TARGET, sample: int = 6000, sample_chars: int = 20_000) -> Chain:
    """Fit on at most ``sample`` labelled texts, one of each key, none of more than ``sample_chars`` characters."""
    chosen = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(sample)
    )
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.char_length("text") <= sample_chars)
    single = rows.join(F.broadcast(chosen), "key").groupBy("key", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    got = single.orderBy("key").select("text", "label").collect()
    return train([r["text"] for r in got], [int(r["label"] > 0) for r in got])


def score(docs: DataFrame, chain: Chain, text: str = "text", into: str = "toxicity") -> DataFrame:
    """Add the struct ``into``: a probability for each category of the chain."""
    if into in docs.columns:
        raise ValueError(f"the documents have a column {into!r} already")
    names = [c.name for c in chain.categories]
    schema = docs.select("*", F.struct(*[F.lit(0.0).alias(n) for n in names]).alias(into)).schema
    place = docs.columns.index(text)
    held = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = held.value.features()
        for batch in batches:
            for lo, hi in row_blocks(batch.column(place), _BLOCK):
                owner, slot = features(batch.column(place).slice(lo, hi - lo), wanted)
                found = held.value.scores(owner, slot, hi - lo)
                struct = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(len(names))], names)
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, struct], schema.names)

    return docs.mapInArrow(lean(run), schema)


def drop_toxic(docs: DataFrame, chain: Chain, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose last category scores below ``threshold``."""
    into = fresh_name(docs, "toxicity")
    found = score(docs, chain, text, into).where(F.col(into)[chain.categories[-1].name] < threshold)
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])
