"""Operator 3: language identification by a bidirectional gated recurrent network over bytes.

The network reads a whole text in lower case, byte by byte in both directions and
across its words, and gives every byte a probability for each language. A document's
probabilities are the mean over all its bytes. A text is read in pieces of ``_CORE``
bytes, each with ``_AROUND`` more of the text before and after it, so that every byte
is labelled once, and by a state that has read at least so much on both sides.

It is trained in numpy by backpropagation through time on stretches of a bounded
sample of labelled rows: ``sample`` rows of every language, the first by a hash of
the key, each its first ``sample_chars`` characters, or fewer where there are so many
languages that all pieces would exceed ``all_chars``. The steps of training and the
width of the network grow with the number of languages. Predictions read whole texts.

Defined results: ``und`` with score 0 where the text is null or has no letter, or
where no language could be learned; repeated rows get equal results; an empty
table gives no rows. Extra columns don't matter; only text decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import recurrent as rnn
from . import textual
from .shared import discard, lean, materialize, row_blocks

_CORE, _AROUND = 240, 16
_BLOCK = 4 << 20


@dataclass
class Model:
    languages: list[str]
    params: rnn.Params

    def label(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text of a block, the sum over its bytes of their probabilities of the languages."""
        p, n = self.params, len(self.languages)
        sides = [(p["embed"] @ p["w" + x] + p["b" + x], p["u" + x], p["o" + x]) for x in "fb"]
        pieces = -(-np.diff(offsets) // _CORE)
        text = np.repeat(np.arange(len(pieces)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        lo = offsets[text] + nth * _CORE
        hi = np.minimum(lo + _CORE, offsets[text + 1])
        first, last = np.maximum(lo - _AROUND, offsets[text]), np.minimum(hi + _AROUND, offsets[text + 1])
        out = np.zeros((len(text), n), np.float32)
        order = np.argsort(last - first, kind="stable")
        size = max(128, min(1024, (1 << 14) // n))
        for at in range(0, len(order), size):
            own = order[at : at + size]
            place = first[own] + np.arange(int((last - first)[own].max()))[:, None]
            inside = place < last[own]
            x = body[np.minimum(place, len(body) - 1)].astype(np.intp)
            scores = p["o"][:, None] + sum(rnn.gru_scores(x, inside, *side, k == 1) for k, side in enumerate(sides))
            scores -= scores.max(1, keepdims=True)
            np.exp(scores, out=scores)
            core = (place >= lo[own]) & (place < hi[own])
            scores *= (core / scores.sum(1))[:, None, :]
            out[own] = scores.sum(0).T
        return np.stack([np.bincount(text, out[:, j], len(pieces)) for j in range(n)], 1)


def padded(body: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    steps = int(sizes.max())
    t = np.arange(steps)[None, :]
    mask = (t < sizes[:, None]).astype(np.float32)
    x = body[np.minimum(starts[:, None] + t, len(body) - 1)] * mask.astype(np.uint8)
    return x, mask, rnn.reversal(sizes, steps)


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts in lower case (null: empty) and the offsets of the texts."""
    return textual.buffer_of(pc.utf8_lower(column))


def train(texts: list[str], languages: list[str], hidden: int | None = None, width: int = 16, steps: int = 300, batch: int = 96, length: int = 48, rate: float = 0.01, seed: int = 1) -> Model | None:
    """Fit on stretches of ``length`` bytes of labelled texts, from anywhere in them; all bytes of a language are alike.

    ``steps`` is for four languages and grows in proportion.
    """
    names = sorted(set(languages))
    body, offsets = lowered(pa.array(texts, pa.string()))
    if not names or not len(body):
        return None
    number = {x: i for i, x in enumerate(names)}
    target = np.array([number[x] for x in languages])
    held = np.diff(offsets)
    steps = -(-steps * max(4, len(names)) // 4)
    rng = np.random.default_rng(seed)
    k, n = hidden or min(64, max(12, len(names) // 2)), len(names)
    normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    p: rnn.Params = {
        "embed": rng.standard_normal((256, width)).astype(np.float32) * 0.5,
        "wf": normal(width, 3 * k), "bf": np.zeros(3 * k, np.float32), "uf": rnn.gru_init(rng, k),
        "wb": normal(width, 3 * k), "bb": np.zeros(3 * k, np.float32), "ub": rnn.gru_init(rng, k),
        "of": normal(k, n), "ob": normal(k, n), "o": np.zeros(n, np.float32),
    }
    adam = rnn.Adam(p, rate)
    # Languages weigh alike, whatever their share of the sample.
    weight = held / np.maximum(1, np.bincount(target, held, n))[target]
    draw = np.cumsum(weight) / weight.sum()
    for step in range(steps):
        own = np.minimum(np.searchsorted(draw, rng.random(batch), side="right"), len(held) - 1)
        own = np.where(held[own] > 0, own, int(np.argmax(held)))
        start = offsets[own] + (rng.random(batch) * (np.maximum(held[own] - length, 0) + 1)).astype(np.int64)
        x, mask, turn = padded(body, start, np.minimum(held[own], length))
        xb = np.take_along_axis(x, turn, 1)
        f, saved_f = rnn.gru_forward(p["embed"][x] @ p["wf"] + p["bf"], mask, p["uf"], True)
        raw, saved_b = rnn.gru_forward(p["embed"][xb] @ p["wb"] + p["bb"], mask, p["ub"], True)
        back = np.take_along_axis(raw, turn[:, :, None], 1)
        d = rnn.softmax(f @ p["of"] + back @ p["ob"] + p["o"])
        d[np.arange(batch), :, target[own]] -= 1
        d *= mask[:, :, None] / mask.sum()
        flat = lambda a: a.reshape(-1, a.shape[-1])
        g = {"of": flat(f).T @ flat(d), "ob": flat(back).T @ flat(d), "o": flat(d).sum(0)}
        dxf, g["uf"] = rnn.gru_backward(d @ p["of"].T, mask, p["uf"], saved_f)
        dxb, g["ub"] = rnn.gru_backward(np.take_along_axis(d @ p["ob"].T, turn[:, :, None], 1), mask, p["ub"], saved_b)
        g["embed"] = np.zeros_like(p["embed"])
        for side, at, dx in (("f", x, dxf), ("b", xb, dxb)):
            g["w" + side], g["b" + side] = flat(p["embed"][at]).T @ flat(dx), flat(dx).sum(0)
            np.add.at(g["embed"], at.ravel(), flat(dx) @ p["w" + side].T)
        adam.rate = rate * (1 - step / steps) + 1e-4
        adam.step(g)
    return Model(names, p)


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 300, sample_chars: int = 20_000, all_chars: int = 64_000_000, **how) -> Model | None:
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    rows = rows.withColumn("own", F.xxhash64("text"))
    # The sample is chosen by keys and hashes; texts of the chosen rows alone are moved.
    # A language of very many rows is ranked in groups, and then the first rows of its groups are.
    chosen = rows.select("lang", "key", "own", F.pmod(F.xxhash64("key", "own"), F.lit(16)).alias("part"))
    for own in (["lang", "part"], ["lang"]):
        nth = F.row_number().over(Window.partitionBy(*own).orderBy(F.xxhash64("key"), "key", "own"))
        chosen = chosen.withColumn("nth", nth).where(F.col("nth") <= sample).drop("nth")
    chosen = materialize(chosen.drop("part").distinct())
    n = chosen.select("lang").distinct().count()
    piece = min(sample_chars, max(200, all_chars // max(1, n * sample)))
    r, c = rows.alias("r"), F.broadcast(chosen.alias("c"))
    held = r.join(c, (F.col("r.lang") == F.col("c.lang")) & F.col("r.key").eqNullSafe(F.col("c.key")) & (F.col("r.own") == F.col("c.own")), "left_semi")
    got = held.dropDuplicates(["lang", "key", "own"]).select("lang", F.xxhash64("key").alias("h"), "key", "own", F.substring("text", 1, piece).alias("text"))
    got = got.orderBy("lang", "h", "key", "own").select("lang", "text").collect()
    discard(chosen)
    return train([x["text"] for x in got], [x["lang"] for x in got], **how)


def predict(docs: DataFrame, model: Model | None, text: str = "text", into: str = "language") -> DataFrame:
    """Add the struct ``into``: lang_pred and score."""
    lettered = F.col(text).rlike("\\p{L}") if model else F.lit(False)
    schema = docs.select("*", F.lit(None).cast("array<float>").alias("__share")).schema
    place = docs.columns.index(text)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        n = len(net.languages)
        for batch in batches:
            for lo, hi in row_blocks(batch.column(place), _BLOCK):
                total = net.label(*lowered(batch.column(place).slice(lo, hi - lo)))
                share = (total / np.maximum(total.sum(1, keepdims=True), 1e-9)).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * (hi - lo) + 1, n, dtype=np.int32)), pa.array(share.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, lists], schema.names)

    own = [F.col(f"`{c}`") for c in docs.columns]
    if model is None:
        return docs.select(*own, F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score")).alias(into))
    best = F.array_max("__share")
    name = F.element_at(F.array(*[F.lit(x) for x in model.languages]), F.array_position("__share", best).cast("int"))
    sure = F.coalesce(lettered, F.lit(False))
    result = F.struct(F.when(sure, name).otherwise(F.lit("und")).alias("lang_pred"), F.when(sure, best.cast("double")).otherwise(F.lit(0.0)).alias("score"))
    return docs.mapInArrow(lean(run), schema).select(*own, result.alias(into))
