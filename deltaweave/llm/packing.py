"""Operator 5: packing token sequences by non-negative least squares.

1. Tokenize: whole texts become ids with a public tokenizer, in Arrow batches;
   a document with its end id is cut into full windows and one tail.
2. Count: a histogram of tail lengths, at most one row for each length.
3. Solve (driver, over the histogram alone): combinations of two or three
   lengths that fill a window exactly are enumerated, all that the lengths present
   allow (their number depends on the window alone), their repeat counts are solved
   by non-negative least squares against the histogram and rounded within the supply. Lengths that are left over are packed greedily: laid end
   to end, longest first, and cut where a window ends.
4. Place: tails of a length are numbered by a two-level count (a bucket's offset
   and the place in the bucket), so no length gathers in one task; the number
   says which pattern and window a tail fills. Pieces are then joined to the ids.

Only the very last window of the greedy part can have padding.

Defined results: a null or empty text is its end id alone; repeated rows are
packed each on its own; an empty table gives no pieces. Columns of the input
besides the key and text are not carried.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textual
from .shared import lean, materialize, remembered, row_blocks

WINDOW = 2048
_BLOCK = 2 << 20
#: Tails of one bucket in a numbering task, on average.
_BUCKET_ROWS = 20_000


# ASCII marks, and the letters and digits before which they are told apart.
_PLAIN = np.zeros(256, bool)
for _low, _high in ((0x30, 0x39), (0x61, 0x7A)):
    _PLAIN[_low : _high + 1] = True
_MARK = textual.delimiters((0x00, 0x20), (0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x7F, 0xFF))
#: Words of letters that are in lower case and that NFC leaves as they are: one unit of the tokenizer's model.
_LETTERS = re.compile("[a-zß-öø-ÿа-џ一-龥]+").fullmatch


class WordTokenizer:
    """Ids of white-space separated words, each different word tokenized once.

    The tokenizer drops white space before it splits, so the ids of a text are
    those of its words in order. Every different word, in lower case and without the
    marks that end it, goes through the library once; words are told apart by their bytes. Words of plain letters skip the
    library's normalizer and its splitting, which would leave them as they are. What is remembered is bounded: at ``_KEEP`` words
    the memory starts anew, which costs time only.
    """

    _KEEP = 800_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        # A task has one core; the library's threads would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.plain = Tokenizer(self.library.model)
        self.plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.reset()

    def reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.bounds, self.pool = np.zeros(1, np.int64), np.zeros(0, np.uint16)

    def _learn(self, words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        letters = [_LETTERS(x) is not None for x in texts]
        for library, kind in ((self.plain, True), (self.library, False)):
            some = [k for k, x in enumerate(letters) if x is kind]
            ids = [e.ids for e in library.encode_batch_fast([texts[k] for k in some], add_special_tokens=False)]
            self.known.update(zip([words[k] for k in some], range(len(self.known), len(self.known) + len(some)), strict=True))
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
            self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(ids), np.uint16, int(sizes.sum()))])

    @staticmethod
    def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, ends, each text's first): words in ASCII lower case, marks that end a word apart.

        The tokenizer lowers letters itself, and parts marks from a letter or digit before them.
        """
        words = textual.words_of(column, textual.WHITE, lower=True)
        body, stem = words.body, words.ends.copy()
        live = np.arange(len(stem))
        while len(live):
            live = live[_MARK[body[stem[live] - 1]]]
            stem[live] -= 1
            live = live[stem[live] > words.starts[live]]
        apart = (stem > words.starts) & (stem < words.ends)
        apart[apart] = _PLAIN[body[stem[apart] - 1]]
        at = np.arange(len(stem)) + np.cumsum(apart) - apart
        starts, ends = np.zeros(len(stem) + int(apart.sum()), np.int64), np.zeros(len(stem) + int(apart.sum()), np.int64)
        starts[at], ends[at] = words.starts, np.where(apart, stem, words.ends)
        starts[at[apart] + 1], ends[at[apart] + 1] = stem[apart], words.ends[apart]
        return body, starts, ends, np.append(at, len(starts))[words.first]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block of texts, and the bounds of each text's ids."""
        body, starts, ends, bounds = self._units(column)
        first, which = textual.distinct_spans(body, starts, ends)
        raw = body.tobytes()
        keys = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        if len(self.known) > self._KEEP:
            self.reset()
        unknown = [k for k in keys if k not in self.known]
        if unknown:
            self._learn(unknown)
        number = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))
        at, sizes = self.bounds[number][which], (self.bounds[number + 1] - self.bounds[number])[which]
        stops = np.cumsum(sizes)
        ids = self.pool[np.repeat(at - (stops - sizes), sizes) + np.arange(int(sizes.sum()))]
        return ids, np.concatenate([[0], stops])[bounds]


def tokenize(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = 1) -> DataFrame:
    """(row, key, n, ids): ids as little-endian 16-bit numbers, the end id included; ``row`` is unique."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, n long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = remembered(("tokenizer", path), lambda: WordTokenizer(path))
        for batch in batches:
            for lo, hi in row_blocks(batch.column(1), _BLOCK):
                ids, bounds = tokenizer.encode(batch.column(1).slice(lo, hi - lo))
                ended = np.insert(ids, bounds[1:], np.uint16(end_id)).astype("<u2")
                stops = (bounds + np.arange(len(bounds))) * 2
                out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(stops), pa.py_buffer(ended)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds) + 1), out], ["key", "n", "ids"])

    return rows.mapInArrow(lean(run), schema).select(F.monotonically_increasing_id().alias("row"), "key", "n", "ids")


def combinations(lengths: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """All rows of two or three present lengths (a third of 0: none), largest first, that sum to ``window``."""
    have = np.zeros(window + 1, bool)
    have[lengths[counts > 0]] = True
    have[0] = True
    present = np.flatnonzero(have[1:]) + 1
    rows = [np.zeros((0, 3), np.int64)]
    for a in present[3 * present >= window].tolist():
        b = present[(present <= min(a, window - a)) & (2 * present >= window - a)]
        b = b[have[window - a - b]]
        rows.append(np.stack([np.full(len(b), a), b, window - a - b], 1))
    return np.concatenate(rows)


def nonnegative_least_squares(rows: np.ndarray, target: np.ndarray, steps: int = 200) -> np.ndarray:
    """Repeat counts x >= 0 that minimize the squared distance of used lengths from ``target``.

    Accelerated projected gradient over the sparse matrix whose column j has a
    one for each length of combination j (index 0 is no length).
    """
    x = y = np.zeros(len(rows))
    t = 1.0
    goal = target.astype(float)

    def used(v):
        out = sum(np.bincount(rows[:, k], v, len(goal)) for k in range(rows.shape[1]))
        out[0] = 0
        return out

    step = np.ones(len(rows))
    for _ in range(20):  # the largest eigenvalue, by power iteration
        back = used(step / np.linalg.norm(step))
        step = sum(np.where(rows[:, k] > 0, back[rows[:, k]], 0) for k in range(rows.shape[1]))
    scale = 1 / max(1e-9, np.linalg.norm(step))
    for _ in range(steps):
        miss = used(y) - goal
        gradient = sum(np.where(rows[:, k] > 0, miss[rows[:, k]], 0) for k in range(rows.shape[1]))
        new = np.maximum(0, y - scale * gradient)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def rounded(x: np.ndarray) -> np.ndarray:
    """Whole repeats whose running sums are those of ``x``, rounded: many small parts of one don't vanish."""
    return np.diff(np.floor(np.cumsum(x) + 0.5), prepend=0.0).astype(np.int64)


@dataclass
class Plan:
    """Where the tail with number r of each length goes.

    Slots are sorted by (length, first number); slot s takes the numbers from
    ``first[s]`` on, one for each repeat of its pattern. Numbers from
    ``spare_first[length]`` on are laid end to end from token ``spare_at[length]``.
    """

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    slot_at: np.ndarray
    spare_first: np.ndarray
    spare_at: np.ndarray
    patterns: int
    spare_tokens: int


def solve(lengths: np.ndarray, counts: np.ndarray, window: int) -> Plan:
    supply = np.zeros(window + 1, np.int64)
    supply[lengths] = counts
    left = supply.copy()
    slots: list[tuple[int, int, int, int]] = []
    sequence = 0
    rows = combinations(lengths, counts, window)
    repeats = rounded(nonnegative_least_squares(rows, supply)) if len(rows) else np.zeros(0, np.int64)
    some = np.flatnonzero(repeats)
    some = some[np.argsort(-repeats[some], kind="stable")]
    for row, want in zip(rows[some].tolist(), repeats[some].tolist(), strict=True):
        parts = [n for n in row if n]
        take = min([want, *(int(left[n]) // parts.count(n) for n in parts)])
        if take < 1:
            continue
        offset = 0
        for n in parts:
            slots.append((n, int(supply[n] - left[n]), sequence, offset))
            left[n] -= take
            offset += n
        sequence += take
    table = np.array(sorted(slots), np.int64).reshape(-1, 4)
    spare_at = np.zeros(window + 1, np.int64)
    at = 0
    for n in range(window, 0, -1):
        spare_at[n] = at
        at += n * int(left[n])
    return Plan(table[:, 0], table[:, 1], table[:, 2], table[:, 3], np.searchsorted(table[:, 0], np.arange(window + 2)), supply - left, spare_at, sequence, at)


def place(length: np.ndarray, number: np.ndarray, plan: Plan, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of tails; sequences of the greedy part follow those of the patterns."""
    where = length * (np.int64(1) << 40)
    slot = np.searchsorted(plan.length * (np.int64(1) << 40) + plan.first, where + number, side="right") - 1
    spare = number >= plan.spare_first[length]
    slot = np.where(spare, 0, slot)
    if len(plan.first):
        sequence, offset = plan.sequence[slot] + number - plan.first[slot], plan.offset[slot]
    else:
        sequence, offset = np.zeros_like(number), np.zeros_like(number)
    at = plan.spare_at[length] + (number - plan.spare_first[length]) * length
    return np.where(spare, plan.patterns + at // window, sequence), np.where(spare, at % window, offset)


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids), one row for each piece."""
    tokens = materialize(tokenize(docs, path, key, text))
    spark = docs.sparkSession
    sizes = tokens.select("row", "n", F.floor(F.col("n") / window).alias("full"), (F.col("n") % window).alias("tail"))
    histogram = np.array([tuple(r) for r in sizes.where("tail > 0").groupBy("tail").count().orderBy("tail").collect()], np.int64).reshape(-1, 2)
    totals = sizes.agg(F.count("*"), F.coalesce(F.sum("full"), F.lit(0))).first()
    plan = spark.sparkContext.broadcast(solve(histogram[:, 0], histogram[:, 1], window))
    spare = -(-plan.value.spare_tokens // window)
    buckets = max(1, -(-totals[0] // _BUCKET_ROWS))
    dealt = sizes.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    # Offsets of a length's tails, and of full windows, bucket by bucket: a row for each bucket and length.
    grid = dealt.groupBy("bucket", "tail").agg(F.count("*").alias("here"), F.sum("full").alias("windows"))
    earlier = Window.partitionBy("tail").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_tail = dealt.groupBy("tail").agg(F.sum("full").alias("windows"))
    before_tail = Window.orderBy("tail").rowsBetween(Window.unboundedPreceding, -1)  # at most `window` rows
    bases = per_tail.select("tail", F.coalesce(F.sum("windows").over(before_tail), F.lit(0)).alias("base"))
    offsets = grid.select(
        "bucket", "tail",
        F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("skip"),
        F.coalesce(F.sum("windows").over(earlier), F.lit(0)).alias("windows_skip"),
    ).join(bases, "tail")
    inner = Window.partitionBy("bucket", "tail").orderBy("row")
    counted = dealt.withColumns({"k": F.row_number().over(inner) - 1, "w": F.coalesce(F.sum("full").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    numbered = counted.join(offsets, ["bucket", "tail"]).select(
        "row", "tail", (F.col("k") + F.col("skip")).alias("number"), (F.col("w") + F.col("windows_skip") + F.col("base")).alias("window_number")
    )
    first_full = plan.value.patterns + spare
    joined = tokens.join(numbered, "row").select("key", "n", "ids", "tail", "number", "window_number")
    schema = f"{key} {tokens.schema['key'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"

    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, tail, number, full_at = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 3, 4, 5))
            sequence, offset = place(tail, number, plan.value, window)
            # A row's pieces: its full windows, then the tail, which a window's end may cut once.
            full, head = n // window, np.minimum(tail, window - offset)
            sizes = full + (tail > 0) + (head < tail)
            i = np.repeat(np.arange(len(n)), sizes)
            k = np.arange(len(i)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            whole, second = k < full[i], k > full[i]
            start = k * window
            start[second] = (full[i] * window + head[i])[second]
            length = np.where(whole, window, np.where(second, (tail - head)[i], head[i]))
            at = np.where(whole, first_full + full_at[i] + k, sequence[i] + second)
            within = np.where(whole | second, 0, offset[i])
            # The pieces of all rows, one after the other, are the rows' ids.
            raw, _ = textual.buffer_of(batch.column(2))
            ids = raw.view("<u2").astype("<u4")
            ends = np.cumsum(length) * 4
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[b - 4 * m : b]) for b, m in zip(ends.tolist(), length.tolist(), strict=True)]
            owned = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(i), [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(ids)]).cast(pa.binary())
            columns = [start, length, np.array(crc, np.int64), n[i], at, within]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), *map(pa.array, columns), owned], [key, *names, "ids"])

    return joined.mapInArrow(lean(cut), schema)
