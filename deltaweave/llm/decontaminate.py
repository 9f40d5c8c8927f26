"""Operator 10: benchmark decontamination by suffix arrays of the training texts.

The corpus is cut into shards (blocks of whole documents inside a task). A
shard's words become codes of the benchmark's vocabulary; its suffix array
orders every suffix that lies in a run of such words long enough for a window,
to the depth of the longest item. Test suffixes are looked up by binary search,
each different one once: first the ``width`` words that begin it, which gives the
range of all its matches, then, in that range, its place at full depth. A shard
suffix has its longest match with one of its two neighbours among the test
suffixes. Ranges of different windows are disjoint, so a window that many items
and many documents share costs the sum of both, not the product.
No text is shuffled: shards need nothing from each other.

A window is ``width`` consecutive words of an item; an item with fewer words is
one window. Words are told apart by their bytes.

The benchmark, without repeated rows, comes in blocks of about ``block_bytes`` (a
bound on what a task holds and on each broadcast), dealt by a hash of the row; a
benchmark of any size is searched block by block against all rows, and a task
reads each block once for about ``_TOGETHER`` bytes of texts.

Defined results: a null or wordless text has no words and is clean; an item
without words has no window; a null item_id counts as the empty string; equal
item_ids count as one item; rows are judged each on its own, so repeated rows
and repeated doc_ids are fine; empty tables give empty or clean results. Columns
of the documents are carried as they are; the findings are one struct column,
whose name must not be one of theirs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textual
from .shared import discard, fresh_name, materialize, row_blocks

WIDTH = 10
_SHARD = 2 << 20
_TOGETHER = 16 << 20
_BUCKETS = np.uint64((1 << 16) - 1)
_DIGESTS = 10_000  # digests of item sets that a worker remembers

MATCHES = "array<struct<item_id:string,item_start:bigint,doc_start:bigint,words:bigint>>"
FINDINGS = f"struct<n_words:bigint,n_hit:bigint,n_items:bigint,items_sha256:string,longest_words:bigint,matches:{MATCHES}>"


def _packed(codes: np.ndarray, bits: int) -> np.ndarray:
    """The first ``63 // bits`` codes from each place as one number."""
    each = max(1, 63 // bits)
    padded = np.concatenate([codes, np.zeros(each, codes.dtype)]).astype(np.int64)
    key = np.zeros(len(codes), np.int64)
    for k in range(each):
        key = (key << bits) | padded[k : len(codes) + k]
    return key


def suffix_order(codes: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """Places of ``codes`` sorted by the ``depth`` codes, or more, that follow.

    What is compared doubles; only suffixes that still tie are sorted again.
    """
    n = len(codes)
    key = _packed(codes, bits)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]) if n else np.zeros(0, bool)
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1] if n else 0
    rank[n] = -1
    known = max(1, 63 // bits)
    while known < depth:
        tied = ~head
        tied[:-1] |= tied[1:]
        live = np.flatnonzero(tied)
        if not len(live):
            break
        places = order[live]
        key = rank[places] * (n + 2) + rank[np.minimum(places + known, n)] + 1
        again = np.argsort(key, kind="stable")
        places, key = places[again], key[again]
        order[live] = places
        head[live] = np.concatenate([[True], key[1:] != key[:-1]])
        own = head[live]
        rank[places] = live[own][np.cumsum(own) - 1]
        known *= 2
    return order


def agreed(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, known: int, most: int | None = None) -> np.ndarray:
    """How many codes agree from places ``at`` of ``a`` and ``bt`` of ``b``, of which ``known`` do; 0 agrees with nothing."""
    size = np.full(len(at), known, np.int64)
    live = np.arange(len(at))
    while len(live) and (most is None or known < most):
        x = a[at[live] + known]
        live = live[(x == b[bt[live] + known]) & (x > 0)]
        known += 1
        size[live] = known
    return size


class TestBlock:
    """The windows and suffixes of a block of benchmark items, coded by the block's words."""

    def __init__(self, ids: list[str], texts: list[str], width: int):
        words = textual.words_of(pa.array(texts, pa.string()), textual.NOT_ALNUM, lower=True)
        first, which = textual.distinct_spans(words.body, words.starts, words.ends)
        hashes = textual.span_hashes(words.body, words.starts[first], words.ends[first])
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(1, len(order) + 1)
        self.hashes, first = hashes[order], first[order]
        self.body, self.word_at, self.word_size = words.body, words.starts[first], (words.ends - words.starts)[first]
        self.known = np.zeros(int(_BUCKETS) + 1, bool)
        self.known[(self.hashes & _BUCKETS).astype(np.int64)] = True
        self.bits = max(1, len(order).bit_length())
        codes, counts, owner = rank[which], words.counts, words.owner()
        self.items = sorted(set(ids))
        number = {x: k for k, x in enumerate(self.items)}
        item_of = np.array([number[x] for x in ids], np.int64)
        # One 0 after each item, so that a match never leaves it; enough of them at the end.
        at = np.arange(len(codes)) + owner
        self.text = np.zeros(len(codes) + len(ids) + width + 1, np.int32)
        self.text[at] = codes
        self.item = np.zeros(len(self.text), np.int64)
        self.item[at] = item_of[owner]
        self.start = np.zeros(len(self.text), np.int64)
        self.start[at] = np.arange(len(codes)) - words.first[owner]
        self.longest = int(counts.max(initial=0))
        left = words.first[owner + 1] - np.arange(len(codes)) if len(codes) else np.zeros(0, np.int64)
        whole = counts[owner] < width
        size = np.where(whole, left, width)
        begins = np.where(whole, self.start[at] == 0, left >= width)
        place_rank = np.empty(len(self.text), np.int64)
        place_rank[suffix_order(self.text, self.longest, self.bits)] = np.arange(len(self.text))
        self.sets: list[np.ndarray] = []
        named: dict[bytes, int] = {}
        self.classes = []
        for length in np.unique(size[begins]).tolist():
            own = at[begins & (size == length)]
            own = own[np.argsort(place_rank[own])]
            alike = agreed(self.text, own[1:], self.text, own[:-1], 0)
            new = np.concatenate([[True], alike < length])
            window = np.cumsum(new) - 1
            pairs = np.unique(np.stack([window, self.item[own]], 1), axis=0)
            bounds = np.searchsorted(pairs[:, 0], np.arange(int(window[-1]) + 2))
            set_of = np.zeros(len(bounds) - 1, np.int64)
            for k, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                items = pairs[lo:hi, 1]
                set_of[k] = named.setdefault(items.tobytes(), len(self.sets))
                if set_of[k] == len(self.sets):
                    self.sets.append(items)
            # Of suffixes that are equal to the ends of their items, one.
            single = np.concatenate([[True], (self.text[own[1:] + alike] != self.text[own[:-1] + alike])])
            self.classes.append({"length": length, "windows": own[new], "sets": set_of, "suffixes": own[single], "window_of": window[single]})
        self.least = min((c["length"] for c in self.classes), default=0)

    def codes_of(self, words: textual.Words, hashes: np.ndarray) -> np.ndarray:
        """The code of each word, 0 where the block hasn't it; a 0 more at the end."""
        codes = np.zeros(len(hashes) + 1, np.int32)
        live = np.flatnonzero(self.known[(hashes & _BUCKETS).astype(np.int64)])
        slot = np.searchsorted(self.hashes, hashes[live])
        while len(live):
            near = np.minimum(slot, len(self.hashes) - 1)
            there = (slot < len(self.hashes)) & (self.hashes[near] == hashes[live])
            live, slot = live[there], slot[there]
            size = words.ends[live] - words.starts[live]
            same = size == self.word_size[slot]
            same[same] = textual.same_spans(words.body, words.starts[live[same]], self.body, self.word_at[slot[same]], size[same])
            codes[live[same]] = slot[same] + 1
            live, slot = live[~same], slot[~same] + 1  # another word of the same hash
        return codes


def spread(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of many ranges, and the range that each came from."""
    sizes = stops - starts
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return starts[owner] + inner, owner


class Shard:
    """A block of documents: its words, and what was found in them so far."""

    def __init__(self, column: pa.Array):
        self.words = textual.words_of(column, textual.NOT_ALNUM, lower=True)
        self.hashes, self.counts, self.owner = self.words.hashes(), self.words.counts, self.words.owner()
        n = len(self.hashes)
        self.covered = np.zeros(n + 1, np.int32)
        self.best, self.best_at, self.best_block = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int32)
        self.named: list[list[tuple[int, bytes]]] = [[] for _ in self.counts]

    def search(self, number: int, block: TestBlock) -> None:
        n = len(self.hashes)
        if not block.classes or not n:
            return
        codes = block.codes_of(self.words, self.hashes)
        # Runs of words of the block in one document, of those that a window may fit in.
        edge = np.zeros(n + 1, bool)
        edge[self.words.first] = True
        inside = codes[:n] > 0
        opens = np.flatnonzero(inside & (edge[:n] | ~np.concatenate([[False], inside[:-1]])))
        stops = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
        fits = stops - opens >= block.least
        word, run = spread(opens[fits], stops[fits])
        if not len(word):
            return
        place = np.arange(len(word)) + run
        text = np.zeros(len(word) + int(fits.sum()) + max(WIDTH, block.longest) + 1, np.int32)
        text[place] = codes[word]
        word_of = np.zeros(len(text), np.int64)
        word_of[place] = word
        array = suffix_order(text, block.longest, block.bits)
        keys = _packed(text, block.bits)[array]
        sets: list[np.ndarray] = []
        for c in block.classes:
            lo, hi = self._ranges(text, array, keys, block, c["windows"], c["length"])
            rows, window = spread(lo, hi)
            if not len(rows):
                continue
            at = array[rows]
            hit = word_of[at]
            np.add.at(self.covered, hit, 1)
            np.add.at(self.covered, hit + c["length"], -1)
            sets.append(np.unique(self.owner[hit] * np.int64(len(block.sets)) + c["sets"][window]))
            size, test = self._longest(text, array, block, c, lo, hi, rows, window)
            better = size > self.best[hit]
            hit = hit[better]
            self.best[hit], self.best_at[hit], self.best_block[hit] = size[better], test[better], number
        if sets:
            pairs = np.unique(np.concatenate(sets))
            doc, which = pairs // len(block.sets), pairs % len(block.sets)
            cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]]))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                self.named[int(doc[a])].append((number, which[a:b].tobytes()))

    @staticmethod
    def _ranges(text, array, keys, block: TestBlock, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The range of the suffix array whose suffixes begin with each window."""
        each = max(1, 63 // block.bits)
        depth = min(length, each)
        wanted = np.zeros(len(windows), np.int64)
        for k in range(depth):
            wanted = (wanted << block.bits) | block.text[windows + k]
        rest = block.bits * (each - depth)
        lo = np.searchsorted(keys, wanted << rest, "left")
        hi = np.searchsorted(keys, ((wanted + 1) << rest) - 1, "right")
        live = np.flatnonzero(hi > lo)
        if length > each and len(live):
            begin, end = lo[live], hi[live]
            for side in (lo, hi):
                a, b = begin.copy(), end.copy()
                while (open_ := a < b).any():
                    mid = (a + b) // 2
                    at = array[np.minimum(mid, len(array) - 1)]
                    size = agreed(text, at, block.text, windows[live], depth, length)
                    less = np.where(size < length, text[at + size] < block.text[windows[live] + size], side is hi)
                    a, b = np.where(open_ & less, mid + 1, a), np.where(open_ & ~less, mid, b)
                side[live] = a
        return lo, np.maximum(lo, hi)

    @staticmethod
    def _longest(text, array, block: TestBlock, c: dict, lo, hi, rows, window) -> tuple[np.ndarray, np.ndarray]:
        """For each hit, the length of its longest match and where in the block's text it begins."""
        length = c["length"]
        some = np.flatnonzero(hi[c["window_of"]] > lo[c["window_of"]])
        test, of = c["suffixes"][some], c["window_of"][some]
        a, b = lo[of].copy(), hi[of].copy()
        while (open_ := a < b).any():
            mid = (a + b) // 2
            at = array[np.minimum(mid, len(array) - 1)]
            size = agreed(text, at, block.text, test, length)
            less = text[at + size] < block.text[test + size]
            a, b = np.where(open_ & less, mid + 1, a), np.where(open_ & ~less, mid, b)
        # Test suffixes are sorted; those of a hit's window are its neighbours, one before and one after.
        span = np.int64(len(array) + 1)
        after = np.searchsorted(of * span + a, window * span + rows, "right")
        at = array[rows]
        best, where = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for near in (after - 1, after):
            near = np.clip(near, 0, len(test) - 1)
            own = np.flatnonzero(of[near] == window)
            size = agreed(text, at[own], block.text, test[near[own]], length)
            better = size > best[own]
            own, size = own[better], size[better]
            best[own], where[own] = size, test[near[own]]
        return best, where

    def findings(self, blocks: list[TestBlock | tuple], digests: dict) -> pa.StructArray:
        first, rows = self.words.first, len(self.counts)
        hit = np.concatenate([[0], np.cumsum(np.cumsum(self.covered[:-1]) > 0)])
        n_items, sha = np.zeros(rows, np.int64), []
        for d, named in enumerate(self.named):
            got = digests.get(tuple(named))
            if got is None:
                items = sorted({blocks[k][0][i] for k, which in named for s in np.frombuffer(which, np.int64) for i in blocks[k][1][s]})
                got = (len(items), hashlib.sha256(",".join(items).encode()).hexdigest())
                if len(digests) < _DIGESTS:
                    digests[tuple(named)] = got
            n_items[d] = got[0]
            sha.append(got[1])
        # Matches that none contains: the word before begins no match that is longer by it.
        inner = np.concatenate([[False], (self.best[1:] > 0) & (self.best[:-1] > self.best[1:])])[: len(self.best)]
        inner[first[:-1][first[:-1] < len(inner)]] = False
        at = np.flatnonzero((self.best > 0) & ~inner)
        longest = np.zeros(rows, np.int64)
        np.maximum.at(longest, self.owner[at], self.best[at])
        block, test = self.best_block[at].tolist(), self.best_at[at].tolist()
        names = pa.array([blocks[k][0][blocks[k][2][i]] for k, i in zip(block, test, strict=True)], pa.string())
        starts = pa.array([int(blocks[k][3][i]) for k, i in zip(block, test, strict=True)], pa.int64())
        match = pa.StructArray.from_arrays([names, starts, pa.array(at - first[self.owner[at]]), pa.array(self.best[at])], ["item_id", "item_start", "doc_start", "words"])
        matches = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, first).astype(np.int32)), match)
        numbers = [self.counts.astype(np.int64), (hit[first[1:]] - hit[first[:-1]]).astype(np.int64), n_items]
        return pa.StructArray.from_arrays([*map(pa.array, numbers), pa.array(sha, pa.string()), pa.array(longest), matches], ["n_words", "n_hit", "n_items", "items_sha256", "longest_words", "matches"])


def read_blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[tuple[list[str], list[str]]]:
    """The benchmark's different rows in blocks of about ``block_bytes``, each collected on its own."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    kept = materialize(rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)).cast("int")), by="block") if blocks > 1 else rows
    for k in range(blocks):
        got = (kept.where(F.col("block") == k) if blocks > 1 else kept).orderBy("item", "text").collect()
        yield [r["item"] for r in got], [r["text"] for r in got]
    if blocks > 1:
        discard(kept)


def forget(block) -> None:
    """Drop a broadcast's value from this process; it is read from its local file again when asked for."""
    vars(block).pop("_value", None)


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", width: int = WIDTH, into: str = "leaks", block_bytes: int = 8 << 20) -> DataFrame:
    """Add the struct ``into``: n_words, n_hit, n_items, items_sha256, longest_words and matches.

    ``matches`` are the longest verbatim matches: for each place of the document where
    one begins that no other contains, how many words, and an item and place that has them.
    """
    if into in docs.columns:
        raise ValueError(f"the documents have a column {into!r} already")
    sc = docs.sparkSession.sparkContext
    blocks = []
    for ids, texts in read_blocks(benchmark, item, text, block_bytes):
        blocks.append(sc.broadcast(TestBlock(ids, texts, width)))
        forget(blocks[-1])
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T._parse_datatype_string(FINDINGS))])
    place = docs.columns.index(text)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests: dict = {}
        for batch in batches:
            column = batch.column(place)
            for begin, end in row_blocks(column, _TOGETHER):
                parts = [(begin + lo, begin + hi) for lo, hi in row_blocks(column.slice(begin, end - begin), _SHARD)]
                shards = [Shard(column.slice(lo, hi - lo)) for lo, hi in parts]
                names = []
                for number, held in enumerate(blocks):
                    block = held.value
                    for shard in shards:
                        shard.search(number, block)
                    names.append((block.items, block.sets, block.item, block.start))
                    del block
                    if len(blocks) > 1:
                        forget(held)
                for (lo, hi), shard in zip(parts, shards, strict=True):
                    yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, shard.findings(names, digests)], schema.names)

    return docs.mapInArrow(search, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs."""
    leaks = fresh_name(docs, "leaks")
    found = find_leaks(docs, benchmark, into=leaks, **how)
    return found.where(F.col(leaks)["n_hit"] == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
