"""Operator 7: removal of repeated byte strings by bounded interval expansion on a BWT.

A byte goes if a string of ``LEAST`` bytes that covers it also starts in a
document with a smaller id. The work is split so that equal strings meet:

1. Every window of ``LEAST`` bytes is owned by one of its grams, picked by the
   window's bytes alone. A document's windows so form short runs, one an owner.
2. Owners' hashes, a few bytes each, are dealt out by hash; those of a single
   document end here. An owner that a block of documents repeats is sent twice.
3. The windows of the rest, as the bytes that they span, are dealt out by owner.
   Equal spans are one. Where an owner has different spans, their text gets a
   suffix order and its Burrows-Wheeler transform, and all string intervals are
   extended backward one byte at a time, breadth first: a boundary between
   neighbours that appears at length v is a common prefix of v - 1. It stops at
   ``LEAST``; suffixes that no boundary parts share that many bytes.
4. The smallest document of each interval stays; windows of the others go back
   to their documents as bit masks, where they become removed runs.

Texts are shuffled once, by row, and the shuffle serves steps 3 and 4. No group
of copies is expanded to pairs; a task's memory is a share of the windows.

Defined results: a null text is empty; a text shorter than ``LEAST`` stays whole;
rows with equal ids don't remove from each other; a row without an id is kept
whole and removes nothing; an empty table gives no rows. Ids are integers. Extra
columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textual
from .shared import row_blocks

LEAST = 50
GRAM = 20
_BLOCK = 3 << 19
#: Bytes of spans whose suffixes are ordered at once; one owner's spans stay together.
_SORTED = 1 << 20
_LOW = np.uint64(0xFFFFFFFF)
#: Bytes of text for each task of a shuffle.
_SHARE = 8 << 20


def owned_windows(body: np.ndarray, offsets: np.ndarray, least: int = LEAST, gram: int = GRAM):
    """Runs of windows of ``least`` bytes that share their smallest ``gram``: (text, first, last, hash).

    The owner of a window is the leftmost of its grams with the smallest hash,
    which its bytes alone decide: equal windows of any texts have equal owners.
    ``first`` and ``last`` are the places in ``body`` where the windows begin.
    """
    n, width = len(body), least - gram + 1
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none, none, np.zeros(0, np.uint64)
    h = textual.gram_hashes(body, gram)
    place = np.uint64((1 << 30) - 1)
    low = h & ~place
    low |= np.arange(len(h), dtype=np.uint64)
    size = 1
    while size < width:
        step = min(size, width - size)
        low = np.minimum(low[:-step], low[step:])
        size += step
    owner = (low & place).astype(np.int32)
    del low
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))[: len(owner)]
    fits = np.zeros(len(owner) + least, bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        fits[a : max(a, b - least + 1)] = True
    at = np.flatnonzero(fits[: len(owner)])
    if not len(at):
        return none, none, none, np.zeros(0, np.uint64)
    own = owner[at]
    whose = text[at]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (whose[1:] != whose[:-1])])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    return whose[begin].astype(np.int64), at[begin], at[end], h[own[begin]]


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, group of each in order) of equal keys."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _narrow(x: np.ndarray) -> bytes:
    kind = "B" if not len(x) or x.max() < 256 else "<u2" if x.max() < 65536 else "<u4"
    return {"B": b"1", "<u2": b"2", "<u4": b"4"}[kind] + x.astype(kind).tobytes()


def _wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x, {49: "B", 50: "<u2", 52: "<u4"}[x[0]], offset=1).astype(np.int64)


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values))


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order, starts, _ = _groups(bucket)
    for lo, hi in zip(starts, np.append(starts, len(order))[1:], strict=True):
        yield int(bucket[order[lo]]), order[lo:hi]


def _per_text(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of sorted entries, and how many entries each has."""
    at = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.zeros(0, np.int64)
    return text[at], np.diff(np.append(at, len(text)))


def _blocks(batches: Iterator[pa.RecordBatch], column: str):
    for batch in batches:
        place = batch.schema.get_field_index(column)
        for lo, hi in row_blocks(batch.column(place), _BLOCK):
            yield batch.slice(lo, hi - lo)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


_HOME = "home int, rids binary, counts binary, found binary"


def _homeward(rid: np.ndarray, found: np.ndarray, homes: int) -> pa.RecordBatch:
    """What was found for rows, packed by the task that gathers a row's findings."""
    order = np.lexsort((rid, rid % homes))
    rid, found = rid[order], found[order]
    rows = []
    for home, own in _by_bucket(rid % homes):
        rids, counts = _per_text(rid[own])
        rows.append((home, rids.tobytes(), _narrow(counts), found[own].astype(np.int64).tobytes()))
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], ["home", "rids", "counts", "found"])


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, found): one row for each rid; a task has all findings of its rids."""
    rids, found = [], []
    for batch in batches:
        for rid, counts, values in zip(*[batch.column(k).to_pylist() for k in (1, 2, 3)], strict=True):
            rids.append(np.repeat(np.frombuffer(rid, np.int64), _wide(counts)))
            found.append(np.frombuffer(values, np.int64))
    if rids:
        rid, value = np.concatenate(rids), np.concatenate(found)
        order, starts, _ = _groups(rid)
        for lo in range(0, len(starts), 10_000):
            part = starts[lo : lo + 10_000]
            end = starts[lo + 10_000] if lo + 10_000 < len(starts) else len(order)
            own = order[part[0] : end]
            yield pa.RecordBatch.from_arrays([pa.array(rid[order[part]]), _lists(value[own], part - part[0])], ["rid", "found"])


_OWNERS = "bucket int, rids binary, counts binary, ords binary, hashes binary"


def emit_owners(buckets: int):
    """Step 2, map side: owners' hashes by bucket; owners that the block itself repeats are told apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches, "text"):
            rid = _column(batch, "rid").astype(np.int64)
            body, offsets = textual.buffer_of(batch.column(batch.schema.get_field_index("text")))
            text, _, _, h = owned_windows(body, offsets)
            ordinal = np.arange(len(text)) - np.searchsorted(text, text)
            order, starts, group = _groups(h)
            mine = rid[text[order]]
            other = np.flatnonzero(mine != mine[starts][group]) if len(starts) else starts
            second = other[np.unique(group[other], return_index=True)[1]]
            sent = np.ones(len(order), bool)
            repeated = np.zeros(len(starts), bool)
            repeated[group[second]] = True
            sent[repeated[group]] = False
            sent[starts] = True
            sent[second] = True
            rows: list[tuple] = []

            def packed(bucket: int, own: np.ndarray, hashes: bytes | None, rid=rid, text=text, ordinal=ordinal, rows=rows):
                texts, counts = _per_text(text[own])
                rows.append((bucket, rid[texts].tobytes(), _narrow(counts), _narrow(ordinal[own]), hashes))

            known = np.sort(order[~sent])
            if len(known):
                packed(int(h[known[0]] >> np.uint64(40)) % buckets, known, None)
            sent = np.sort(order[sent])
            for bucket, own in _by_bucket(((h[sent] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)):
                own = sent[own]
                packed(bucket, own, (h[own] & _LOW).astype("<u4").tobytes())
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], ["bucket", "rids", "counts", "ords", "hashes"])

    return run


def repeated_owners(homes: int):
    """Step 2, reduce side: the owners that texts of two rows have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for bucket, rids, counts, ords, hashes in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rid = np.repeat(np.frombuffer(rids, np.int64), _wide(counts))
                if hashes is None:
                    yield _homeward(rid, _wide(ords), homes)
                else:
                    held.setdefault(bucket, []).append((rid, _wide(ords).astype(np.int32), np.frombuffer(hashes, "<u4")))
        for parts in held.values():
            rid, ordinal, key = (np.concatenate([p[i] for p in parts]) for i in range(3))
            parts.clear()
            order, starts, group = _groups(key)
            mine = rid[order]
            twice = (np.minimum.reduceat(mine, starts) != np.maximum.reduceat(mine, starts))[group]
            yield _homeward(mine[twice], ordinal[order][twice], homes)

    return run


_SPANS = "bucket int, rids binary, keys binary, counts binary, starts binary, extra binary, owners binary, bytes binary"


def emit_spans(buckets: int):
    """Step 3, map side: the bytes of windows with repeated owners, by owner.

    Of equal spans in the block only the smallest document's is sent; the others'
    windows are known to go, and pass through the shuffle as masks alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(3)
        for batch in _blocks(batches, "text"):
            rid, key = _column(batch, "rid").astype(np.int64), _column(batch, "key").astype(np.int64)
            body, offsets = textual.buffer_of(batch.column(batch.schema.get_field_index("text")))
            text, first, last, h = owned_windows(body, offsets)
            lists = batch.column(batch.schema.get_field_index("ords"))
            ords = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.array([len(x) for x in lists], np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            own = np.unique(np.searchsorted(text, row) + ords)
            text, first, last, h = text[own], first[own], last[own], h[own]
            one, which = textual.distinct_spans(body, first, last + LEAST)
            mine = key[text]
            least = mine[one]
            np.minimum.at(least, which, mine)
            gone, sent = np.flatnonzero(mine > least[which]), np.flatnonzero(mine == least[which])
            rows: list[tuple] = []

            def packed(bucket, own, raw, rid=rid, key=key, text=text, first=first, last=last, h=h, offsets=offsets, rows=rows):
                texts, counts = _per_text(text[own])
                at, more = first[own] - offsets[text[own]], last[own] - first[own]
                owners = None if raw is None else (h[own] & _LOW).astype("<u4").tobytes()
                rows.append((bucket, rid[texts].tobytes(), key[texts].tobytes(), _narrow(counts), _narrow(at), _narrow(more), owners, raw))

            if len(gone):
                packed(int(h[gone[0]] >> np.uint64(40)) % buckets, gone, None)
            for bucket, mine in _by_bucket(((h[sent] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)):
                mine = sent[mine]
                packed(bucket, mine, press.compress(b"".join([body[a:b].tobytes() for a, b in zip(first[mine].tolist(), (last[mine] + LEAST).tolist(), strict=True)])))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            names = [x.split()[0] for x in _SPANS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names)

    return run


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``codes`` sorted by the ``depth`` codes, or more, that follow; doubling what is compared."""
    n = len(codes)
    padded = np.concatenate([codes, np.zeros(8, codes.dtype)])
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | padded[k : n + k].astype(np.uint64)
    known = 7
    order = np.argsort(key, kind="stable")
    while True:
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
        if known >= depth or rank[order[-1]] == n - 1:
            return order
        after = np.concatenate([rank[known:] + 1, np.zeros(min(known, n), np.int64)])[:n]
        key = rank * np.int64(n + 1) + after
        order = np.argsort(key, kind="stable")
        known *= 2


def prefix_intervals(codes: np.ndarray, least: int) -> np.ndarray:
    """For each place of ``codes``, the number of its interval of equal prefixes of ``least`` codes.

    The interval of each string w lies between boundaries of the suffix order.
    Extending all intervals backward by the byte that the Burrows-Wheeler
    transform holds gives those of the strings cw: two neighbours part at length
    v + 1 if they begin alike and what follows parts at length v. Boundaries so
    appear in the order of the common prefix; only neighbours not yet parted are
    looked at, and none beyond ``least``.
    """
    n = len(codes)
    order = suffix_order(codes, least)
    transform = codes[order - 1]
    # Rows by the byte before them, ties in order: row r came by backward extension from row back[r].
    # Suffixes that tie as far as they were compared may change places; they share all intervals.
    back = np.argsort(transform, kind="stable")
    first = codes[order]
    part = np.concatenate([[True], first[1:] != first[:-1]])
    number = np.cumsum(part)
    whole = np.flatnonzero(~part)
    for _ in range(1, least):
        if not len(whole):
            break
        new = number[back[whole]] != number[back[whole - 1]]
        if new.any():
            part[whole[new]] = True
            number = np.cumsum(part)
            whole = whole[~new]
    out = np.empty(n, np.int64)
    out[order] = number
    return out


def later_windows(spans: list[bytes], owners: np.ndarray, least_key: np.ndarray) -> np.ndarray:
    """For each different span, the bits of its windows that a span of a smaller document has."""
    mask = np.zeros(len(spans), np.uint32)
    order, starts, group = _groups(owners)
    shared = (np.diff(np.append(starts, len(order))) > 1)[group]
    order, group = order[shared], group[shared]
    size = 0
    batch: list[int] = []
    for k, i in enumerate(order.tolist()):
        if size >= _SORTED and group[k] != group[k - 1]:
            _mark_batch(spans, np.array(batch), least_key, mask)
            batch, size = [], 0
        batch.append(i)
        size += len(spans[i])
    if batch:
        _mark_batch(spans, np.array(batch), least_key, mask)
    return mask


def _mark_batch(spans: list[bytes], own: np.ndarray, least_key: np.ndarray, mask: np.ndarray) -> None:
    text = b"".join([x for i in own.tolist() for x in (spans[i], b"\n")])
    sizes = np.array([len(spans[i]) for i in own], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    codes = np.frombuffer(text, np.uint8).astype(np.uint16) + 1
    codes[begin + sizes] = 0
    number = prefix_intervals(codes, LEAST)
    windows = sizes - LEAST + 1
    which = np.repeat(np.arange(len(own)), windows)
    shift = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    interval = number[begin[which] + shift]
    order, starts, group = _groups(interval)
    key = least_key[own[which]]
    smallest = np.empty(len(key), np.int64)
    smallest[order] = np.minimum.reduceat(key[order], starts)[group]
    late = smallest < key
    np.bitwise_or.at(mask, own[which[late]], (np.uint32(1) << shift[late].astype(np.uint32)))


def mark_windows(homes: int):
    """Step 3, reduce side: the windows that go, each mark a place and a bit mask."""
    every = lambda more: ((np.uint64(1) << (more + 1).astype(np.uint64)) - np.uint64(1)).astype(np.int64)

    def out(rid, start, mask) -> pa.RecordBatch:
        some = mask != 0
        return _homeward(rid[some], (start[some] << 32) | mask[some], homes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for bucket, rids, keys, counts, starts, extra, owners, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                n = _wide(counts)
                rid, key = np.repeat(np.frombuffer(rids, np.int64), n), np.repeat(np.frombuffer(keys, np.int64), n)
                start, more = _wide(starts), _wide(extra)
                if raw is None:
                    yield out(rid, start, every(more))
                else:
                    held.setdefault(bucket, []).append((rid, key, start, more, np.frombuffer(owners, "<u4"), raw))
        for parts in held.values():
            rid, key, start, more, owner = (np.concatenate([p[i] for p in parts]) for i in range(5))
            body = np.frombuffer(b"".join([unpress.decompress(p[5]) for p in parts]), np.uint8)
            parts.clear()
            ends = np.cumsum(more + LEAST)
            begin = ends - more - LEAST
            one, which = textual.distinct_spans(body, begin, ends)
            least = key[one]
            np.minimum.at(least, which, key)
            spans = [body[a:b].tobytes() for a, b in zip(begin[one].tolist(), ends[one].tolist(), strict=True)]
            late = later_windows(spans, owner[one], least)
            yield out(rid, start, np.where(key > least[which], every(more), late[which].astype(np.int64)))

    return run


_RESULT = "key {}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def _cut(texts: bool):
    """Step 4: masks become removed runs of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches, "text"):
            body, offsets = textual.buffer_of(batch.column(batch.schema.get_field_index("text")))
            lists = batch.column(batch.schema.get_field_index("marks"))
            sizes = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], np.int64)
            mark = lists.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at, mask = offsets[np.repeat(np.arange(len(sizes)), sizes)] + (mark >> 32), mark & 0xFFFFFFFF
            change = np.zeros(len(body) + 1, np.int64)
            for bit in range(LEAST - GRAM + 1):
                begin = at[(mask >> bit) & 1 == 1] + bit
                change += np.bincount(begin, minlength=len(change)) - np.bincount(begin + LEAST, minlength=len(change))
            gone = np.cumsum(change[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            edge = np.zeros(len(body) + 1, bool)
            edge[offsets] = True
            opens = gone & (~np.concatenate([[False], gone[:-1]]) | edge[:-1]) if len(body) else gone
            runs = np.concatenate([[0], np.cumsum(opens)])
            kept = body[~gone].tobytes()
            lo = offsets - total[offsets]
            left = [kept[a:b] for a, b in zip(lo[:-1].tolist(), lo[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("key")),
                    pa.array(np.diff(offsets)),
                    pa.array(np.diff(total[offsets])),
                    pa.array(np.diff(runs[offsets])),
                    pa.array([hashlib.sha256(x).hexdigest() for x in left]),
                    pa.array([x.decode(errors="replace") if texts else None for x in left], pa.string()),
                ],
                ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
            )

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", texts: bool = True, share: int = _SHARE) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, kept_text): a row for each input row.

    ``kept_text`` is the remaining bytes as text, a cut character replaced; with
    ``texts`` False it is null. ``share`` is the bytes of text for each task of a
    shuffle, on average: a task's memory doesn't grow with the table.
    """
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(4, -(-int(total) // share))
    buckets = max(4, parts // 2)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select(F.xxhash64("key", "text").alias("rid"), "key", "text")
    dealt = rows.repartition(parts, "rid")
    owners = rows.where("key is not null").select("rid", "text").mapInArrow(emit_owners(buckets), _OWNERS)
    again = owners.repartition(buckets, "bucket").mapInArrow(repeated_owners(parts), _HOME)
    again = again.repartition(parts, "home").mapInArrow(gather, "rid long, found array<long>").withColumnRenamed("found", "ords")
    spans = dealt.join(again, "rid").select("rid", "key", "text", "ords").mapInArrow(emit_spans(parts), _SPANS)
    marks = spans.repartition(parts, "bucket").mapInArrow(mark_windows(parts), _HOME)
    marks = marks.repartition(parts, "home").mapInArrow(gather, "rid long, found array<long>").withColumnRenamed("found", "marks")
    found = dealt.join(marks, "rid", "left").select("key", "text", "marks")
    return found.mapInArrow(_cut(texts), _RESULT.format(kind)).withColumnRenamed("key", key)
