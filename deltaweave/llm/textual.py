"""Vectorised word spans and hashes over the UTF-8 bytes of Arrow text columns.

Everything works on a block of texts at once: one byte buffer, the byte offset
of each text, and the spans of its words. Word delimiters are ASCII only, so
bytes of multi-byte characters always belong to words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        factors = np.full(max(n, 1 << 16), _BASE if kind == "up" else _INVERSE, np.uint64)
        factors[0] = 1
        have = np.cumprod(factors)
        if n <= 1 << 22:
            _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: spreads every input bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def delimiters(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, False for the delimiter bytes in ``ranges`` (inclusive)."""
    flags = np.ones(256, bool)
    for lo, hi in ranges:
        flags[lo : hi + 1] = False
    return flags


WHITE = delimiters((0x09, 0x0D), (0x20, 0x20))
NOT_ALNUM = delimiters((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
NOT_LETTER = delimiters((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column (null: empty) and the offsets of its rows, from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    lo, hi = int(offsets[0]), int(offsets[-1])
    body = np.frombuffer(data, np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
    return body, offsets - lo


@dataclass
class Words:
    """Words of a block: spans in ``body``, and ``first[d]:first[d+1]`` for text d."""

    body: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.body, self.starts, self.ends)


def words_of(column: pa.Array, inside: np.ndarray, lower: bool = False) -> Words:
    body, offsets = buffer_of(column)
    if lower:
        body = LOWER[body]
    n = len(body)
    flag = np.zeros(n + 2, bool)
    flag[1:-1] = inside[body]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    opens = flag[1:] & (~flag[:-1] | edge)
    closes = flag[:-1] & (~flag[1:] | edge)
    starts = np.flatnonzero(opens)
    return Words(body, offsets, starts, np.flatnonzero(closes), np.searchsorted(starts, offsets))


def _eights(body: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``body`` as one number; zeros follow its end."""
    padded = np.concatenate([body, np.zeros(8, np.uint8)])
    return np.ndarray((len(body) + 1,), "<u8", padded, 0, (1,))


_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans beyond this many bytes are hashed one by one by the library.
_SHORT = 96


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal spans have equal hashes, and :func:`same_spans` tells whether the converse holds.

    Eight bytes at a time are mixed in, for all spans at once; long ones go through xxh3.
    """
    sizes = ends - starts
    if not len(starts):
        return np.zeros(0, np.uint64)
    eights = _eights(body)
    out = mix(sizes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    live = np.flatnonzero((sizes > 0) & (sizes <= _SHORT))
    at, left = starts[live], sizes[live]
    while len(live):
        piece = eights[at] & _KEEP[np.minimum(left, 8)]
        out[live] = mix((out[live] ^ piece) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x2545F4914F6CDD1D))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    raw = memoryview(np.ascontiguousarray(body))
    for i in np.flatnonzero(sizes > _SHORT).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]])
    return out


def same_spans(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the bytes of ``a`` and ``b`` from these places agree over ``sizes`` bytes, span by span."""
    same = np.ones(len(sizes), bool)
    x, y = _eights(a), _eights(b)
    live = np.flatnonzero((sizes > 0) & (sizes <= _SHORT))
    p, q, left = a_at[live], b_at[live], sizes[live]
    while len(live):
        keep = _KEEP[np.minimum(left, 8)]
        alike = (x[p] & keep) == (y[q] & keep)
        same[live[~alike]] = False
        more = alike & (left > 8)
        live, p, q, left = live[more], p[more] + 8, q[more] + 8, left[more] - 8
    for i in np.flatnonzero(sizes > _SHORT).tolist():
        same[i] = np.array_equal(a[a_at[i] : a_at[i] + sizes[i]], b[b_at[i] : b_at[i] + sizes[i]])
    return same


def distinct_spans(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, which): a span of each different byte string, and the number of each span's string.

    Hashes bring equal spans together; bytes decide.
    """
    coded = pa.array(span_hashes(body, starts, ends)).dictionary_encode()
    which = coded.indices.to_numpy().astype(np.int64)
    first = np.zeros(len(coded.dictionary), np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    one = first[which]
    sizes = ends - starts
    good = sizes == sizes[one]
    good[good] = same_spans(body, starts[good], body, starts[one[good]], sizes[good])
    if good.all():
        return first, which
    extra: dict[bytes, int] = {}  # spans whose hash another string has
    for i in np.flatnonzero(~good).tolist():
        word = body[starts[i] : ends[i]].tobytes()
        if word not in extra:
            extra[word] = len(first)
            first = np.append(first, i)
        which[i] = extra[word]
    return first, which


def gram_hashes(body: np.ndarray, size: int) -> np.ndarray:
    """Numbers of all spans of ``size`` bytes that equal spans share; they pick places, and never decide equality.

    Prefix sums of a polynomial in an odd base, with few arrays of the body's length at once.
    """
    sums = np.zeros(len(body) + 1, np.uint64)
    terms = body.astype(np.uint64)
    terms += np.uint64(1)
    terms *= _power("up", len(body))
    np.cumsum(terms, out=sums[1:])
    del terms
    raw = sums[size:] - sums[:-size]
    del sums
    raw *= _power("down", len(body))[: len(raw)]
    raw ^= np.uint64(size << 48)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        raw ^= raw >> np.uint64(shift)
        raw *= np.uint64(factor)
    return raw
