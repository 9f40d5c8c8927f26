"""Operator 2: near-duplicate classes by DartMinHash signatures.

A text is the set of hashes of its runs of five words (all its words, if fewer).
Each element owns a region of width ``weight`` (1, or its count) in which darts
are thrown: along the rank axis the darts of a unit cell arrive as a Poisson
process driven by hashes of (element, cell, dart number), so equal elements
throw equal darts in every text. Darts beyond an element's weight are refused;
of the darts that are kept, the earliest per coordinate is the signature. Only
about ``k ln k + 2k`` darts are looked at in a text, however long it is; a
coordinate that none has hit makes the text look further.

Equal sets are one class at once. The others meet in buckets of banded
coordinates, never as all pairs of a bucket: each bucket names its smallest
member and links the rest to it, then the members that this did not join choose
among themselves. What is still apart in a small bucket is compared with the
bucket's other components; what is apart in a bucket of more than ``SMALL`` is
compared with the whole bucket too, in blocks that are dealt out to tasks and go
through an index of shingles, which makes no row but for a link. Every link is verified on the whole texts, and
components are found by passing smallest labels, in tables on the shared folder.

The similarity is that of sets, so every weight is 1; with ``weighted`` it is
that of multisets, and a shingle's weight is its count.

Defined results: a text without words (null and empty ones too) has no partner;
repeated rows are one class, as are rows with equal ids, each of whose texts links
to others'; an empty table gives no rows. Ids are integers. Extra columns of the input don't matter. A row without an id gets the
class of an equal text with one, else none; ``drop_near_duplicates`` keeps it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textual
from .shared import discard, forget, lean, lookup, materialize, materialize_counted, row_blocks

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 6
SMALL = 24
_BLOCK = 2 << 20
_QUERIES = 4 << 20  # bytes of texts in a block of a crowded bucket
_MATCHES = 1 << 20  # shingle matches that are counted at once, or those of one text


def shingles(column: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct runs of ``size`` words of a block of texts, sorted."""
    words = textual.words_of(column, textual.WHITE)
    h, counts, n = words.hashes(), words.counts, len(words.starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = words.owner()
    left = words.first[owner + 1] - np.arange(n)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        shifted = np.zeros(n, np.uint64)
        shifted[: max(0, n - k)] = h[k:]
        inside = (left > k).astype(np.uint64)
        total += textual.mix(shifted * np.uint64(2 * k + 1)) * np.uint64(2 * k + 3) * inside
    begins = (left >= size) | ((counts[owner] < size) & (np.arange(n) == words.first[owner]))
    doc, key = owner[begins], textual.mix(total[begins])
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
    at = np.flatnonzero(fresh)
    return doc[at], key[at], np.diff(np.append(at, len(doc)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def dart_signatures(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, texts: int, k: int) -> np.ndarray:
    """A row of ``k`` 64-bit values for each text: for each coordinate, the earliest dart's identity.

    Texts agree in a coordinate with the probability of their weighted Jaccard
    similarity. Rows of texts without elements are zero.
    """
    signature = np.zeros((texts, k), np.uint64)
    total = np.bincount(doc, weight, texts)
    # A unit cell for each whole step of weight; the last one may be cut.
    cells = np.ceil(weight).astype(np.int64)
    element = np.repeat(np.arange(len(doc)), cells)
    cell = np.arange(int(cells.sum())) - np.repeat(np.cumsum(cells) - cells, cells)
    seed = textual.mix(key[element] ^ textual.mix(cell.astype(np.uint64) + np.uint64(0x51ED270B)))
    room = weight[element] - cell
    darts = k * np.log(k) + 2 * k
    todo = np.flatnonzero(total > 0)
    while len(todo):
        limit = np.zeros(texts)
        limit[todo] = darts / total[todo]
        alive = np.flatnonzero(limit[doc[element]] > 0)
        until = limit[doc[element[alive]]]
        rank = np.zeros(len(alive))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        number = 0
        while len(alive):
            dart = textual.mix(seed[alive] + np.uint64((number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            rank = rank - np.log(_uniform(dart))
            inside = rank < until
            alive, rank, until, dart = alive[inside], rank[inside], until[inside], dart[inside]
            held = _uniform(textual.mix(dart ^ np.uint64(0xA5A5A5A5))) < room[alive]
            slot = doc[element[alive[held]]] * k + (textual.mix(dart[held] ^ np.uint64(0x3C3C3C3C)) % np.uint64(k)).astype(np.int64)
            found.append((slot, rank[held], dart[held]))
            number += 1
        slot, rank, dart = (np.concatenate([f[i] for f in found]) for i in range(3))
        order = np.lexsort((rank, slot))
        slot, dart = slot[order], dart[order]
        first = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, bool)
        hit = np.zeros(texts * k, bool)
        hit[slot[first]] = True
        values = np.zeros(texts * k, np.uint64)
        values[slot[first]] = dart[first]
        full = hit.reshape(texts, k).all(1)
        done = todo[full[todo]]
        signature[done] = values.reshape(texts, k)[done]
        todo = todo[~full[todo]]
        darts *= 2
    return signature


def sketch(docs: DataFrame, key: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS, weighted: bool = False) -> DataFrame:
    """(id, words_hash, bands): the set's address (null: no words) and a hash of each band."""
    schema = f"id {docs.schema[key].dataType.simpleString()}, address binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for lo, hi in row_blocks(batch.column(1), _BLOCK):
                n = hi - lo
                doc, element, count = shingles(batch.column(1).slice(lo, n))
                weight = count.astype(np.float64) if weighted else np.ones(len(doc))
                signature = dart_signatures(doc, element, weight, n, bands * rows)
                banded = signature.reshape(n, bands, rows)
                hashed = np.zeros((n, bands), np.uint64)
                for k in range(rows):
                    hashed = textual.mix(hashed * np.uint64(3) + banded[:, :, k])
                hashed = textual.mix(hashed + np.arange(bands, dtype=np.uint64))
                # Two independent sums over the set: 128 bits that only equal sets share.
                sums = [np.zeros(n, np.uint64) for _ in range(2)]
                mass = count.astype(np.uint64) if weighted else np.uint64(1)
                for s, salt in zip(sums, (0x1234567, 0x89ABCDE), strict=True):
                    np.add.at(s, doc, textual.mix(element ^ np.uint64(salt)) * mass)
                some = np.bincount(doc, minlength=n) > 0
                both = np.stack(sums, 1).tobytes()
                address = [both[16 * i : 16 * i + 16] if some[i] else None for i in range(n)]
                offsets = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashed[some].view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(address, pa.binary()), lists], ["id", "address", "bands"])

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(lean(run), schema)


def jaccard(a: pa.Array, b: pa.Array, weighted: bool = False) -> np.ndarray:
    """The similarity of the shingle sets of pairs of texts."""
    n = len(a)
    (da, ka, ca), (db, kb, cb) = shingles(a), shingles(b)
    if not weighted:
        ca, cb = np.ones(len(ca), np.int64), np.ones(len(cb), np.int64)
    doc, key, count = np.concatenate([da, db]), np.concatenate([ka, kb]), np.concatenate([ca, cb])
    order = np.lexsort((key, doc))
    doc, key, count = doc[order], key[order], count[order]
    twice = np.flatnonzero((doc[1:] == doc[:-1]) & (key[1:] == key[:-1]))
    shared = np.bincount(doc[twice], np.minimum(count[twice], count[twice + 1]), n)
    total = np.bincount(doc, count, n)
    return shared / np.maximum(1, total - shared)


def verify(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, weighted: bool = False) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts are similar; ``texts`` is (id, text)."""
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in row_blocks(batch.column(3), _BLOCK):
                part = batch.slice(lo, hi - lo)
                alike = pa.array(jaccard(part.column(2), part.column(3), weighted) >= threshold)
                yield part.select(["a", "b"]).filter(alike)

    return both.mapInArrow(lean(run), pairs.select("a", "b").schema)


class QueryIndex:
    """The shingles of a block of query texts, to count those that other texts share with them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, texts: pa.Array, weighted: bool):
        owner, key, count = shingles(texts)
        self.ids, self.labels, self.weighted = ids, labels, weighted
        count = count if weighted else np.ones(len(count), np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, first = np.unique(key[order], return_index=True)
        self.at = np.append(first, len(order))
        self.owner, self.count = owner[order], count[order]
        self.total = np.bincount(owner, count, len(ids))

    def links(self, ids: np.ndarray, labels: np.ndarray, column: pa.Array, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(query ids, ids): similar texts of another label, one for each query and label."""
        doc, key, count = shingles(column)
        n = len(self.ids)
        if not len(doc) or not len(self.keys):
            return self.ids[:0], ids[:0]
        count = count if self.weighted else np.ones(len(count), np.int64)
        total = np.bincount(doc, count, len(ids))
        slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[slot] == key
        doc, slot, count = doc[hit], slot[hit], count[hit]
        sizes = self.at[slot + 1] - self.at[slot]
        # Pieces of whole texts, of about _MATCHES matches.
        piece = np.cumsum(np.bincount(doc, sizes, len(ids))).astype(np.int64) // _MATCHES
        found = []
        for k in np.unique(piece):
            own = piece[doc] == k
            d, c, z = doc[own], count[own], sizes[own]
            back = np.repeat(np.arange(len(d)), z)
            at = self.at[slot[own]][back] + np.arange(len(back)) - np.repeat(np.cumsum(z) - z, z)
            other = labels[d[back]] != self.labels[self.owner[at]]
            back, at = back[other], at[other]
            pair, where = np.unique(d[back] * n + self.owner[at], return_inverse=True)
            shared = np.bincount(where, np.minimum(c[back], self.count[at]))
            i, q = pair // n, pair % n
            good = shared >= threshold * (total[i] + self.total[q] - shared)
            found.append(np.stack([q[good], i[good]]))
        q, i = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
        _, one = np.unique(np.stack([q, labels[i]]), axis=1, return_index=True)
        return self.ids[q[one]], ids[i[one]]


def search(mixed: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, weighted: bool = False, block: int = _QUERIES) -> DataFrame:
    """(a, b): for the members of each bucket outside its leading class, similar members of each other class.

    ``mixed`` is (bucket, id, label, head). A bucket is cut in blocks of queries and
    parts of members, of about ``block`` bytes; a task compares one block with one
    part through an index of shingles, so no bucket gathers anywhere and no row is
    made but for a link.
    """
    mixed = mixed.select("bucket", "id", "label", "head")
    sized = mixed.join(texts, "id").select("bucket", "id", "label", "head", "text")
    bytes_of = F.octet_length("text") + F.lit(64)
    query = F.col("label") != F.col("head")
    cuts = mixed.join(texts.select("id", bytes_of.alias("size")), "id").groupBy("bucket").agg(
        (F.floor(F.sum(F.when(query, F.col("size")).otherwise(0)) / block) + 1).alias("blocks"), (F.floor(F.sum("size") / block) + 1).alias("parts")
    )
    placed = sized.join(cuts, "bucket")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("id", "text"), F.col(n))
    asked = placed.where(query).select("bucket", deal("blocks").alias("block"), every("parts").alias("part"), "id", "label", "text").toDF("q_bucket", "q_block", "q_part", "q_id", "q_label", "q_text")
    held = placed.select("bucket", deal("parts").alias("part"), every("blocks").alias("block"), "id", "label", "text")
    kind = mixed.schema["id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        numbers = lambda t, c: t.column(c).to_numpy()
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            index = QueryIndex(numbers(left, "q_id"), numbers(left, "q_label"), left.column("q_text").combine_chunks(), weighted)
            a, b = index.links(numbers(right, "id"), numbers(right, "label"), right.column("text").combine_chunks(), threshold)
        return pa.table({"a": a, "b": b})

    sides = asked.groupBy("q_bucket", "q_block", "q_part"), held.select("bucket", "block", "part", "id", "label", "text").groupBy("bucket", "block", "part")
    return sides[0].cogroup(sides[1]).applyInArrow(run, f"a {kind}, b {kind}")


def components(edges: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(id, label): the smallest id that each end of ``edges`` (a, b) is connected with.

    ``before`` is a former result whose classes are joined further. In each
    round a node takes the smallest label around it and then its label's label;
    a chain so halves each round. Rounds are written tables; what reaches the
    driver is one number.
    """
    links = edges.select("a", "b")
    if before is not None:
        links = links.union(before.where("id <> label").select(F.col("label"), F.col("id")))
    links = materialize(links.union(links.select("b", "a")).where("a <> b").distinct())
    labels = materialize(links.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        around = links.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        nearer = labels.join(around, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        made = nearer.join(jump, "label").select("id", F.least("label", "next").alias("label"), "old")
        new, changed = materialize_counted(made, F.col("label") != F.col("old"))
        discard(labels)
        labels = new.select("id", "label")
        if not changed:
            discard(links)
            return labels


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("label", F.col("id"))
    return members.join(labels, "id", "left").select("bucket", "id", F.coalesce("label", "id").alias("label"))


def near_duplicate_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, weighted: bool = False) -> DataFrame:
    """(key, class_id): a row for each input row; the class is its smallest id."""
    sketches = materialize(sketch(docs, key, text, bands, rows, weighted))
    # One row for each different set: the first with its address, by a partial minimum of whole rows.
    single = sketches.where("address is not null").groupBy("address").agg(F.min("id").alias("id"), F.first("bands").alias("bands"))
    banded = single.where("id is not null").select("id", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last")
    members = materialize(banded.join(shared.select("bucket"), "bucket").select("bucket", "id").distinct())
    # An id may have several texts: each is compared, so that none's links are lost.
    whole = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text is not null")
    texts = materialize(whole.join(members.select("id").distinct(), "id").dropDuplicates(["id", "text"]))
    labels, tested = None, None
    for turn in range(3):
        apart = _labelled(members, labels)
        heads = apart.groupBy("bucket").agg(F.min("label").alias("head"), F.max("label").alias("tail"), F.count("*").alias("size")).where("head < tail")
        mixed, left = materialize_counted(apart.join(heads.select("bucket", "head", "size"), "bucket"))
        if not left:
            discard(mixed)
            break
        rest = mixed.where("label <> head")
        edges = None
        if turn == 0:
            pairs = rest.select(F.col("head").alias("a"), F.col("id").alias("b"))
        elif turn == 1:
            lead = rest.groupBy("bucket").agg(F.min("id").alias("a"))
            pairs = rest.join(lead, "bucket").where("id <> a").select("a", F.col("id").alias("b"))
        else:
            # Outside the leading class after two rounds: against all others of the bucket.
            near = rest.where(F.col("size") <= SMALL).select("bucket", F.col("id").alias("a"), F.col("label").alias("la"))
            other = mixed.where(F.col("size") <= SMALL).select("bucket", F.col("id").alias("b"), F.col("label").alias("lb"))
            pairs = near.join(other, "bucket").where("la <> lb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            edges = search(mixed.where(F.col("size") > SMALL).join(rest.select("bucket").distinct(), "bucket"), texts, threshold, weighted)
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs)
        verified = verify(pairs, texts, threshold, weighted)
        edges, many = materialize_counted((verified if edges is None else verified.union(edges)).distinct())
        if many:
            before, labels = labels, components(edges, labels)
            if before is not None:
                discard(before)
        discard(edges)
        discard(mixed)
        tested = pairs if tested is None else materialize(tested.union(pairs))
    discard(texts)
    classes = single.select("address", "id")
    if labels is not None:
        classes = classes.join(labels, "id", "left").select("address", F.coalesce("label", "id").alias("class"))
    found = lookup(sketches.select("id", "address"), "address", classes.toDF("address", "class"))
    return found.select(F.col("id").alias(key), F.coalesce("class", "id").alias("class_id"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Of each class the row with the smallest id, of equal rows one; different texts of that id all stay.

    Rows without an id stay.
    """
    classes = near_duplicate_classes(docs, key, text, **how)
    kept = classes.where(F.col(key) == F.col("class_id")).select(key).distinct()
    single = docs.join(kept, key, "left_semi").dropDuplicates([key, text])
    return single.unionByName(docs.where(F.col(key).isNull()))
