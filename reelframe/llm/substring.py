"""Substring dedup (operator 10): repeated passages found with prefix-partitioned suffix trees.

Every run of WINDOW words is a suffix of the corpus, cut at that depth. Suffixes are split by prefixes of varying
length into groups that fit in a task's memory; a group's subtree is built from the words themselves, and its inner
nodes at WINDOW words or deeper are the repeats. Windows that follow each other in a deep node join into maximal repeats.

To send each suffix on its own would carry every word WINDOW times. So a prefix is taken at the window's anchor: the
place, of all whose ANCHOR words lie within the window, where these hash lowest. Equal windows have equal anchors, and
neighbouring windows mostly share theirs, so a run of them travels as one segment of the text, some three words for
each window. A prefix that is frequent is passed over for another place in the window; where a window has none but
frequent ones, the prefix is as long as the window. The number of groups comes from the text's bytes.

A group sorts the places of its segments by their words, twice as many at each step, and drops at once what has no
equal; equal ranks at WINDOW words are a deep node. Words are compared as they are: no hash decides there. A group
folds as it reads: once it holds FOLD bytes, windows whose node has a smaller document are marked and let go.

Before anything travels, the windows of a slice (about SLICE bytes of texts) are compared with each other, by the 64-bit
hashes of all their words: two windows that differ in a word are taken for equal there only if these words' hashes
are equal by chance, among the words of one slice with odds of 1 in 10 ** 7 at most. So a passage costs its group one
segment for a slice, however many documents of the slice hold it.

Slices are a written table and marks are packed by slice and place, so rows grow with slices and groups, and neither
repeated nor missing doc_ids matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import documents, in_small_batches, stored
from reelframe.llm.wordhash import SPACES, Words, mix, slices, word_hashes

WINDOW = 13
#: Words of an anchor.
ANCHOR = 3
#: Stands for a null doc_id, which sorts after every other.
NO_ID = (1 << 63) - 1
#: Bytes of texts to a slice and to a group, and of segments that a group holds before it folds.
SLICE, GROUP, FOLD = 9 << 19, 6 << 20, 24 << 20
#: Bytes of slices in which anchors are counted. The counts only steer which group a window goes to.
SAMPLE = 1 << 30
#: A prefix is frequent if it is the anchor of more segments than this, or of more than this part of them all.
HOT, HOT_SHARE = 30_000, 1 / (1 << 20)
_U = np.uint64
_HIGH = _U(1 << 63)


def _packed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(b"".join(a.tobytes() for a in arrays))


def _open(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat((first - ends + size).astype(np.int32), size)


def _plain(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words, each followed by one space; and the number of words of each text."""
    inside = ~SPACES[data]
    start = inside.copy()
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    start[1:] &= ~inside[:-1] | edge[1:-1]
    word = np.cumsum(start)
    out = np.full(int(inside.sum()) + int(start.sum()), 0x20, np.uint8)
    at = np.flatnonzero(inside)
    out[np.arange(len(at)) + word[at] - 1] = data[at]
    return out, np.diff(np.r_[0, word][ends])


@dataclass
class Slice:
    """A slice's words: ids has a number to compare for each text; stop: where each word's space is."""

    data: np.ndarray
    ids: np.ndarray
    words: Words
    stop: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> Slice:
        stop = np.flatnonzero(data == 0x20)
        text = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(data)], np.int64)), pa.py_buffer(data)])
        found = next(word_hashes(text))[1].hash if len(data) else np.empty(0, np.uint64)
        first = np.r_[0, np.cumsum(counts)]
        return cls(data, ids, Words(found, np.repeat(np.arange(len(ids)), counts), first), stop)

    def anchors(self, at: np.ndarray, n: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the windows that begin at these words: the word their anchor begins at, and its hash with the highest
        bit set if it is frequent."""
        h = self.words.hash
        width = min(ANCHOR, n)
        value = h[: len(h) - width + 1].copy()
        for k in range(1, width):
            value = value * _U(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k]
        value = mix(value) >> _U(1)
        if len(hot):
            place = np.minimum(np.searchsorted(hot, value), len(hot) - 1)
            value |= np.where(hot[place] == value, _HIGH, _U(0))
        # Least of n - width + 1 neighbours, by doubling; of equal ones the first.
        best, span, places = np.arange(len(value)), 1, n - width + 1
        while span < places:
            by = min(span, places - span)
            a, b = best[: len(best) - by], best[by:]
            best, span = np.where(value[b] < value[a], b, a), span + by
        found = best[at]
        return found, value[found]


def _segments(at: np.ndarray, doc: np.ndarray, anchor: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Where a new segment begins among the windows: another anchor, a gap or another text; a frequent one is alone."""
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]) | hot[1:]
    return new


SLICED = "slice bigint, ids array<bigint>, words array<int>, n_bytes bigint, packed binary, anchors array<bigint>, counts array<bigint>"


def _sliced(batches: Iterator[pa.RecordBatch], n: int, every: int, least: int) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        ids = batch.column(0)
        for k, data, ends in slices(batch.column(1), SLICE):
            plain, counts = _plain(data, ends)
            anchors, many = np.empty(0, np.int64), np.empty(0, np.int64)
            if int(mix(np.array([number], np.uint64))[0]) % every == 0:
                some = Slice.of(plain, np.zeros(len(counts), np.int64), counts)
                at = some.words.windows(n)[1]
                if len(at):
                    anchor, value = some.anchors(at, n, np.empty(0, np.uint64))
                    values, many = np.unique(value[_segments(at, some.words.doc[at], anchor, np.zeros(len(at), bool))], return_counts=True)
                    anchors, many = values[many >= least].view(np.int64), many[many >= least]
            own = ids.slice(k, len(counts))
            columns = [pa.array([number], pa.int64()), pa.array([own.to_pylist()], pa.list_(pa.int64())), pa.array([counts.tolist()], pa.list_(pa.int32())), pa.array([len(plain)], pa.int64()), pa.array([_packed(plain)], pa.binary()), pa.array([anchors.tolist()], pa.list_(pa.int64())), pa.array([many.tolist()], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SLICED.split(", ")])
            number += 1


def _numbers(ids: pa.Scalar) -> np.ndarray:
    return np.array([NO_ID if x is None else x for x in ids.as_py()], np.int64)


LEAVES = "grp bigint, found boolean, slice bigint, n int, packed binary"


def _leaves(batches: Iterator[pa.RecordBatch], n: int, groups: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A slice's segments by group, and (found) what is known to repeat from the slice alone, dealt to any group."""
    for batch in batches:
        for k in range(batch.num_rows):
            number, ids, counts, packed = (batch.column(c)[k] for c in ("slice", "ids", "words", "packed"))
            data = np.frombuffer(_open(packed.as_py()), np.uint8)
            yield from _leaves_of(number.as_py(), Slice.of(data, _numbers(ids), np.array(counts.as_py(), np.int64)), n, groups, hot)


def _later_here(some: Slice, label: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Which windows also begin in a text of the slice with a smaller id."""
    order = np.argsort(label)
    new = np.r_[True, label[order][1:] != label[order][:-1]]
    size = np.diff(np.r_[np.flatnonzero(new), len(order)])
    more = np.repeat(size, size) > 1
    order, new = order[more], new[more]
    later = np.zeros(len(label), bool)
    if len(order):
        first = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        same = np.ones(len(order), bool)
        head = at[order[first]][of]
        for k in range(n):
            same &= some.words.hash[at[order] + k] == some.words.hash[head + k]
        ids = some.ids[some.words.doc[at[order]]]
        least = np.minimum.reduceat(np.where(same, ids, NO_ID), first)[of]
        later[order[same & (ids > least)]] = True
    return later


def _leaves_of(number: int, some: Slice, n: int, groups: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    label, at = some.words.windows(n)
    if not len(at):
        return
    later = _later_here(some, label, at, n)
    rows: list[list] = [[], [], [], [], []]

    def row(grp: int, found: bool, size: int, packed: bytes) -> None:
        for to, x in zip(rows, (grp, found, number, size, packed), strict=True):
            to.append(x)

    if later.any():
        row(number % groups, True, *_marks(at[later], n))
    label, at = label[~later], at[~later]
    if len(at):
        anchor, value = some.anchors(at, n, hot)
        alone = value >= _HIGH
        new = _segments(at, some.words.doc[at], anchor, alone)
        new[1:] |= alone[:-1]
        new = np.flatnonzero(new)
        key = np.where(alone, label, value)[new]
        grp = ((mix(key) >> _U(32)) * _U(groups) >> _U(32)).astype(np.int64)
        size = (np.diff(np.r_[new, len(at)]) + n - 1).astype(np.int32)
        order = np.argsort(grp, kind="stable")
        grp, first, size = grp[order], at[new][order].astype(np.int32), size[order]
        begin = np.r_[0, some.stop[:-1] + 1]
        low, high = begin[first], some.stop[first + size - 1] + 1
        text = some.data[_ranges(low, high - low)]
        ends = np.r_[0, np.cumsum(high - low)]
        ids = some.ids[some.words.doc[first]]
        cuts = np.flatnonzero(np.diff(grp, prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            row(int(grp[a]), False, int(b - a), _packed(ids[a:b], first[a:b], size[a:b], text[ends[a] : ends[b]]))
    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(rows, (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary()), strict=True)], [c.split()[0] for c in LEAVES.split(", ")])


def _marks(at: np.ndarray, n: int) -> tuple[int, bytes]:
    """Windows that begin at these words of a slice, as runs of covered words: how many, and (first, number) packed."""
    at = np.unique(at)
    new = np.flatnonzero(np.r_[True, at[1:] > at[:-1] + n])
    last = at[np.r_[new[1:] - 1, len(at) - 1]]
    first = at[new]
    return len(first), _packed(first.astype(np.int32), (last - first + n).astype(np.int32))


@dataclass
class Leaves:
    """Segments of a group: their slice, id, first word in the slice, number of words, and text."""

    slice: np.ndarray
    ids: np.ndarray
    first: np.ndarray
    size: np.ndarray
    text: np.ndarray

    @classmethod
    def opened(cls, number: int, n: int, packed: bytes) -> Leaves:
        raw = _open(packed)
        ids, first, size = np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.int32, n, 8 * n), np.frombuffer(raw, np.int32, n, 12 * n)
        return cls(np.full(n, number), ids, first, size, np.frombuffer(raw, np.uint8, -1, 16 * n))

    @classmethod
    def together(cls, some: list[Leaves]) -> Leaves:
        return cls(*(np.concatenate([getattr(x, c) for x in some]) for c in ("slice", "ids", "first", "size", "text")))

    def ranks(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, node) of the words at which a run of n words begins that begins elsewhere too; nodes are numbered in
        the order of their words."""
        stop = np.flatnonzero(self.text == 0x20) + 1
        offsets = np.r_[0, stop].astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(stop), [None, pa.py_buffer(offsets), pa.py_buffer(self.text)]).dictionary_encode()
        place = np.empty(len(coded.dictionary), np.int32)
        place[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(len(place), dtype=np.int32)
        rank = place[coded.indices.to_numpy()]
        left = np.repeat(np.cumsum(self.size, dtype=np.int32), self.size) - np.arange(len(rank), dtype=np.int32)
        at, depth = np.arange(len(rank), dtype=np.int32), 1
        del coded, stop, offsets
        while depth < n:
            # Runs of twice as many words are ranked by both halves, which overlap in the last step.
            by = min(depth, n - depth)
            depth += by
            at = at[left[at] >= depth]
            at = at[rank[at + by] >= 0]
            key = rank[at].astype(np.int64) * (int(rank.max(initial=0)) + 1) + rank[at + by]
            order = np.argsort(key)
            key = key[order]
            new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.empty(0, bool)
            del key
            size = np.diff(np.r_[np.flatnonzero(new), len(order)])
            twice = np.repeat(size > 1, size)
            number = (np.cumsum(new, dtype=np.int32) - 1)[twice]
            at = at[order[twice]]
            del order, new, twice
            rank = np.full(len(rank), -1, np.int32)
            rank[at] = number
            at = np.sort(at)
        return at, rank[at]

    def folded(self, n: int) -> tuple[list[tuple[int, int, bytes]], Leaves]:
        """(slice, number, packed marks) of windows whose node has a smaller document, and the segments that stay."""
        at, node = self.ranks(n)
        if not len(at):
            return [], self
        first = np.r_[0, np.cumsum(self.size)[:-1]]
        owner = np.repeat(np.arange(len(self.size)), self.size)[at]
        order = np.argsort(node, kind="stable")
        new = np.flatnonzero(np.r_[True, np.diff(node[order]) > 0])
        least = np.empty(len(at), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(self.ids[owner[order]], new), np.diff(np.r_[new, len(at)]))
        later = self.ids[owner] > least
        owner, at = owner[later], at[later]
        number, place = self.slice[owner], self.first[owner] + at - first[owner]
        order = np.argsort(number, kind="stable")
        number, place = number[order], place[order]
        cuts = np.flatnonzero(np.r_[True, np.diff(number) != 0, True]) if len(number) else np.zeros(1, np.int64)
        marks = [(int(number[a]), *_marks(place[a:b], n)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        # A segment all of whose windows are marked has nothing more to tell.
        stays = np.bincount(owner, minlength=len(self.size)) < self.size - n + 1
        bytes_ = np.diff(np.r_[0, np.flatnonzero(self.text == 0x20)[np.cumsum(self.size) - 1] + 1])
        text = self.text[np.repeat(stays, bytes_)]
        return marks, Leaves(self.slice[stays], self.ids[stays], self.first[stays], self.size[stays], text)


REPEATS = "slice bigint, n int, marks binary"


def _repeated(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["slice", "n", "marks"])


def _subtree(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The marks of a group's subtree, by slice."""
    held: list[Leaves] = []
    room = FOLD
    for batch in batches:
        found = []
        for k in range(batch.num_rows):
            done, number, size, packed = (batch.column(c)[k].as_py() for c in ("found", "slice", "n", "packed"))
            if done:
                found.append((number, size, packed))
                continue
            held.append(Leaves.opened(number, size, packed))
            if sum(len(x.text) for x in held) > room:
                marks, rest = Leaves.together(held).folded(n)
                held, room = [rest], max(FOLD, 2 * len(rest.text))
                found += marks
        yield _repeated(found)
    if held:
        yield _repeated(Leaves.together(held).folded(n)[0])


def sliced(docs: DataFrame, n: int = WINDOW) -> tuple[DataFrame, int, np.ndarray]:
    """The texts in slices, as a written table; the number of groups; and the hashes of frequent anchors, in order."""
    in_small_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    every = max(1, total // SAMPLE)
    # Segments are some six windows each, words some six bytes.
    bound = max(HOT, total / 36 * HOT_SHARE)
    table = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _sliced(it, n, every, max(1, int(bound * SLICE / max(total, SLICE) / 8))), SLICED), "slices")
    each = table.where("size(anchors) > 0").select(F.explode(F.arrays_zip("anchors", "counts")).alias("x"))
    # At most as many as the bound goes into all segments.
    hot = each.groupBy("x.anchors").agg((F.sum("x.counts") * every).alias("n")).where(F.col("n") > bound).select("anchors")
    return table, max(1, -(-total // GROUP)), np.array(sorted(r.anchors for r in hot.toLocalIterator()), np.int64).view(np.uint64)


def repeats(table: DataFrame, groups: int, hot: np.ndarray, n: int = WINDOW) -> DataFrame:
    """(slice, n, marks) of windows that also start in a document with a smaller doc_id."""
    leaves = table.select("slice", "ids", "words", "packed").mapInArrow(lambda it: _leaves(it, n, groups, hot), LEAVES)

    def subtree(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _subtree(rows, n)

    return leaves.groupBy("grp").applyInArrow(subtree, REPEATS)


KEPT = "doc_id bigint, n_words bigint, n_removed bigint, kept string, spans array<struct<first:int,end:int>>"


def _cut(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            ids, counts, packed, marks = (batch.column(c)[k].as_py() for c in ("ids", "words", "packed", "marks"))
            yield _cut_slice(ids, np.array(counts, np.int64), np.frombuffer(_open(packed), np.uint8), marks or [], digest)


def _cut_slice(ids: list, counts: np.ndarray, data: np.ndarray, marks: list[dict], digest: bool) -> pa.RecordBatch:
    first = np.r_[0, np.cumsum(counts)]
    cover = np.zeros(first[-1] + 1, np.int64)
    for m in marks:
        at, size = np.frombuffer(_open(m["marks"]), np.int32).reshape(2, m["n"])
        np.add.at(cover, at, 1)
        np.add.at(cover, at + size, -1)
    gone = np.cumsum(cover)[:-1] > 0
    removed = np.add.reduceat(np.r_[gone, False], first[:-1]) * (counts > 0) if len(counts) else counts
    stop = np.flatnonzero(data == 0x20) + 1
    length = np.diff(np.r_[0, stop])
    rest = data[np.repeat(~gone, length)].tobytes()
    ends = np.r_[0, np.cumsum(length * ~gone)][first]
    texts = [rest[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    kept = [hashlib.sha256(t).hexdigest() for t in texts] if digest else [t.decode() for t in texts]
    # Maximal repeats: runs of covered words within a text, counted from its first word.
    owner = np.repeat(np.arange(len(counts)), counts)
    edge = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.empty(0, bool)
    begin = np.flatnonzero(gone & (edge | ~np.r_[False, gone[:-1]])) if len(gone) else np.empty(0, np.int64)
    end = np.flatnonzero(gone & (np.r_[edge[1:], True] | ~np.r_[gone[1:], False])) if len(gone) else np.empty(0, np.int64)
    of = owner[begin]
    spans = pa.StructArray.from_arrays([pa.array((begin - first[of]).astype(np.int32)), pa.array((end + 1 - first[of]).astype(np.int32))], ["first", "end"])
    listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(counts) + 1)).astype(np.int32)), spans)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), listed], ["doc_id", "n_words", "n_removed", "kept", "spans"])


def remove_repeats(docs: DataFrame, n: int = WINDOW, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, the kept words (or their SHA-256) and the removed spans of words of every row.

    A null or empty text has no words. A null doc_id counts as larger than any other. Rows of one doc_id, and rows
    without one, don't take words from each other. Columns beside doc_id and text are ignored; an empty table stays so.
    """
    table, groups, hot = sliced(docs, n)
    found = repeats(table, groups, hot, n).groupBy("slice").agg(F.collect_list(F.struct("n", "marks")).alias("marks"))
    joined = table.select("slice", "ids", "words", "packed").join(found, "slice", "left")
    return joined.select("ids", "words", "packed", "marks").mapInArrow(lambda it: _cut(it, digest), KEPT)


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    return remove_repeats(documents(spark, sf_dir), digest=True).drop("spans").withColumnRenamed("kept", "kept_sha256")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM p),
m AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS k FROM g JOIN m USING (g) WHERE doc_id > least),
r AS (SELECT doc_id, list(k) AS ks, count(*) AS n FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d SEMI JOIN r USING (doc_id)),
s AS (SELECT k.doc_id, string_agg(w[i], ' ' ORDER BY i) AS kept FROM k ANTI JOIN c ON k.doc_id = c.doc_id AND k.i = c.k GROUP BY k.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN r.n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(s.kept, '') END) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id)
"""
