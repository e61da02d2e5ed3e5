"""Periodic run detection (operator 11): every maximal repetition of words in a text, by the runs theorem.

Each run holds a root that is the longest Lyndon word at its start under the order of words or under the reverse one.
Both follow from one inverse suffix array: a longest Lyndon word ends at the next smaller value, or under the reverse
order at the next greater one. A root is then extended to both sides by the longest common prefixes of two suffixes
and of two reversed prefixes: minima over ranges of the LCP arrays, from sparse tables.

A run of at least 2 * LEAST words holds LEAST words in a row that stand twice in its text, so texts without such
a repetition are answered at once; the others of a batch go through the arrays together, PACK words at a time, each
closed by a word of its own. A text is worked on as a whole, however long it is; the arrays take some 600 bytes a word of a
pack, or of a longer repetitive text on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import documents, in_small_batches, let, words

#: A run has 2 * LEAST words at least.
LEAST = 6
#: Words of repetitive texts that go through the arrays together, and the bits of a key that tell a batch's texts apart.
PACK, TEXT_BITS = 1 << 17, 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
MADE = "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


class Suffixes:
    """Ranks of all suffixes of a sequence, and the longest common prefix of any two.

    Parts of the sequence are closed by words found nowhere else, so no common prefix goes past a part; limit is
    the length of the longest part.
    """

    def __init__(self, values: np.ndarray, limit: int):
        order = np.argsort(values, kind="stable")
        self.rank = np.empty(len(values), np.int64)
        self.rank[order] = _starts(values[order])
        levels, k = [self.rank.astype(np.int32)], 1
        tied = _tied(order, self.rank[order])
        while len(tied):
            # Equal so far, so neither has reached its part's end.
            key = self.rank[tied] * len(values) + self.rank[tied + k]
            by = np.argsort(key, kind="stable")
            tied, key = tied[by], key[by]
            old = self.rank[tied]
            self.rank[tied] = old + _starts(key) - _starts(old)
            levels.append(self.rank.astype(np.int32))
            tied, k = _tied(tied, self.rank[tied]), k * 2
        self.sorted = np.argsort(self.rank)
        a, b = self.sorted[:-1].copy(), self.sorted[1:].copy()
        common = np.zeros(len(values), np.int64)
        for level in reversed(range(len(levels) - 1)):
            same = levels[level][a] == levels[level][b]
            step = same * (1 << level)
            common[1:] += step
            a, b = a + step, b + step
        self.least = minima(common, limit)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of suffixes i and j, pairwise different ones."""
        low, high = np.minimum(self.rank[i], self.rank[j]) + 1, np.maximum(self.rank[i], self.rank[j]) + 1
        level = np.frexp(high - low)[1] - 1
        return np.minimum(self.least[level, low], self.least[level, high - (1 << level)])


def _starts(keys: np.ndarray) -> np.ndarray:
    """For each place in sorted keys the first place with an equal key."""
    return np.maximum.accumulate(np.where(np.r_[True, keys[1:] != keys[:-1]], np.arange(len(keys)), 0))


def _tied(places: np.ndarray, rank: np.ndarray) -> np.ndarray:
    same = rank[1:] == rank[:-1]
    return places[np.r_[False, same] | np.r_[same, False]]


def minima(values: np.ndarray, limit: int) -> np.ndarray:
    """The sparse table of minima over 1, 2, 4, .. values from each place on, up to limit values."""
    table = [values.astype(np.int32)]
    for level in range(max(limit, 1).bit_length() - 1):
        half, last = 1 << level, table[-1]
        table.append(np.r_[np.minimum(last[:-half], last[half:]), last[-half:]])
    return np.stack(table)


def next_smaller(values: np.ndarray, limit: int) -> np.ndarray:
    """For each place the first one after it with a smaller value; the values' closing words stop the search, at most
    limit places on."""
    table, n = minima(values, limit), len(values)
    at = np.arange(n) + 1
    for level in reversed(range(len(table))):
        inside = np.minimum(at, n - 1)
        at = at + ((at + (1 << level) <= n) & (table[level, inside] > values)) * (1 << level)
    return at


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text, as numbers of words, its runs as rows (start, length, period) by start, then period."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + 1) - 1
    firsts, limit = ends - sizes, int(sizes.max()) + 1
    of = np.repeat(np.arange(len(texts)), sizes + 1)
    values = np.concatenate([np.r_[t.astype(np.int64) + 1, 0] for t in texts])
    values += of * (int(values.max()) + 1)
    forth = Suffixes(values, limit)
    back = Suffixes(np.r_[values[::-1], -1], limit)
    closing = np.zeros(len(values), bool)
    closing[ends] = True
    # The closing word is smaller than all of its text in either search.
    up = next_smaller(forth.rank, limit)
    down = next_smaller(np.where(closing, -1 - len(values), -forth.rank), limit)
    i = np.tile(np.flatnonzero(~closing), 2)
    p = np.r_[up[~closing], down[~closing]] - i
    inside = i + p < ends[of[i]]
    i, p = i[inside], p[inside]
    right = forth.common(i, i + p)
    left, more = np.zeros_like(i), i > firsts[of[i]]
    left[more] = back.common(len(values) - i[more], len(values) - i[more] - p[more])
    start, length = i - left, left + p + right
    is_run = length >= np.maximum(2 * LEAST, 2 * p)
    start, length, p = start[is_run], length[is_run], p[is_run]
    found = np.unique(np.stack([start, p, length], 1), axis=0)[:, [0, 2, 1]] if len(p) else np.empty((0, 3), np.int64)
    cut = np.searchsorted(found[:, 0], np.r_[firsts, len(values)])
    return [found[a:b] - [first, 0, 0] for a, b, first in zip(cut[:-1], cut[1:], firsts, strict=True)]


def repetitive(texts: list[list[bytes]]) -> np.ndarray:
    """The numbers of the texts, at most 2^TEXT_BITS of them, in which LEAST words in a row stand twice (by hash: rarely one more, never one less)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    n = int(sizes.sum())
    if n < LEAST:
        return np.empty(0, np.int64)
    word = np.fromiter(map(hash, chain.from_iterable(texts)), np.int64, n).view(np.uint64)
    gram = np.zeros(n - LEAST + 1, np.uint64)
    for k in range(LEAST):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + word[k : n - LEAST + 1 + k]
    gram ^= gram >> np.uint64(29)
    of = np.repeat(np.arange(len(texts)), sizes)
    whole = of[: n - LEAST + 1] == of[LEAST - 1 :]
    keys = np.sort((of[: n - LEAST + 1][whole].astype(np.uint64) << np.uint64(64 - TEXT_BITS)) | (gram[whole] >> np.uint64(TEXT_BITS)))
    return np.unique(keys[1:][keys[1:] == keys[:-1]] >> np.uint64(64 - TEXT_BITS)).astype(np.int64)


def found_in(texts: list[list[bytes]]) -> dict[int, np.ndarray]:
    """The runs of each text that has some, by the text's number."""
    out: dict[int, np.ndarray] = {}
    pack: list[int] = []
    asked = repetitive(texts).tolist()
    for at, k in enumerate(asked):
        pack.append(k)
        if at + 1 < len(asked) and sum(len(texts[x]) for x in pack) + len(texts[asked[at + 1]]) <= PACK:
            continue
        known: dict[bytes, int] = {}
        numbers = [np.fromiter((known.setdefault(w, len(known)) for w in texts[x]), np.int64, len(texts[x])) for x in pack]
        out |= {x: r for x, r in zip(pack, runs_of(numbers), strict=True) if len(r)}
        pack = []
    return out


def _collapsed(some: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run has past its first period."""
    change = np.zeros(len(some) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [some[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def _made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # Bytes are split at just the white space of this subpackage.
        texts = [(x or b"").split() for x in pc.cast(batch.column("text"), pa.binary()).to_pylist()]
        found = found_in(texts)
        runs = pa.array([[dict(zip(RUN.names, r, strict=True)) for r in found[k].tolist()] if k in found else [] for k in range(len(texts))], pa.list_(RUN))
        kept = pa.array([b" ".join(_collapsed(t, found[k]) if k in found else t) for k, t in enumerate(texts)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), runs, pc.cast(kept, pa.string())], ["doc_id", "runs", "collapsed"])


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period) and collapsed of rows (doc_id, text): the words,
    joined by one space, that no run has past its first period. Other columns are not looked at.

    Words are maximal runs of anything but space, tab, line feed, vertical tab, form feed and carriage return. A run has at
    least 12 words and two periods, its period is the smallest, and no neighbouring word goes on with it. A null text,
    and one without words, has no runs and an empty collapsed text. Equal rows have a row each; a text of one word
    said over and over is one run.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_made, MADE)


def repeating(docs: DataFrame) -> DataFrame:
    """doc_id and words of documents, those of every tenth (by the CRC-32 of the id as text) repeated from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def made(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = lambda x: F.transform(F.sequence(F.lit(0), F.size(w) - x["a"] - 1), lambda j: F.element_at(w, x["a"] + j % x["p"] + 1))
        return F.when(n > 0, let(F.struct(a.alias("a"), p.alias("p")), lambda x: F.array_join(F.concat(F.slice(w, F.lit(1), x["a"]), tail(x)), " "))).otherwise("")

    return docs.select("doc_id", F.when(h % 10 == 0, let(words(F.col("text")), made)).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256 and collapsed_sha256 of every document.

    A null text has no words and no runs, as has an empty one. The words of a document without doc_id stay as they are.
    Equal rows each have their row; an empty table stays empty.
    """
    in_small_batches(spark)
    made = runs(repeating(documents(spark, sf_dir)))
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    best = made.withColumn("best", F.when(F.size("runs") > 0, longest))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    length = -F.col("best.less")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.floor(length * 1000 / F.col("best.period")).alias("exponent_milli"),
        digest(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")).alias("runs_sha256"),
        digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
