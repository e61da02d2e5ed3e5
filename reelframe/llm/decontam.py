"""Benchmark decontamination (operator 9): BM25 over an inverted index of test items, with block-max WAND.

The index holds the test items: for each term its items with their BM25 weight, divided by the weight an item
gives its own text. A score is then the weighted share of an item's terms that a training passage has, and one
threshold serves every item. Every passage of every document is a query: windows of as many words as twice the
longest item of a length class (up to 32, 64, 128 ... words), each half overlapping the next, so an item of the class lies whole
in some passage.

WAND's rule: terms in order of frequency, an item can't reach the threshold by those before the pivot, the first at
which their weights together could, so a passage is looked at only if it has a term from the pivot on. Here each item has its own pivot,
at FREQUENT of the threshold. Lists hold for a term only the blocks of items in which it stands from the pivot on, with
its largest weight there. A passage sums these block maxima; a block whose sum, with the most that terms before the
pivots can add, stays below the threshold is skipped whole, and no item of it is scored. The sums are kept only for
blocks that a passage's lists name, for many passages at once. The items of the blocks that remain are scored, and
what scores high enough is verified: the item's five-word shingles in the passage, for the question (all but the last
sentence) and the answer (the last sentence) apart.

Words here are runs of letters and digits without regard to ASCII case. An index holds at most MAX_ITEMS items and
MAX_BYTES of their text; with more, the documents meet one index after the other and are written in between. Weights
go by the statistics of all items in either case.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import documents, dropped, in_small_batches, stored
from reelframe.llm.wordhash import Words, hash_text, word_hashes

K1, B = 1.2, 0.75
#: Weighted share of an item's terms that a passage must have to be looked at more closely.
LEAST_SCORE = 0.6
#: Shares of shingles: of question and answer, each; or of the whole item.
LEAST_PART, LEAST_WHOLE = 0.5, 0.8
SHINGLE = 5
#: Most items of an index, and bytes of their texts; items of a block; words of the shortest length class.
MAX_ITEMS, MAX_BYTES, BLOCK, SHORT = 20_000, 16 << 20, 8, 32
#: Part of the threshold that an item's terms before its pivot may reach.
FREQUENT = 0.6


def _shingles(values: np.ndarray) -> np.ndarray:
    n = min(SHINGLE, len(values))
    return Words(values, np.zeros(len(values), np.int64), np.array([0, len(values)])).windows(n)[0] if n else np.empty(0, np.uint64)


@dataclass
class Item:
    item_id: int
    terms: np.ndarray
    weights: np.ndarray
    whole: np.ndarray
    question: np.ndarray
    answer: np.ndarray
    lengths: tuple[int, int, int]

    def held_by(self, grams: dict[int, np.ndarray]) -> bool:
        """Whether a passage with these windows (by their number of words) holds the item: question and answer each
        in good part, or nearly the whole; only the latter counts for an item without an answer."""
        share = [float(np.isin(x, grams[min(SHINGLE, n)]).mean()) if n else 0.0 for x, n in zip((self.whole, self.question, self.answer), self.lengths, strict=True)]
        return share[0] >= LEAST_WHOLE or min(share[1:]) >= LEAST_PART


class Lists:
    """Postings of the items of one length class: for each term the blocks where it stands from a pivot on."""

    def __init__(self, half: int, items: list[Item], frequency: np.ndarray, least: float):
        # Items that share rare terms come next to each other, so that block maxima are tight.
        self.half, self.items = half, sorted(items, key=lambda x: (x.terms[np.argmin(frequency[x.terms])], x.item_id))
        self.blocks = -(-len(items) // BLOCK)
        #: What terms before the pivot can add, for any item of a block.
        self.rest = np.zeros(self.blocks)
        lists: list[dict[int, float]] = [{} for _ in frequency]
        for k, item in enumerate(self.items):
            order = np.argsort(-frequency[item.terms], kind="stable")
            terms, weights = item.terms[order], item.weights[order]
            pivot = int(np.searchsorted(np.cumsum(weights), FREQUENT * least, "right"))
            b = k // BLOCK
            self.rest[b] = max(self.rest[b], weights[:pivot].sum())
            for t, w in zip(terms[pivot:].tolist(), weights[pivot:].tolist(), strict=True):
                lists[t][b] = max(lists[t].get(b, 0.0), w)
        self.starts = np.r_[0, np.cumsum([len(x) for x in lists])]
        self.block = np.array([b for x in lists for b in x], np.int64)
        self.bound = np.array([w for x in lists for w in x.values()], np.float64)

    def candidates(self, words: Words, hit: np.ndarray, term: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, block) pairs that can reach the threshold; and the first half passage of each document. A
        passage goes by its first half; a last half is a passage of its own only if it is the first, too."""
        halves = np.maximum(1, -(-np.diff(words.first) // self.half))
        first_half = np.r_[0, np.cumsum(halves)]
        open_ = np.diff(self.starts)[term] > 0
        hit, term = hit[open_], term[open_]
        half_of = first_half[words.doc[hit]] + (hit - words.first[words.doc[hit]]) // self.half
        # A term counts once in a half passage.
        key = np.unique(half_of * (len(self.starts) - 1) + term)
        half_of, term = np.divmod(key, len(self.starts) - 1)
        many = np.diff(self.starts)[term]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.starts[term], many)
        key, number = np.unique(np.repeat(half_of, many) * self.blocks + self.block[at], return_inverse=True)
        total = np.bincount(number, self.bound[at], len(key))
        if not len(key):
            return key, key, first_half
        last = np.zeros(first_half[-1], bool)
        last[first_half[1:] - 1] = True
        only = np.zeros(first_half[-1], bool)
        only[first_half[:-1][halves == 1]] = True
        half = key // self.blocks
        inner = np.r_[True, last][half]  # the first half passage of its document
        passage = np.unique(np.r_[key[~last[half] | only[half]], key[~inner] - self.blocks])

        def sums(key_: np.ndarray) -> np.ndarray:
            place = np.minimum(np.searchsorted(key, key_), len(key) - 1)
            return np.where(key[place] == key_, total[place], 0.0)

        bound = sums(passage) + np.where(last[passage // self.blocks], 0.0, sums(passage + self.blocks))
        half, block = np.divmod(passage, self.blocks)
        ok = bound + self.rest[block] >= least - 1e-9
        return half[ok], block[ok], first_half


@dataclass
class Statistics:
    """Of items with words: their number, their mean number of words, and how many have each of some terms, in order."""

    items: int
    mean: float
    terms: np.ndarray
    frequency: np.ndarray

    @classmethod
    def of(cls, wholes: list[np.ndarray]) -> Statistics:
        terms, frequency = np.unique(np.concatenate([np.unique(w) for w in wholes]) if wholes else np.empty(0, np.uint64), return_counts=True)
        return cls(len(wholes), float(np.mean([len(w) for w in wholes])) if wholes else 1.0, terms, frequency.astype(np.float64))


def _terms(column: pa.Array) -> pa.Array:
    """The number of words, and the terms, of each text."""
    out = []
    for _, words in word_hashes(column, loose=True):
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            out.append({"n": b - a, "terms": np.unique(words.hash[a:b]).view(np.int64).tolist()})
    return pa.array(out, pa.struct([("n", pa.int64()), ("terms", pa.list_(pa.int64()))]))


class Index:
    """Lists of test items by length class."""

    def __init__(self, items: list[tuple[int, str]], least: float = LEAST_SCORE, known: Statistics | None = None):
        """known: statistics of all items, where these are only some of them."""
        parts = []
        for item_id, text in items:
            text = text or ""
            cut = [m.end() for m in re.finditer(r"[.!?][\s\"')]*(?=\S)", text)]
            question, answer = (hash_text(t, True) for t in ((text[: cut[-1]], text[cut[-1] :]) if cut else (text, "")))
            if len(question) + len(answer):
                parts.append((item_id, np.concatenate([question, answer]), question, answer))
        self.least = least
        self.vocabulary = np.unique(np.concatenate([p[1] for p in parts])) if parts else np.empty(0, np.uint64)
        known = known or Statistics.of([p[1] for p in parts])
        frequency = known.frequency[np.searchsorted(known.terms, self.vocabulary)]
        idf = np.log1p((known.items - frequency + 0.5) / (frequency + 0.5))
        by_length: dict[int, list[Item]] = {}
        for item_id, whole, question, answer in parts:
            terms, tf = np.unique(np.searchsorted(self.vocabulary, whole), return_counts=True)
            weights = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(whole) / known.mean))
            half = max(SHORT, 1 << (len(whole) - 1).bit_length())
            by_length.setdefault(half, []).append(Item(item_id, terms, weights / weights.sum(), *map(_shingles, (whole, question, answer)), (len(whole), len(question), len(answer))))
        self.classes = [Lists(half, some, frequency, least) for half, some in sorted(by_length.items())]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def found(self, words: Words) -> list[tuple[int, int, float]]:
        """(document, item_id, score) of what some passage of a document holds, after verification."""
        if not self.classes or not len(words.hash):
            return []
        hit = np.flatnonzero(self.maybe[(words.hash >> np.uint64(48)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.vocabulary, words.hash[hit]), len(self.vocabulary) - 1)
        same = self.vocabulary[term] == words.hash[hit]
        hit, term = hit[same], term[same]
        out: dict[tuple[int, int], float] = {}
        for lists in self.classes:
            passages, blocks, first_half = lists.candidates(words, hit, term, self.least)
            last, terms, grams = -1, np.empty(0, np.int64), {}
            for p, b in zip(passages.tolist(), blocks.tolist(), strict=True):
                d = int(np.searchsorted(first_half, p, "right")) - 1
                lo = int(words.first[d]) + (p - int(first_half[d])) * lists.half
                hi = min(lo + 2 * lists.half, int(words.first[d + 1]))
                if p != last:
                    a, z = np.searchsorted(hit, (lo, hi))
                    last, terms, grams = p, np.unique(term[a:z]), {}
                for item in lists.items[b * BLOCK : (b + 1) * BLOCK]:
                    score = float(item.weights[np.isin(item.terms, terms, assume_unique=True)].sum())
                    if score < self.least - 1e-9 or score <= out.get((d, item.item_id), -1.0):
                        continue
                    grams = grams or {n: np.unique(Words(words.hash[lo:hi], words.doc[lo:hi], words.first).windows(n)[0]) for n in range(1, SHINGLE + 1)}
                    if item.held_by(grams):
                        out[d, item.item_id] = score
        return [(d, item_id, score) for (d, item_id), score in out.items()]


LEAKS = "items array<bigint>, score double"


def leaks(index: Broadcast):
    """A function of a text column: the items found in it, in order, and the best score (0 where none is)."""

    def of(column: pa.Array) -> pa.Array:
        got: list[dict[int, float]] = [{} for _ in range(len(column))]
        for k, words in word_hashes(column, loose=True):
            for d, item_id, score in index.value.found(words):
                got[k + d][item_id] = score
        return pa.array([{"items": sorted(x), "score": max(x.values(), default=0.0)} for x in got], pa.struct([("items", pa.list_(pa.int64())), ("score", pa.float64())]))

    return F.arrow_udf(of, LEAKS)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, name: str = "leaks") -> DataFrame:
    """The documents with a column name (one that is there already is replaced): struct of items (ids found, in
    order) and score.

    Every row stays, with all its other columns. A null or empty text, or an empty benchmark, has no items; items
    without words (null, empty, blank) are never found; rows of one item_id count as parts of one item. A passage that
    holds several items lists them all.
    """
    spark = docs.sparkSession
    in_small_batches(spark)
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long"), "text")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    passes = max(1, -(-n // MAX_ITEMS), -(-size // MAX_BYTES))
    written = known = None
    if passes > 1:
        termed = items.select("*", F.arrow_udf(_terms, "n bigint, terms array<bigint>")("text").alias("t")).where("t.n > 0")
        filled, mean = termed.agg(F.count("*"), F.avg("t.n")).first()
        counts = stored(termed.select(F.explode("t.terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")), "terms")
    for k in range(passes):
        part = items
        if passes > 1:
            here = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k
            part, own = items.where(here), termed.where(here).select(F.explode("t.terms").alias("term")).distinct()
            got = sorted((r.term % (1 << 64), r.n) for r in counts.join(own, "term").toLocalIterator())
            known = Statistics(filled, float(mean or 1.0), np.array([t for t, _ in got], np.uint64), np.array([n for _, n in got], np.float64))
        index = spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in part.toLocalIterator()], least, known))
        of = leaks(index)("text")
        if k:
            docs = docs.withColumn("__of", of)
            of = F.struct(F.array_sort(F.array_union(F.col(f"{name}.items"), F.col("__of.items"))).alias("items"), F.greatest(F.col(f"{name}.score"), F.col("__of.score")).alias("score"))
        docs = docs.withColumn(name, of).drop("__of")
        if k + 1 < passes:
            before, written = written, stored(docs, "leaks")
            index.destroy()
            docs = written
            if before is not None:
                dropped(before)
    if passes > 1:
        dropped(counts)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, the benchmark items found, their number and the best score of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n = F.size("leaks.items")
    return found.select("doc_id", (n > 0).alias("contaminated"), n.cast("long").alias("n_items"), F.col("leaks.items").alias("items"), F.col("leaks.score").alias("score"))
