"""Token counts (operator 8): how many pieces a unigram tokenizer would cut a text into.

A text is cut before each space (a space becomes the mark of a piece's start, one is put in front), and each part
is counted by itself. An Aho-Corasick automaton over the vocabulary gives all pieces that end at a place, longest
first; dynamic programming carries the best score up to the place and the number of pieces it took. A better score
must be strictly better, so of equal ones the piece that starts first stays: the tokenizer's own rule. A character
that no piece covers costs the least score less 10 and counts one token for each of its UTF-8 bytes.

Only counts are kept, no paths. Parts repeat a lot, so each task counts a batch's distinct parts once, many side
by side, and a Python worker keeps the counts of sections for its next batches.

The vocabulary is a SentencePiece model file, whose path is a parameter; its pieces with their scores are sent to
the tasks (a vocabulary's size doesn't grow with the data).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import documents, in_small_batches
from reelframe.llm.wordhash import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Parts of up to SHORT characters are counted side by side, TOGETHER at a time.
SHORT, TOGETHER = 64, 20_000
#: Sections whose counts a Python worker keeps for its next tasks, and bytes of texts that it counts at a time.
CACHE = 300_000
BATCH = 2 << 20


def vocabulary(path: str = MODEL) -> list[tuple[str, float]]:
    """(piece, score) of the model, in order of id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        kept = [(piece, score) for piece, score in pieces if piece]
        for k, (piece, _) in enumerate(kept):
            self.automaton.add_word(piece, k)
        self.automaton.make_automaton()
        self.known: dict[str, int] = {}
        self.length = np.array([len(piece) for piece, _ in kept], np.int64)
        self.score = np.array([score for _, score in kept], np.float64)
        self.unknown = float(self.score.min(initial=0.0)) - UNKNOWN_PENALTY
        used = sorted(set().union(*(piece for piece, _ in kept)))
        free = (chr(c) for c in range(0xE000, 0xF900) if chr(c) not in used)
        self.gap, self.other = next(free), next(free)
        # Pairs of neighbours that some piece has; characters by number, 0 for those in no piece.
        self.number = np.zeros(0x110000, np.int64)
        self.number[[ord(c) for c in used]] = np.arange(1, len(used) + 1)
        pairs = {(ord(a), ord(b)) for piece, _ in kept for a, b in pairwise(piece)}
        a, b = np.array(sorted(pairs), np.int64).reshape(-1, 2).T
        self.pairs = np.unique(self.number[a] << 21 | self.number[b])

    def matches(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(last place, number of the piece) of all pieces in a text, by place and then longest first."""
        found = list(self.automaton.iter(text)) if len(self.score) else []
        flat = np.fromiter(chain.from_iterable(found), np.int64, 2 * len(found))
        return flat[::2], flat[1::2]

    def count(self, parts: list[str]) -> np.ndarray:
        """Tokens of each part; the parts go through the automaton as one text, with gaps that no piece spans."""
        text = self.gap.join([*parts, ""])
        sizes = np.array([len(x) for x in parts], np.int64)
        first = np.r_[0, np.cumsum(sizes + 1)[:-1]]
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n_bytes = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        last, piece = self.matches(text)
        part = np.searchsorted(first, last, "right") - 1
        end = last - first[part] + 1
        new = np.r_[True, last[1:] != last[:-1]] if len(last) else np.empty(0, bool)
        at = np.arange(len(last))
        rank = at - np.maximum.accumulate(np.where(new, at, 0))
        most = int(rank.max(initial=0)) + 1
        step = end * most + rank
        order = np.argsort(step, kind="stable")
        part, piece = part[order], piece[order]
        cuts = np.searchsorted(step[order], np.arange((int(sizes.max(initial=0)) + 1) * most + 1))
        width = int(sizes.max(initial=0)) + 1
        best, many = np.zeros((width, len(parts))), np.zeros((width, len(parts)), np.int64)
        for e in range(1, width):
            top, took, single = np.full(len(parts), -np.inf), np.zeros(len(parts), np.int64), np.zeros(len(parts), bool)
            for r in range(most):
                a, z = cuts[e * most + r], cuts[e * most + r + 1]
                if a == z:
                    break
                w, p = part[a:z], piece[a:z]
                size = self.length[p]
                score = best[e - size, w] + self.score[p]
                better = score > top[w]
                top[w[better]] = score[better]
                took[w[better]] = many[e - size[better], w[better]] + 1
                single[w[size == 1]] = True
            alone = np.flatnonzero(~single & (sizes >= e))
            score = best[e - 1, alone] + self.unknown
            alone, score = (x[score > top[alone]] for x in (alone, score))
            top[alone] = score
            took[alone] = many[e - 1, alone] + n_bytes[first[alone] + e - 1]
            best[e], many[e] = top, took
        return many[sizes, np.arange(len(parts))]

    def long(self, part: str) -> int:
        """Tokens of one long part: the same rules, place by place."""
        n, unknown, length, score_of = len(part), self.unknown, self.length, self.score
        best, many = [0.0] * (n + 1), [0] * (n + 1)
        last, piece = self.matches(part)
        cuts = np.searchsorted(last, np.arange(n + 1)).tolist()
        sizes, scores = length[piece].tolist(), score_of[piece].tolist()
        for e in range(1, n + 1):
            top, took, single = -np.inf, 0, False
            for k in range(cuts[e - 1], cuts[e]):
                size = sizes[k]
                score = best[e - size] + scores[k]
                single = single or size == 1
                if score > top:
                    top, took = score, many[e - size] + 1
            if not single and best[e - 1] + unknown > top:
                top, took = best[e - 1] + unknown, many[e - 1] + len(part[e - 1].encode("utf-8", "surrogatepass"))
            best[e], many[e] = top, took
        return many[n]

    def counts(self, parts: list[str]) -> np.ndarray:
        """Tokens of each part: it is cut where no piece spans, and each distinct section is counted once."""
        if not parts:
            return np.empty(0, np.int64)
        text = self.gap.join([*parts, ""])
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(x) + 1 for x in parts])
        number = self.number[code]
        pair = number[:-1] << 21 | number[1:]
        place = np.minimum(np.searchsorted(self.pairs, pair), max(0, len(self.pairs) - 1))
        cut = self.pairs[place] != pair if len(self.pairs) else np.ones(len(pair), bool)
        cut[ends - 2] = False
        cut[ends[:-1] - 1] = False
        cut = np.flatnonzero(cut) + 1
        # Sections of a part: its gaps between characters, and one more.
        many = np.diff(np.searchsorted(cut, np.r_[0, ends])) + 1
        sections = np.insert(code, cut, ord(self.gap)).tobytes().decode("utf-32-le", "surrogatepass")[:-1].split(self.gap)
        new = list({x for x in sections if x not in self.known})
        if len(self.known) + len(new) > CACHE:
            self.known, new = {}, list(set(sections))
        self.known.update(zip(new, self.distinct(new).tolist(), strict=True))
        each = np.fromiter(map(self.known.__getitem__, sections), np.int64, len(sections))
        return np.add.reduceat(each, np.r_[0, np.cumsum(many)[:-1]])

    def distinct(self, parts: list[str]) -> np.ndarray:
        out = np.empty(len(parts), np.int64)
        sizes = np.array([len(x) for x in parts], np.int64)
        short = np.flatnonzero(sizes <= SHORT)
        short = short[np.argsort(sizes[short], kind="stable")]
        for k in range(0, len(short), TOGETHER):
            some = short[k : k + TOGETHER]
            out[some] = self.count([parts[i] for i in some.tolist()])
        for i in np.flatnonzero(sizes > SHORT).tolist():
            out[i] = self.long(parts[i])
        return out


def _counted(column: pa.Array, counter: Counter) -> pa.Array:
    # A gap in a text counts as any other character that no piece has.
    text = pc.replace_substring(pc.fill_null(column, ""), counter.gap, counter.other)
    # Each part starts with its mark; a literal mark in the text starts one too.
    marked = pc.binary_join_element_wise("", pc.replace_substring(text, " ", MARK), MARK)
    split = pc.split_pattern(marked, MARK)
    parts = split.flatten()
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = parts.dictionary_encode()
    each = counter.counts([MARK + x for x in coded.dictionary.to_pylist()])
    tokens = each[coded.indices.to_numpy(zero_copy_only=False)]
    ends = np.cumsum(sizes)
    # What stands before the first mark is empty and no part.
    first = ends - sizes
    sums = np.r_[0, np.cumsum(tokens)]
    total = sums[ends] - sums[np.minimum(first + 1, ends)]
    # A text that begins with a mark of its own gets no further one.
    own = pc.or_(pc.starts_with(text, MARK), pc.starts_with(text, " ")).to_numpy(zero_copy_only=False)
    total = total - np.where(own, counter.counts([MARK])[0], 0)
    return pa.array(np.where(pc.binary_length(text).to_numpy(zero_copy_only=False) > 0, total, 0))


#: A worker's counter by its vocabulary.
_counters: dict[str, Counter] = {}


def token_counts(pieces: list[tuple[str, float]]):
    """A function of a text column: its number of tokens; 0 for a null or empty text."""

    key = hashlib.sha256(repr(pieces).encode()).hexdigest()

    def of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counters.get(key)
        if counter is None:
            _counters.clear()
            counter = _counters[key] = Counter(pieces)
        for column in columns:
            if isinstance(column, pa.ChunkedArray):
                column = column.combine_chunks()
            some = [_counted(column.slice(k, len(ends) - 1), counter) for k, _, ends in slices(column, BATCH)]
            yield pa.concat_arrays(some) if some else pa.array([], pa.int64())

    of.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(of, "bigint")


def op8_tokens(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """doc_id and n_tokens of every document.

    A null or empty text has 0 tokens; every row is counted, repeated ones too; an empty table stays empty.
    """
    in_small_batches(spark)
    return documents(spark, sf_dir).select("doc_id", token_counts(vocabulary(model))("text").alias("n_tokens"))
