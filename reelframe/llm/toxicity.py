"""Toxicity (operator 1): a classifier chain of logistic regressions over hashed words.

Categories are predicted one after the other. The model of a category sees the words of a text and the
probabilities of all earlier categories. In training these probabilities come out of fold: each text's from a model
that was fitted without its fold, so a later model learns from probabilities as unsure as those it will meet.
Folds go by the text, so copies of a text share one. The models of a category, one for each fold left out and one
for all rows, are fitted side by side in tasks of their own.

Fitting takes at most TRAIN_DOCS labelled documents (those with the least hash of their text); every document is
scored, with its whole text. Features are the presence of words (runs of letters and digits, without regard to
ASCII case), so a long text doesn't thin out a single word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import documents, in_small_batches, stored
from reelframe.llm.wordhash import word_hashes

#: Bits of a feature's number.
BITS = 16
TRAIN_DOCS = 20_000
FOLDS = 3
#: Weight of the L1 norm against the mean loss: a few words tell a category, all others get no weight.
REGULARISATION = 3e-4
#: Features of fewer rows have no weight.
LEAST_ROWS = 3
#: A fit ends when no slope is further from its optimum than this part of REGULARISATION.
TOLERANCE = 0.02
#: Features that are let in at once, and bounds that a fit does not reach by far.
AT_ONCE, ROUNDS, STEPS = 200, 100, 3000
#: Probability from which a category holds.
LEAST = 0.5


def _present(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, features, first feature of each text and the end) of runs of texts."""
    for k, words in word_hashes(column, loose=True):
        both = np.unique(words.doc.astype(np.int64) << BITS | (words.hash >> np.uint64(64 - BITS)).astype(np.int64))
        first = np.searchsorted(both >> BITS, np.arange(len(words.first)))
        yield k, (both & ((1 << BITS) - 1)).astype(np.int32), first


def _features(column: pa.Array) -> pa.Array:
    out = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(found)) for _, found, first in _present(column)]
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))


def _sums(weights: np.ndarray, found: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.r_[0.0, np.cumsum(weights[found])]
    return total[first[1:]] - total[first[:-1]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def fit_logistic(found: np.ndarray, first: np.ndarray, more: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the hashed features, of the further columns and of the constant, in this order.

    The mean loss with an L1 norm (not of the constant) is brought to its minimum over a growing set of features:
    those whose slope is beyond the norm's join it, until there are none.
    """
    rows, size = len(y), (1 << BITS) + more.shape[1] + 1
    if not rows or not 0 < y.sum() < rows:
        # A constant probability: the share of ones, 0 without rows.
        share = np.clip(y.mean() if rows else 0.0, 1e-9, 1 - 1e-9)
        return np.r_[np.zeros(size - 1), np.log(share / (1 - share))]
    w = np.zeros(size)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    owner = np.repeat(np.arange(rows), np.diff(first))
    often = np.bincount(found, minlength=1 << BITS) >= LEAST_ROWS
    used = np.empty(0, np.int64)
    for _ in range(ROUNDS):
        # The features in use, numbered anew.
        number = np.full(1 << BITS, -1)
        number[used] = np.arange(len(used))
        own = number[found]
        kept = own >= 0
        starts = np.r_[0, np.cumsum(np.bincount(owner[kept], minlength=rows))]
        at = np.r_[used, np.arange(1 << BITS, size)]
        w[at], wrong = _minimum(own[kept], starts, owner[kept], more, y, w[at])
        slope = np.abs(np.bincount(found, wrong[owner], 1 << BITS))
        slope[used] = 0.0
        out = np.flatnonzero(often & (slope > (1 + TOLERANCE) * REGULARISATION))
        if not len(out):
            break
        used = np.r_[used, out[np.argsort(-slope[out], kind="stable")[:AT_ONCE]]]
    return w


def _minimum(found: np.ndarray, first: np.ndarray, owner: np.ndarray, more: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best weights of these features, the further columns and the constant from w on, by accelerated proximal steps;
    and the slope of the mean loss by each row's score."""
    rows, n = len(y), len(w) - 1 - more.shape[1]
    norm = np.r_[np.full(len(w) - 1, REGULARISATION), 0.0]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        x = _sums(w[:n], found, first) + more @ w[n:-1] + w[-1]
        return float(np.mean(np.logaddexp(0.0, x) - y * x)), (_sigmoid(x) - y) / rows

    ahead, pace, steep = w, 1.0, 1.0
    for _ in range(STEPS):
        here, wrong = loss(ahead)
        slope = np.r_[np.bincount(found, wrong[owner], n), more.T @ wrong, wrong.sum()]
        while True:
            to = ahead - slope / steep
            to = np.sign(to) * np.maximum(np.abs(to) - norm / steep, 0.0)
            by = to - ahead
            if loss(to)[0] <= here + slope @ by + steep / 2 * (by @ by) + 1e-12:
                break
            steep *= 2
        if steep * np.abs(by).max() <= TOLERANCE * REGULARISATION:
            w = to
            break
        if (ahead - to) @ (to - w) > 0:
            pace = 1.0
        after = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        ahead, w, pace, steep = to + (pace - 1) / after * (to - w), to, after, steep * 0.9
    return w, loss(w)[1]


@dataclass
class Chain:
    """Weights by category, in the chain's order."""

    categories: tuple[str, ...]
    weights: tuple[np.ndarray, ...]

    def probabilities(self, found: np.ndarray, first: np.ndarray) -> np.ndarray:
        """One row for each text, one column for each category."""
        out = np.empty((len(first) - 1, len(self.weights)))
        for k, w in enumerate(self.weights):
            out[:, k] = _sigmoid(_sums(w, found, first) + out[:, :k] @ w[1 << BITS : -1] + w[-1])
        return out

    def scored(self, docs: DataFrame, prefix: str = "p_") -> DataFrame:
        """The documents with a probability column for each category, named prefix and category.

        A null or empty text has no words and gets what the constants say. Columns of these names are replaced;
        all other columns and rows stay.
        """
        names = [f"{prefix}{c}" for c in self.categories]
        shared = docs.sparkSession.sparkContext.broadcast(self)

        def of(column: pa.Array) -> pa.Array:
            found = [shared.value.probabilities(x, first) for _, x, first in _present(column)]
            both = np.concatenate(found) if found else np.empty((0, len(names)))
            return pa.StructArray.from_arrays([pa.array(both[:, k]) for k in range(len(names))], names)

        kind = ", ".join(f"`{n}` double" for n in names)
        out = docs.drop(*names).withColumn("__p", F.arrow_udf(of, kind)("text"))
        return out.select(*[c for c in out.columns if c != "__p"], "__p.*")


def _fit_group(key: tuple, table: pa.Table, earlier: int) -> pa.Table:
    """The model that leaves out one fold (FOLDS: none) for rows of features, earlier probabilities and the mark."""
    lists = table["features"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    more = np.array(table["earlier"].to_pylist(), np.float64).reshape(table.num_rows, earlier)
    w = fit_logistic(lists.flatten().to_numpy(), np.r_[0, np.cumsum(sizes)], more, table["y"].to_numpy().astype(np.float64))
    return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([w.tolist()], pa.list_(pa.float64()))], ["model", "weights"])


def _fitted(data: DataFrame, category: str, earlier: int, models: list[int]) -> dict[int, np.ndarray]:
    """Weights by the fold that is left out, each model fitted by a task of its own."""
    known = data.where(F.col(category).isNotNull()).select("features", "earlier", F.col(category).alias("y"), "fold")
    dealt = known.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models]))).where("fold != model").drop("fold")
    found = dealt.groupBy("model").applyInArrow(lambda key, table: _fit_group(key, table, earlier), "model int, weights array<double>")
    out = {r.model: np.array(r.weights) for r in found.toLocalIterator()}
    nothing = (np.empty(0, np.int32), np.zeros(1, np.int64), np.empty((0, earlier)), np.empty(0))
    return {m: out[m] if m in out else fit_logistic(*nothing) for m in models}


def fit_chain(labelled: DataFrame, categories: tuple[str, ...], most: int = TRAIN_DOCS, folds: int = FOLDS) -> Chain:
    """Fits a chain on rows of text and one column of 0, 1 or null for each category.

    A category's model leaves out rows where it is null. Without both 0 and 1 among a category's rows its
    probability is constant: the share of ones, 0 where there are no rows.
    """
    listed = F.arrow_udf(_features, "array<int>")
    by = F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")
    known = labelled.select(by, *[F.col(c).cast("double").alias(c) for c in categories], listed("text").alias("features"))
    # Features, not texts, come together here: at most so many rows.
    sample = known.orderBy("h", *categories).limit(most).withColumn("fold", F.pmod(F.xxhash64("h", F.lit(7)), F.lit(folds)).cast("int"))
    data = stored(sample.withColumn("earlier", F.array().cast("array<double>")).drop("h"), "toxicity")
    weights: list[np.ndarray] = []
    for k, category in enumerate(categories):
        last = k + 1 == len(categories)
        models = _fitted(data, category, k, [folds] if last else list(range(folds + 1)))
        weights.append(models[folds])
        if not last:
            data = stored(data.withColumn("earlier", F.concat("earlier", F.array(_out_of_fold(models, k)))), "toxicity")
    return Chain(categories, tuple(weights))


def _out_of_fold(models: dict[int, np.ndarray], earlier: int) -> Column:
    """Each row's probability by the model that left out its fold."""

    def of(features: pa.Array, before: pa.Array, fold: pa.Array) -> pa.Array:
        first, found = np.r_[0, np.cumsum(np.diff(features.offsets.to_numpy()))], features.flatten().to_numpy()
        more = np.array(before.to_pylist(), np.float64).reshape(len(before), earlier)
        out, folds = np.zeros(len(features)), fold.to_numpy()
        for m, w in models.items():
            rows = folds == m
            out[rows] = _sigmoid(_sums(w, found, first) + more @ w[1 << BITS : -1] + w[-1])[rows]
        return pa.array(out)

    return F.arrow_udf(of, "double")("features", "earlier", "fold")


def labelled_documents(docs: DataFrame, marks: DataFrame, categories: tuple[str, ...], most: int = TRAIN_DOCS) -> DataFrame:
    """text and categories of a bounded sample: of the documents with marks (doc_id, categories), those whose text
    has one of the most least hashes; copies with equal marks count once. Texts aren't shuffled: ids and hashes are,
    and the chosen ids, a few for each hash at most, are broadcast.
    """
    light = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).join(marks, "doc_id")
    bound = light.select("h").distinct().orderBy("h").limit(most).agg(F.max("h").alias("h")).first().h
    picked = light.where(F.col("h") <= F.lit(bound).cast("long")).groupBy("h", *categories).agg(F.min("doc_id").alias("doc_id"))
    return docs.select("doc_id", "text").join(F.broadcast(picked.select("doc_id", *categories)), "doc_id").drop("doc_id")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, probabilities of junk and of toxic, and toxic (boolean) of every document.

    Every row is scored, repeated and empty ones too (a text without words by the constants); labels without a doc_id
    teach nothing; without labels nothing is toxic; an empty table stays empty.
    """
    in_small_batches(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    categories = ("junk", "toxic")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id is not null")
    marks = labels.select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")
    chain = fit_chain(labelled_documents(docs, marks, categories), categories)
    return chain.scored(docs).select("doc_id", "p_junk", "p_toxic", (F.col("p_toxic") >= LEAST).alias("toxic"))
