"""Quality rules (operator 4): plain counts, and an n-gram likelihood ratio between trusted texts and the corpus.

Words and pairs of neighbouring words are hashed to buckets, whose number grows with the corpus: it is BUCKETS,
doubled until no more than LOAD bytes of text come to a bucket. Two multinomials over the buckets are estimated: one
from every document, one from the trusted target (all labelled documents of quality 1, marked by a join on doc_id). A
document's score is the mean over its n-grams of the log of the ratio of their probabilities, so length doesn't matter.

The threshold is the QUANTILE of the scores that all trusted documents have without their own part of the trusted counts, as
a document that is not in the labels would have. It then decides every document, in any number of runs alike.

DataFrame functions only. The ratios go to the tasks as one array as long as there are at most ARRAY of them (8 bytes
each, 16 for the threshold); beyond that, n-grams are joined to them by bucket, with the same scores: those of heavy buckets,
of which there are at most HEAVY, by sending these to the tasks, the others by a shuffle.

Each task that counts n-grams may send every bucket, so there are few such tasks: what they send grows with the buckets, not
with the number of tasks as well. For the threshold trusted texts are dealt by doc_id, once; their n-grams are then counted
by text where they lie.

A text is split and hashed once: what follows from it is bound to a lambda variable by let(), since a plain reference to an
expression inside a lambda would be worked out again for every element.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import documents, let, stored, words

#: Least number of buckets, most bytes of text to a bucket, and most buckets that go to tasks as an array.
BUCKETS = 10_000
LOAD = 2_500
ARRAY = 1 << 22
#: Most trusted documents whose ids go to every task; with more, texts are shuffled to their ids.
IDS = 1 << 21
#: Least number of tasks that count n-grams, if the texts lie in so many; and bytes of all text to a part of trusted texts.
TASKS = 12
PART = 32 << 20
#: Added to each feature's count, as a part of the mean count.
SMOOTHING = 0.05
#: Part of unseen trusted documents that the threshold may reject.
QUANTILE = 0.001
#: Bins that scores are counted in at a time, and most scores that are put in order together.
BINS = 1_000
TOGETHER = 8_192
#: Fixed value: how much farther from the middle than the tenth a normal distribution's QUANTILE lies.
TAIL = 3.0902 / 1.2816
#: Parts that a log ratio is counted in.
GRAIN = float(1 << 20)
#: Share of all n-grams from which a bucket counts as heavy; at most as many buckets are.
HEAVY = 100_000
LEAST_WORDS = 10
#: Percent of words that may lie in repeated windows.
MOST_REPEATED = 20
WINDOW = 5


def bucket(*hashes: Column, buckets: Column | None = None) -> Column:
    """The bucket (of BUCKETS if no number is given) of a word or of a pair of neighbours, by their hashes."""
    one = hashes[0] if len(hashes) == 1 else F.xxhash64(*hashes)
    return F.pmod(one, F.lit(BUCKETS).cast("long") if buckets is None else buckets.cast("long"))


def feature(*ws: Column, buckets: Column | None = None) -> Column:
    """The bucket of a word or of a pair of neighbours."""
    return bucket(*[F.xxhash64(w) for w in ws], buckets=buckets)


def _windows(hashes: Column) -> Column:
    """A hash for each run of five words, from the words' hashes."""
    at = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
    return F.when(F.size(hashes) >= WINDOW, F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))


def repeated_words(windows: Column, n: int = WINDOW) -> Column:
    """How many words lie in windows found twice or more."""

    def covered(keyed: Column) -> Column:
        # In order of hash, a window repeats if a neighbour has its hash.
        same = lambda x, k: x["h"] == F.get(keyed, k)["h"]
        hit = F.transform(keyed, lambda x, k: F.when(F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)), x["i"]))
        return F.sort_array(F.array_compact(hit))

    def total(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-n).alias("last"))
        return F.aggregate(places, start, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(n), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])

    def of(w: Column) -> Column:
        # Only windows whose hash repeats are sorted and walked.
        keyed = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), total(let(keyed, covered))).otherwise(F.lit(0)).cast("long")

    return let(windows, of)


OWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept")


def _pairs(hashes: Column) -> Column:
    """A hash for each pair of neighbours, from the words' hashes."""
    first = F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0)))
    return F.zip_with(first, F.slice(hashes, 2, 1 << 30), lambda a, b: F.xxhash64(a, b))


def _may_repeat(pairs: Column) -> Column:
    """Whether a run of four words may stand twice, as it does in a text with a window that does. Two last ones are null."""
    fours = F.zip_with(pairs, F.slice(pairs, 3, 1 << 30), lambda a, b: F.shiftleft(a, 1).bitwiseXOR(b))
    return let(fours, lambda x: F.size(F.array_distinct(x)) < F.size(x) - 1)


def counted(text: Column, ratios: Column | None, buckets: int = BUCKETS) -> Column:
    """Struct of the base counts and of the score by an array of log ratios of all buckets; a score of 0 without one."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    symbols = F.length(F.regexp_replace(text, "[^#*$%&|<>]++", ""))
    repeats = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))

    def scored(hashes: Column, pairs: Column) -> Column:
        if ratios is None:
            return F.lit(0.0)
        total = lambda hs: F.aggregate(hs, F.lit(0.0), lambda acc, h: acc + F.get(ratios, bucket(h, buckets=F.lit(buckets)).cast("int")))
        return F.when(F.size(hashes) > 0, (total(hashes) + total(pairs)) / (2 * F.size(hashes) - 1)).otherwise(F.lit(0.0))

    def of(ws: Column) -> Column:
        each = F.struct(F.size(ws).alias("n"), F.length(F.array_join(ws, "")).alias("chars"), F.transform(ws, lambda w: F.xxhash64(w)).alias("hashes"))
        return let(each, lambda x: let(_pairs(x["hashes"]), lambda pairs: counts(x, pairs)))

    def counts(x: Column, pairs: Column) -> Column:
        return F.struct(
            x["n"].cast("long").alias("n_words"),
            x["chars"].cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            repeats.cast("long").alias("n_dup_lines"),
            F.when(_may_repeat(pairs), repeated_words(_windows(x["hashes"]))).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
            scored(x["hashes"], pairs).alias("score"),
        )

    return let(words(text), of)


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()


def bucket_number(docs: DataFrame) -> int:
    """BUCKETS, doubled until at most LOAD bytes of text come to one."""
    size, out = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, BUCKETS
    while size > LOAD * out:
        out *= 2
    return out


def ngrams(docs: DataFrame, buckets: int, *keep: str) -> DataFrame:
    """The bucket f of every word and pair of neighbours, with the columns of keep."""
    return _ngrams(docs.select(*keep, words(F.col("text")).alias("ws")), buckets, *keep)


def _ngrams(split: DataFrame, buckets: int, *keep: str) -> DataFrame:
    """The same of texts split to words ws."""
    of = lambda *hashes: bucket(*hashes, buckets=F.lit(buckets))
    each = split.select(*keep, F.explode(F.arrays_zip(F.col("ws").alias("a"), F.slice("ws", 2, 1 << 30).alias("b"))).alias("x"))
    each = each.select(*keep, F.explode(F.array(of(F.xxhash64("x.a")), F.when(F.col("x.b").isNotNull(), of(F.xxhash64("x.a"), F.xxhash64("x.b"))))).alias("f"))
    return each.where("f is not null")


def _few(df: DataFrame) -> DataFrame:
    """The frame, sent to every task if it has at most IDS rows."""
    return F.broadcast(df) if df.limit(IDS + 1).count() <= IDS else df


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with t, 1 for the trusted ones and 0 for the others."""
    ids = _few(trusted_ids(labels).select(F.col("doc_id").alias("trusted_id")))
    return docs.join(ids, F.col("doc_id") == F.col("trusted_id"), "left").withColumn("t", F.col("trusted_id").isNotNull().cast("long")).drop("trusted_id")


def counts_of(docs: DataFrame, labels: DataFrame, buckets: int) -> DataFrame:
    """(f, n, t): how often each bucket that occurs does so in all documents, and in the trusted ones. A written table."""
    tasks = max(TASKS, 2 * docs.sparkSession.sparkContext.defaultParallelism)
    return stored(ngrams(marked(docs, labels).coalesce(tasks), buckets, "t").groupBy("f").agg(F.count("*").alias("n"), F.sum("t").alias("t")), "ngrams")


def _log(x: Column, total: Column, buckets: int) -> Column:
    return F.log((x + total * SMOOTHING / buckets) / (total * (1 + SMOOTHING)))


def _ratio(log_t: Column, log_n: Column) -> Column:
    # In parts of 2^-20, so that sums are exact and no order of rows or tasks changes a score.
    return F.rint((log_t - log_n) * GRAIN) / GRAIN


def ranked(scores: DataFrame, places: set[int]) -> dict[int, float]:
    """The scores (of a written table) that stand at places of their order, from 0 on. Scores are counted by bins of their
    range, and only bins in which a place lies are looked into: they are put in order, or counted by bins again."""
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    step = F.lit((high - low) / BINS)
    bin_of = F.when(step > 0, F.floor((F.col("score") - low) / step)).otherwise(F.lit(0))
    bins = scores.groupBy(bin_of.alias("bin")).agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("n")).collect()
    out, before = {}, 0
    for b in sorted(bins, key=lambda b: b.bin):
        own = {p - before for p in places if before <= p < before + b.n}
        inside = scores.where(F.col("score").between(b.low, b.high))
        if own and b.low < b.high:
            found = ranked(inside, own) if b.n > TOGETHER else dict(enumerate(sorted(r.score for r in inside.collect())))
            out |= {p + before: found[p] for p in own}
        else:
            out |= {p + before: b.low for p in own}
        before += b.n
    return out


def quantiles(scores: DataFrame, parts: tuple[float, ...]) -> list[float]:
    """Exact quantiles, linear between neighbours, of a written table of scores that has some."""
    last = scores.count() - 1
    at = ranked(scores, {k for q in parts for k in (math.floor(q * last), math.ceil(q * last))})
    return [at[math.floor(q * last)] + (q * last - math.floor(q * last)) * (at[math.ceil(q * last)] - at[math.floor(q * last)]) for q in parts]


def own_scores(docs: DataFrame, labels: DataFrame, counts: DataFrame, buckets: int, arrays: DataFrame | None) -> DataFrame:
    """The score of each trusted document, judged as one that is not trusted: without its own part of the trusted counts, and
    that of its equal rows. Documents without words have none, nor has one that is all there is. A written table."""
    whole = counts.agg(F.sum("n").alias("n"), F.sum("t").alias("t")).first()
    all_n, all_t = F.lit(whole.n or 0), F.lit(whole.t or 0)
    each = marked(docs, labels).where("t = 1").select("doc_id", "text").repartition(max(1, buckets * LOAD // PART), "doc_id")
    # Equal rows lie together and are one from here on, of which all rows' n-grams are taken.
    each = each.groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    each = each.select("doc_id", F.xxhash64("text").alias("h"), "copies", words(F.col("text")).alias("ws"))
    each = each.select("doc_id", "h", "copies", (F.col("copies") * (2 * F.size("ws") - 1)).alias("own"), "ws").where(F.col("own") < all_t)
    row = ("doc_id", "h", "copies", "own")
    found = _ngrams(each, buckets, *row).groupBy(*row, "f").agg(F.count("*").alias("m"))
    if arrays is not None:
        at = lambda c: F.get(arrays.select(c).scalar(), F.col("f").cast("int"))
        known = found.select(*row, "m", at("t").alias("t"), at("log_n").alias("log_n"))
    else:
        known = _looked_up(found, counts, whole.n or 0).select(*row, "m", "t", _log(F.col("n"), all_n, buckets).alias("log_n"))
    t = F.greatest(F.col("t") - F.col("m") * F.col("copies"), F.lit(0))
    part = F.col("m") * _ratio(_log(t, all_t - F.col("own"), buckets), F.col("log_n"))
    scores = known.groupBy(*row).agg(F.sum(part).alias("total")).select(F.col("total") * F.col("copies") / F.col("own"), "copies").toDF("score", "copies")
    return stored(scores.select(F.explode(F.array_repeat("score", F.col("copies").cast("int"))).alias("score")), "own_scores")


def threshold(docs: DataFrame, labels: DataFrame, counts: DataFrame, buckets: int, arrays: DataFrame | None = None) -> float:
    """QUANTILE of the scores that all trusted documents have as ones that are not trusted. 0 if there are none.

    A few scores say little of so small a share of them, as it is their least one; so what a normal tail from the median
    and the tenth on would reach counts where it is lower.
    """
    if arrays is None and buckets <= ARRAY:
        arrays = by_bucket(docs, counts, buckets)
    scores = own_scores(docs, labels, counts, buckets, arrays)
    if scores.isEmpty():
        return 0.0
    low, tenth, half = quantiles(scores, (QUANTILE, 0.1, 0.5))
    return float(min(low, half - TAIL * (half - tenth)))


def _every(docs: DataFrame, counts: DataFrame, buckets: int) -> DataFrame:
    """(f, n, t) of every bucket, 0 for those that don't occur."""
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("f")).join(counts, "f", "left")
    return every.select("f", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "t")])


def log_ratios(docs: DataFrame, counts: DataFrame, buckets: int) -> DataFrame:
    """(f, n, t, log_n, ratio) of every bucket: its counts, the log of its corpus probability, and the log of trusted over corpus
    probability, 0 without trusted words."""
    whole = counts.agg(F.sum("n").alias("n"), F.sum("t").alias("t")).first()
    log = lambda x, total: _log(F.col(x), F.lit(total), buckets)
    # Without any words there is no probability, nor a use for it.
    log_n = log("n", whole.n) if whole.n else F.lit(0.0)
    return _every(docs, counts, buckets).select("f", "n", "t", log_n.alias("log_n"), (_ratio(log("t", whole.t), log("n", whole.n)) if whole.t else F.lit(0.0)).alias("ratio"))


def by_bucket(docs: DataFrame, counts: DataFrame, buckets: int) -> DataFrame:
    """t, log_n and ratio of all buckets as arrays, by bucket. A written table of one row."""
    names = ("t", "log_n", "ratio")
    listed = log_ratios(docs, counts, buckets).agg(F.sort_array(F.collect_list(F.struct("f", *names))).alias("x"))
    return stored(listed.select(*[F.col("x")[c].alias(c) for c in names]), "ratios")


def _looked_up(each: DataFrame, values: DataFrame, total: int) -> DataFrame:
    """The rows of each, that have a bucket f, with its values (f, n and others): of heavy ones in the task, of others by a shuffle."""
    names, least = [c for c in values.columns if c != "f"], total // HEAVY + 1
    heavy = values.where(F.col("n") >= least).select("f", F.struct(*names).alias("__v"))
    both = each.join(F.broadcast(heavy), "f", "left")
    known = both.where("__v is not null").select(*each.columns, "__v.*")
    return known.union(both.where("__v is null").drop("__v").join(values.where(F.col("n") < least), "f").select(*each.columns, *names))


def _by_array(docs: DataFrame, arrays: DataFrame, buckets: int) -> DataFrame:
    """The documents with a column __q of counts and score."""
    # Not to be worked out again wherever a part of it is used: what depends on the partition is not moved or copied.
    # The array is named once, in let(), so that it isn't made a column that is copied into every row.
    found = F.when(F.spark_partition_id() >= 0, let(F.col("__r"), lambda r: counted(F.col("text"), r, buckets)))
    return docs.withColumn("__r", arrays.select("ratio").scalar()).withColumn("__q", found).drop("__r")


def _by_join(docs: DataFrame, ratios: DataFrame, buckets: int) -> DataFrame:
    """The same, by joining n-grams to their ratios."""
    # Longer than the name of any column, so it is none of them.
    row = max(docs.columns, key=len) + "_"
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    # Not counted by row first, which would shuffle every n-gram: heavy ones are added up where they lie.
    known = _looked_up(ngrams(numbered, buckets, row), ratios, ratios.agg(F.sum("n")).first()[0])
    scores = known.groupBy(row).agg((F.sum("ratio") / F.count("*")).alias("__s"))
    found = F.when(F.spark_partition_id() >= 0, counted(F.col("text"), None))
    return numbered.withColumn("__q", found).join(scores, row, "left").withColumn("__q", F.col("__q").withField("score", F.coalesce("__s", F.lit(0.0)))).drop(row, "__s")


def judged(docs: DataFrame, labels: DataFrame, least: float | None = None) -> DataFrame:
    """The documents with the base counts, score, base_failed and kept (score of at least the threshold, or least).

    A null or empty text has no words, score 0 and fails the base rules. Without trusted documents every score is 0.
    The input's columns of the same names are replaced; other columns and all rows stay, equal ones too. A null
    doc_id is in no label. An empty table stays empty.
    """
    docs = docs.drop(*OWN)
    light, buckets = docs.select("doc_id", "text"), bucket_number(docs)
    counts = counts_of(light, labels, buckets)
    arrays = by_bucket(docs, counts, buckets) if buckets <= ARRAY else None
    least = threshold(light, labels, counts, buckets, arrays) if least is None else least
    found = _by_join(docs, log_ratios(docs, counts, buckets).select("f", "n", "ratio"), buckets) if arrays is None else _by_array(docs, arrays, buckets)
    found = found.select(*docs.columns, *[F.col("__q")[c].alias(c) for c in OWN if c not in ("base_failed", "kept")])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= least))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and score of every document.

    A null or empty text, or one of white space, has counts of 0 and fails; texts of any length are counted whole; equal
    rows each have their row, with equal results; a null doc_id is in no label; without labels no score rejects; an empty
    table stays empty.
    """
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
