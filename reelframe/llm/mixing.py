"""Mixing sources to target weights (operator 3), with DataFrame functions only.

The words of a source's documents, in a pseudorandom order, are packed end to end into blocks of BLOCK words, the last of
which may be shorter. The mix has as many slots as its words need, in shards of SHARD slots. Each slot of a shard draws its
source by the targets' shares, from a hash of its number, so a shard's counts are multinomial and no shard waits for
another. Over all shards a source is then drawn a little too often or too seldom: what its last slots have too many goes,
slot for slot, to the sources that lack some, so the mix meets its targets to the slot.

A source's slots are numbered through; slot i takes the block that a pseudorandom permutation of the source's blocks has at i,
a new one for each time around. Slots then join blocks by index. A source's last slot takes as many words of its block
as its target still lacks, so sources of less than a block meet theirs too.

The permutation is a swap-or-not shuffle: in each round an index and its mirror image around a round key change
places or not, by one bit of a hash of the larger of them. It works for any number of blocks and needs no table.

A target is at most MOST times its source's size, and no block is taken more than MOST times. Any number of sources is
allowed: their table (a row each) is ordered by single tasks, and goes to all tasks up to SENT rows; beyond that rows are
shuffled to it, SALT ways for each source. A draw finds its source by cells of equal width, in which few sources begin.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelframe.llm.common import documents, let, stored, words
from reelframe.llm.numbering import TOGETHER, with_running

BLOCK = 64
SHARD = 1024
MOST = 3
#: Weights of sources by rank, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
ROUNDS = 12
#: Sources whose table goes to all tasks, and the ways that rows of a source spread beyond that.
SENT, SALT = 10_000, 64
#: Parts of 1 that draws and shares are counted in.
PARTS = 1 << 40
SEED = 20_240_229


def swapped(index: Column, n: Column, r: int, *key: Column) -> Column:
    """Round r of a pseudorandom permutation of 0 .. n - 1 that the key picks."""
    # A hash within n first: the difference of two longs may leave their range.
    mirror = F.pmod(F.pmod(F.xxhash64(F.lit(SEED + r), *key), n) - index, n)
    return F.when(F.xxhash64(F.greatest(index, mirror), F.lit(r), *key) % 2 != 0, mirror).otherwise(index)


def sources(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, rank, source_size, target, docs) of rows (source, size); ranks by code point, null last.

    Targets share all words by weight. A target of more than most times its source's size stops there; what is over
    goes to the others by weight. With sources in order of size by weight, those that stop come first, and each
    place's level tells whether its source does.
    """
    one = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    one = one.withColumn("rank", F.row_number().over(by_name) - 1)
    one = one.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("rank") % len(weights) + 1))
    one = one.withColumn("cap", (F.col("source_size") * most).cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    one = one.withColumn("level", rest / left)
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)["level"]
    return one.withColumn("target", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))).select("source", "rank", "source_size", "target", "docs")


@dataclass
class Mix:
    """sources: (source, rank, source_size, target, docs).
    placed: each row with words by (rank, start), its source's number and its first word among the source's, with
    size and the carried columns; empty: (rank, carried columns) of rows without words.
    slots: (shard, rank, turn, block, words), a row for each slot of the mix; words where it takes less than its block.
    pieces: (rank, start, low, high, times): words low .. high - 1 of a row, and how often the mix takes them."""

    sources: DataFrame
    placed: DataFrame
    empty: DataFrame
    slots: DataFrame
    pieces: DataFrame


def mix(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, shard: int = SHARD, most: int = MOST) -> Mix:
    """Mixes rows of doc_id, text and source, taking along the columns of carry.

    A null or blank text has no words and is in no block; a null source is a source. An empty table has no slots.
    Carried columns keep their values, whatever their names.
    """
    kept = F.struct(*[F.col(c) for c in carry]).alias("row")
    sized = docs.select("source", F.col("doc_id").alias("__id"), F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64("doc_id", "text", "source").alias("h"), kept)
    sized = stored(sized, "sized")
    by_source = stored(sources(sized, weights, most), "sources")
    ranked = with_table(sized, by_source.select(F.col("source").alias("s"), "rank", "docs"), F.col("source").eqNullSafe(F.col("s")), F.xxhash64("h", "__id")).drop("source", "s")
    bucket = F.pmod(F.xxhash64("h", F.lit(SEED)), F.ceil(F.col("docs") / TOGETHER))
    placed = with_running(ranked.where("size > 0"), ["rank"], bucket, [F.col("h"), F.col("__id")], F.col("size"), "start")
    placed = stored(placed.select("rank", "start", "size", "row"), "placed")
    slots = stored(_slots(by_source.where("source_size > 0"), block, shard, most), "slots")
    taken = slots.groupBy("rank", "block").agg(F.count_if(F.col("words").isNull()).alias("times"), F.max("words").alias("part"))
    ends = F.floor((F.col("start") + F.col("size") - 1) / block)
    held = placed.select("rank", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), ends)).alias("block"))
    low = F.greatest(F.lit(0).cast("long"), F.col("block") * block - F.col("start"))
    high = F.least(F.col("size"), (F.col("block") + 1) * block - F.col("start"))
    # The words of a block that is taken in part once more: those up to the part have one time more.
    cut = F.least(F.greatest(F.col("block") * block + F.coalesce("part", F.lit(0)) - F.col("start"), low), high)
    each = F.filter(F.array(F.struct(low.alias("low"), cut.alias("high"), (F.col("times") + 1).alias("times")), F.struct(cut.alias("low"), high.alias("high"), F.col("times").alias("times"))), lambda p: (p["low"] < p["high"]) & (p["times"] > 0))
    pieces = held.join(taken, ["rank", "block"]).select("rank", "start", F.inline(each))
    return Mix(by_source, placed, ranked.where("size = 0").select("rank", "row"), slots, pieces)


def with_table(rows: DataFrame, table: DataFrame, on: Column, by: Column) -> DataFrame:
    """The rows joined to a table of one row a source: sent to all tasks, or beyond SENT rows with each of its rows SALT
    times, so that no task has all rows of a source."""
    if table.count() <= SENT:
        return rows.join(F.broadcast(table), on)
    salted = rows.withColumn("__turn", F.pmod(by, F.lit(SALT)))
    each = table.withColumn("__at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return salted.join(each, on & (F.col("__turn") == F.col("__at"))).drop("__turn", "__at")


def shares(by_source: DataFrame, block: int, most: int) -> DataFrame:
    """(rank, blocks, n, part, low, high): a source's blocks and slots, the words of its last slot where that takes a part of a
    block only, and its range of draws."""
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    # Whole times around take all words; the rest is whole blocks and a part of one. The block that is shorter than the
    # others may be among them, so a target is met to within a block.
    words_ = F.least(F.round("target").cast("long"), F.col("source_size") * most)
    turns, rest = F.floor(words_ / F.col("source_size")), words_ % F.col("source_size")
    part = F.when(rest % block > 0, rest % block)
    each = by_source.select("rank", blocks.alias("blocks"), (turns * blocks + F.ceil(rest / block)).cast("long").alias("n"), part.cast("long").alias("part"))
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("n").over(before) / F.sum("n").over(Window.partitionBy())
    return each.withColumn("high", F.round(share * PARTS).cast("long")).withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("rank")), F.lit(0))).where("n > 0")


def drawn(total: int, parts: DataFrame, shard: int) -> DataFrame:
    """(shard, id, rank): the source that each slot draws by the shares of parts."""
    slots = parts.sparkSession.range(total).select(F.floor(F.col("id") / shard).alias("shard"), "id", F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(PARTS)).alias("u"))
    # About as many cells as sources; a source is in each cell that its range touches.
    cells = 1 << max(4, parts.count().bit_length())
    cell = lambda x: F.floor(x / (PARTS // cells)).cast("long")
    ranges = parts.where("high > low").select("rank", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))).alias("cell"))
    ranges = F.broadcast(ranges) if cells <= SENT else ranges
    return slots.withColumn("cell", cell(F.col("u"))).join(ranges, "cell").where("u >= low and u < high").select("shard", "id", "rank")


def _slots(by_source: DataFrame, block: int, shard: int, most: int) -> DataFrame:
    """(shard, rank, turn, block, words) of every slot of the mix; words is null where it takes all of its block's."""
    parts = stored(shares(by_source, block, most), "shares")
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    near = F.floor(F.col("shard") / max(1, TOGETHER // shard))
    own = stored(with_running(drawn(total, parts, shard), ["rank"], near, [F.col("shard"), F.col("id")], F.lit(1), "slot"), "draws")
    sized = with_table(own, parts.select(F.col("rank").alias("r"), "n"), F.col("rank") == F.col("r"), F.xxhash64("id")).drop("r")
    # Slots beyond a source's number go to the sources that lack some, in order of both.
    counts = own.groupBy("rank").agg(F.count("*").alias("had"))
    lack = parts.join(counts, "rank", "left").withColumn("lack", F.col("n") - F.coalesce("had", F.lit(0))).where("lack > 0")
    upto = F.sum("lack").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    lack = lack.select(F.col("rank").alias("to"), F.coalesce("had", F.lit(0)).alias("had"), (upto - F.col("lack")).alias("first"), "lack")
    free = lack.select("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lack") - 1)).alias("k"), "had", "first").select("to", (F.col("had") + F.col("k")).alias("to_slot"), (F.col("first") + F.col("k")).alias("place"))
    over = sized.where("slot >= n").withColumn("all", F.lit(0))
    over = with_running(over, ["all"], near, [F.col("shard"), F.col("id")], F.lit(1), "place").join(free, "place").select("shard", F.col("to").alias("rank"), F.col("to_slot").alias("slot"))
    slots = sized.where("slot < n").select("shard", "rank", "slot").union(over)
    slots = with_table(slots, parts.select(F.col("rank").alias("r"), "blocks", "n", "part"), F.col("rank") == F.col("r"), F.xxhash64("slot")).drop("r")
    last = F.when(F.col("slot") == F.col("n") - 1, F.col("part"))
    slots = slots.select("shard", "rank", "blocks", F.floor(F.col("slot") / F.col("blocks")).alias("turn"), (F.col("slot") % F.col("blocks")).alias("index"), last.alias("words"))
    # Each round refers to the one before it more than once, so each is a column of its own.
    for r in range(ROUNDS):
        slots = slots.withColumn("index", swapped(F.col("index"), F.col("blocks"), r, F.col("rank"), F.col("turn")))
    return slots.select("shard", "rank", "turn", F.col("index").alias("block"), "words")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and the words taken of every document.

    A null or blank text has size 0 and nothing taken; a null source is a source, the last; equal rows are placed and
    taken each by itself; an empty table stays empty.
    """
    mixed_ = mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    taken = mixed_.pieces.groupBy("rank", "start").agg(F.sum((F.col("high") - F.col("low")) * F.col("times")).alias("taken"))
    some = mixed_.placed.join(taken, ["rank", "start"], "left").select("rank", "row", "size", F.coalesce("taken", F.lit(0)).alias("taken"))
    none = mixed_.empty.select("rank", "row", F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("taken"))
    every = with_table(some.unionByName(none), mixed_.sources.withColumnRenamed("rank", "r"), F.col("rank") == F.col("r"), F.xxhash64("row"))
    return every.select("row.doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows like the input's: one for each time that some of a document is taken.

    A row whose words are all taken keeps its text as it is; of others the words taken remain, joined by a space.
    Documents that the mix doesn't take, and those without words, are left out.
    """
    got = mix(docs, tuple(docs.columns), **options)
    piece = F.struct("low", "high", "times")
    held = got.pieces.groupBy("rank", "start").agg(F.array_sort(F.collect_list(piece)).alias("pieces"), F.max("times").alias("most"))
    rows = got.placed.join(held, ["rank", "start"]).select("row", "size", "pieces", F.explode(F.sequence(F.lit(1).cast("long"), F.col("most"))).alias("time"))
    rows = rows.select("row", "size", F.filter("pieces", lambda p: p["times"] >= F.col("time")).alias("pieces"))
    n = F.aggregate("pieces", F.lit(0).cast("long"), lambda acc, p: acc + p["high"] - p["low"])
    cut = let(words(F.col("row.text")), lambda ws: F.array_join(F.flatten(F.transform("pieces", lambda p: F.slice(ws, p["low"].cast("int") + 1, (p["high"] - p["low"]).cast("int")))), " "))
    text = F.when(n == F.col("size"), F.col("row.text")).otherwise(cut)
    return rows.select(*[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
