"""Sharding (operator 6): k-d tree partitioning by weighted medians, with DataFrame functions only.

A node of the tree holds rows and the number of leaves that are to come of it: the table's bytes by the target. It
is cut along its widest metadata dimension (each scaled to 0 .. 1 over all kinds of values) at the weighted median,
where its bytes divide as its leaves do. Rows are points; their weight is the size.

A median is found over all nodes of a level at once, digit by digit of a sort key: the place in the dimension, then
a hash that breaks ties, so one value that many rows share can be cut as well, then one by the row's place in the table,
so rows that are equal in everything can be. Each digit takes one aggregation to
at most 2 ** DIGIT sums a node, and running sums over those. Nothing is gathered but the table of the level's nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelframe.llm.common import documents, dropped, stored
from reelframe.llm.numbering import TOGETHER, with_running

SHARDS = 16
LAW = "bytes"
#: Bits of a digit of the sort key, and digits: of the place in the dimension, of the hash, and of the row.
DIGIT, DIGITS = 16, 3
SEED = 20_240_306
OWN = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _scaled(x: Column) -> Column:
    """A value of any kind between 0 and 1: equal values lie together; null is 0."""
    return F.coalesce(F.pmod(F.xxhash64(x), F.lit(1 << 24)) / float(1 << 24), F.lit(0.0))


def dimensions(docs: DataFrame) -> dict[str, Column]:
    """The metadata that the tree is cut along: length (by its logarithm), language and source."""
    kinds = {"length": F.least(F.lit(1.0), F.log2(F.col("size").cast("double")) / 40.0)}
    return kinds | {c: F.when(F.col(c).isNotNull(), _scaled(F.col(c))).otherwise(F.lit(0.0)) for c in ("lang", "source") if c in docs.columns}


def leaves(points: DataFrame, dims: list[str], shards: int = SHARDS) -> DataFrame:
    """The points (size, tie and the columns of dims in 0 .. 1) with a leaf number from 0, as a written table.

    tie is a number that orders rows with one place, by its low DIGIT bits. A leaf's bytes come within about half a row, for each level, of
    the table's bytes by shards. With fewer rows than shards some leaves stay empty.
    """
    again = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << DIGIT))
    points = stored(points.withColumns({"leaf": F.lit(0), "n": F.lit(shards), "again": again}), "points")
    levels = max(0, (shards - 1).bit_length())
    for _ in range(levels):
        stats = points.where("n > 1").groupBy("leaf", "n").agg(F.sum("size").alias("total"), *[(F.max(d) - F.min(d)).alias(f"w_{d}") for d in dims])
        widest = F.array_max(F.array(*[F.struct(F.col(f"w_{d}").alias("w"), F.lit(-k).alias("k")) for k, d in enumerate(dims)]))
        goal = F.col("total") * F.floor(F.col("n") / 2) / F.col("n")
        nodes = stored(stats.select("leaf", (-widest["k"]).alias("dim"), goal.alias("goal"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below")), "nodes")
        place = F.floor(F.element_at(F.array(*dims), F.col("dim") + 1) * float((1 << DIGIT) - 1)).cast("long")
        key = F.shiftleft(place, 2 * DIGIT).bitwiseOR(F.shiftleft(F.pmod("tie", F.lit(1 << DIGIT)), DIGIT)).bitwiseOR(F.col("again"))
        for digit in range(DIGITS):
            low = DIGIT * (DIGITS - 1 - digit)
            keyed = points.where("n > 1").join(F.broadcast(nodes), "leaf").select("leaf", "size", key.alias("key"), "prefix")
            here = keyed.where(F.shiftright("key", low + DIGIT) == F.col("prefix")).groupBy("leaf", F.shiftright("key", low).alias("at")).agg(F.sum("size").alias("bytes"))
            upto = Window.partitionBy("leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
            run = here.withColumn("run", F.sum("bytes").over(upto)).join(F.broadcast(nodes.drop("bytes")), "leaf").where(F.col("below") + F.col("run") >= F.col("goal"))
            nodes = stored(run.groupBy("leaf").agg(F.min(F.struct("at", "run", "bytes", "dim", "goal", "below")).alias("m")).select("leaf", "m.dim", "m.goal", F.col("m.at").alias("prefix"), (F.col("m.below") + F.col("m.run") - F.col("m.bytes")).alias("below"), F.col("m.bytes").alias("bytes")), "nodes")
        # Rows with the median key itself go to the side that is nearer to the goal.
        closer = F.col("below") + F.col("bytes") - F.col("goal") <= F.col("goal") - F.col("below")
        cuts = nodes.select("leaf", "dim", F.when(closer, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("cut"))
        half = F.floor(F.col("n") / 2).cast("int")
        moved = points.join(F.broadcast(cuts), "leaf", "left").withColumn("right", F.coalesce(key > F.col("cut"), F.lit(False)) & (F.col("n") > 1))
        moved = moved.withColumn("leaf_", F.when(F.col("right"), F.col("leaf") + half).otherwise(F.col("leaf"))).withColumn("n", F.when(F.col("n") <= 1, F.col("n")).when(F.col("right"), F.col("n") - half).otherwise(half))
        before, points = points, stored(moved.drop("leaf", "dim", "cut", "right").withColumnRenamed("leaf_", "leaf"), "points")
        dropped(before)
    return points.drop("n", "again")


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The documents' metadata (every column but text) with size, text_crc32, law, shard, slot and grown_shard.

    A null text counts as an empty one: size 1, CRC-32 0. Null metadata is a value of its own. Equal rows are told
    apart only by their slots. The input's columns of these names are replaced; an empty table stays empty.
    """
    docs = docs.drop(*OWN)
    text = F.coalesce("text", F.lit(""))
    others = [c for c in docs.columns if c != "text"]
    light = docs.select(F.struct(*others).alias("row"), *[c for c in ("lang", "source") if c in others], (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(*[F.col(c) for c in others if c == "doc_id"], text, F.lit(SEED)).alias("tie"))
    dims = dimensions(light)
    points = light.select("row", "size", "text_crc32", "tie", *[x.alias(f"d_{d}") for d, x in dims.items()])
    placed = leaves(points, [f"d_{d}" for d in dims], shards).select("row", "size", "text_crc32", "tie", F.col("leaf").alias("shard"))
    many = placed.groupBy("shard").agg(F.ceil(F.count("*") / TOGETHER).alias("many"))
    bucketed = placed.join(F.broadcast(many), "shard")
    order = [F.col("tie"), F.col("size"), F.col("text_crc32")]
    out = with_running(bucketed, ["shard"], F.pmod(F.xxhash64("tie", F.lit(1)), F.col("many")), order, F.lit(1), "slot")
    return out.select("row.*", "size", "text_crc32", F.lit(LAW).alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    Null, empty and repeated rows have shards and slots like all others; an empty table stays empty.
    """
    found = sharded(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    return found.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
