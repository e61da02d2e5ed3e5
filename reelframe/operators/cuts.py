"""Scene cuts: candidates from frame differences, thinned by a gap that counts from the last accepted one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelframe.config import DEFAULT, Config
from reelframe.functions.scalars import bhattacharyya, cut_gap, is_cut, mean_difference, safe_fps


def distances(hists: DataFrame) -> DataFrame:
    """hist_diff of each frame to the one before it, from (clip_id, frame, hist); null for the first."""
    by = Window.partitionBy("clip_id").orderBy("frame")
    before = F.lag("hist").over(by)
    return hists.withColumn("before", before).withColumn("hist_diff", F.when(F.col("before").isNotNull(), bhattacharyya(F.col("before"), F.col("hist")))).drop("before")


def differences(features: DataFrame) -> DataFrame:
    """hist_diff and pixel_diff of each frame to the one before it, from (clip_id, frame, hist, gray); gray in 0 .. 255."""
    by = Window.partitionBy("clip_id").orderBy("frame")
    seen = features.withColumns({"hist0": F.lag("hist").over(by), "gray0": F.lag("gray").over(by)}).where("hist0 is not null")
    return seen.select("clip_id", "frame", bhattacharyya(F.col("hist0"), F.col("hist")).alias("hist_diff"), (mean_difference(F.col("gray0"), F.col("gray")) / 255.0).alias("pixel_diff"))


def scene_cuts(features: DataFrame, media: DataFrame, conf: Config = DEFAULT) -> DataFrame:
    """(clip_id, frame) of the accepted cuts: differences, the predicate, and thinning by a gap that goes by each clip's
    frames per second (media: clip_id, fps)."""
    return accepted(differences(features), media, conf)


def accepted(differences: DataFrame, media: DataFrame, conf: Config = DEFAULT) -> DataFrame:
    """The cuts of differences (clip_id, frame, hist_diff, pixel_diff)."""
    found = differences.where(is_cut(F.col("hist_diff"), F.col("pixel_diff"), conf)).select("clip_id", "frame")
    rates = media.select("clip_id", cut_gap(safe_fps(F.col("fps")), conf).alias("gap"))
    return refractory(found.join(rates, "clip_id"), F.col("gap"))


def refractory(candidates: DataFrame, gap: int | Column) -> DataFrame:
    """The candidates (clip_id, frame) that come at least gap frames after the last accepted one; gap may be a column
    that a clip's rows share.

    A fold over each clip's sorted frames; only accepted frames are carried.
    """
    frames = F.sort_array(F.collect_set("frame"))
    empty = F.array().cast("array<bigint>")
    kept = F.aggregate(F.col("frames"), empty, lambda acc, f: F.when((F.size(acc) == 0) | (f - F.try_element_at(acc, F.lit(-1)) >= F.col("gap")), F.concat(acc, F.array(f.cast("bigint")))).otherwise(acc))
    gap = gap if isinstance(gap, Column) else F.lit(gap)
    return candidates.groupBy("clip_id").agg(frames.alias("frames"), F.max(gap).alias("gap")).select("clip_id", F.explode(kept).alias("frame"))


def with_reset(samples: DataFrame, cuts: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """Samples (clip_id, sample_idx, frame) with reset: whether a cut lies after the sample before and up to this one.

    A cut at frame 0 or, where media (clip_id, total_frames) is given, at or past the clip's end counts for nothing.
    Cuts and samples go through one sort per clip: a cut's frame, carried on, is compared with the last sample's.
    """
    cuts = cuts.where("frame > 0")
    if media is not None:
        cuts = cuts.join(media.select("clip_id", "total_frames"), "clip_id").where("frame < total_frames")
    both = samples.select("clip_id", "frame", F.lit(1).alias("kind"), "sample_idx").unionByName(cuts.select("clip_id", "frame", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("sample_idx")))
    upto = Window.partitionBy("clip_id").orderBy("frame", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("cut", F.max(F.when(F.col("kind") == 0, F.col("frame"))).over(upto)).where("kind = 1")
    before = F.lag("frame").over(Window.partitionBy("clip_id").orderBy("frame"))
    return seen.select("clip_id", "sample_idx", "frame", F.coalesce(F.col("cut") > F.coalesce(before, F.lit(-1)), F.lit(False)).alias("reset"))
