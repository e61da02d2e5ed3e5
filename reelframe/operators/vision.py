"""Faces of sampled frames: geometry, order, scores and picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from reelframe.functions.scalars import face_score, sampling_interval


def sampled(frames: DataFrame, fps: Column) -> DataFrame:
    """The frames that detection looks at."""
    return frames.where(F.col("frame") % sampling_interval(fps) == 0)


def with_geometry(boxes: DataFrame) -> DataFrame:
    """cx, cy and area of boxes x1, y1, x2, y2; boxes without area go."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return boxes.withColumns({"area": area, "cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2}).where("area > 0")


def ranked(faces: DataFrame) -> DataFrame:
    """face_idx: a sample's faces from the largest, equal ones as they were found (det)."""
    by = Window.partitionBy("clip_id", "sample_idx").orderBy(F.col("area").desc(), "det")
    return faces.withColumn("face_idx", F.row_number().over(by) - 1)


def best(faces: DataFrame) -> DataFrame:
    """The face with the best score of each sample, the first of equal ones."""
    score = face_score(F.col("area"), F.col("conf"), F.coalesce("speaking", F.lit(0.0)))
    pick = F.max_by(F.struct("face_idx", "cx", "area", score.alias("score")), F.struct(score, -F.col("face_idx"))).alias("f")
    return faces.groupBy("clip_id", "sample_idx").agg(pick).select("clip_id", "sample_idx", "f.*")


def nearest(faces: DataFrame, centre: Column, radius: Column) -> DataFrame:
    """The face of each sample that is nearest to a centre, if within the radius; the first of equal ones."""
    away = F.abs(F.col("cx") - centre)
    pick = F.min_by(F.struct("face_idx", "cx", away.alias("away")), F.struct(away, F.col("face_idx"))).alias("f")
    return faces.where(away <= radius).groupBy("clip_id", "sample_idx").agg(pick).select("clip_id", "sample_idx", "f.*")


def detection_stats(samples: DataFrame) -> DataFrame:
    """Samples, those with faces, and faces of each clip, from (clip_id, n_faces)."""
    return samples.groupBy("clip_id").agg(F.count("*").alias("n_samples"), F.count_if(F.col("n_faces") > 0).alias("with_faces"), F.sum("n_faces").cast("long").alias("n_faces"))


def watched(rows: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """The rows as they are, with totals that are counted as they go by: whatever is done with the rows next fills
    them, without a second pass. Read them by the observation's get."""
    seen = Observation(name)
    return rows.observe(seen, *[m.alias(k) for k, m in metrics.items()]), seen


def watched_samples(samples: DataFrame) -> tuple[DataFrame, Observation]:
    """Samples (clip_id, sample_idx, n_faces) with totals of what detection_stats counts by clip."""
    return watched(samples, "detections", n_samples=F.count(F.lit(1)), with_faces=F.count_if(F.col("n_faces") > 0), n_faces=F.coalesce(F.sum("n_faces"), F.lit(0)))


def watched_stats(stats: DataFrame) -> tuple[DataFrame, Observation]:
    """Crop statistics of clips with their totals."""
    names = ("target_keyframes", "source_cut_resets", "smooth_focus_changes", "hard_crop_jumps", "scene_cuts")
    return watched(stats, "crops", n_clips=F.count(F.lit(1)), **{c: F.coalesce(F.sum(c), F.lit(0)) for c in names})
