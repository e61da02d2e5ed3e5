"""From a clip's faces to its crop path: tracks, speech, focus, targets and smoothing.

Faces, cuts and media meet as one timeline, which one shuffle by clip_id and one sort bring into order. Tracks and focus are
a fold over it that takes a batch of rows at a time and gives a row for each sample; it holds the tracks and the
faces of one sample, however long the clip. Its keys go on as pieces (see path.py), whose smoothing is dealt out by
segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelframe.config import DEFAULT, Config
from reelframe.functions.scalars import safe_fps, smoothing_window
from reelframe.operators import path
from reelframe.operators.focus import Face, Focus, Key, Track, clamped, focus_step, mouth_of, speak

MEDIA_FIELDS = "src_w int, src_h int, fps double, total_frames bigint"
FACE_FIELDS = "sample_idx bigint, face_idx bigint, cx double, area double, conf double, width double, mouth array<double>"
#: A timeline's rows: media (kind 0, before all frames), cuts (1) and faces (2), one without face_idx for a sample without faces.
ROW = f"frame bigint, kind int, {FACE_FIELDS}, {MEDIA_FIELDS}"
SAMPLE = f"clip_id bigint, kind int, seq bigint, sample_idx bigint, frame bigint, cx double, hard boolean, reset boolean, change boolean, spoken array<struct<face_idx:bigint,track:bigint,speaking:double>>, {MEDIA_FIELDS}"
BEGIN, CUT, KEY = 0, 1, 2


def row(kind: int, **values: Column) -> Column:
    """A timeline's row as a struct of ROW."""
    given = values | {"kind": F.lit(kind)}
    return F.struct(*[given.get(name, F.lit(None)).cast(of).alias(name) for name, of in (f.split(" ") for f in ROW.split(", "))])


def media_row() -> Column:
    return row(BEGIN, frame=F.lit(-(1 << 62)), src_w=F.col("src_w"), src_h=F.col("src_h"), fps=safe_fps(F.col("fps")), total_frames=F.col("total_frames"))


def face_row() -> Column:
    return row(KEY, **{f.split(" ")[0]: F.col(f.split(" ")[0]) for f in ["frame x", *FACE_FIELDS.split(", ")]})


def timeline(faces: DataFrame, cuts: DataFrame, media: DataFrame) -> DataFrame:
    """One table (clip_id and ROW) of faces (clip_id, frame and FACE_FIELDS), cuts (clip_id, frame) and media (clip_id and
    MEDIA_FIELDS). Tables that come from one base are better made to rows there, with row(), in one reading."""
    each = [media.select("clip_id", media_row().alias("r")), cuts.select("clip_id", row(CUT, frame=F.col("frame")).alias("r")), faces.select("clip_id", face_row().alias("r"))]
    return each[0].union(each[1]).union(each[2]).select("clip_id", "r.*")


class Fold:
    """Tracks, speech and focus of one clip, from its media on."""

    def __init__(self, src_w: int, src_h: int, fps: float, total: int, conf: Config = DEFAULT):
        self.media, self.conf, self.window = (src_w, src_h, fps, total), conf, smoothing_window(fps, conf)
        self.tracks: list[Track] = []
        self.state, self.cut, self.seq = Focus(), False, 0

    def within(self, frame: int) -> bool:
        return 0 < frame < self.media[3]

    def sample(self, frame: int, faces: list[tuple]) -> tuple[Key | None, list[tuple[int, float]]]:
        """The key frame (none in a clip without frames), and track and speech of each face (cx, area, conf, width, mouth)."""
        src_w, src_h, fps, total = self.media
        found = [Face(cx, area, conf, width, mouth_of(mouth)) for cx, area, conf, width, mouth in faces]
        said = speak(self.tracks, found, self.window)
        key = focus_step(self.state, frame, found, [x for _, x in said], self.cut, src_w, src_h, fps, self.conf)
        self.cut = False
        return (clamped(key, src_w, src_h, total) if total > 0 else None), said

    def middle(self) -> Key:
        return clamped(Key(0, self.media[0] / 2), self.media[0], self.media[1], self.media[3])


def samples(timeline: DataFrame, conf: Config = DEFAULT) -> DataFrame:
    """SAMPLE rows of a timeline: one for each sample (kind 2) with its key frame and what its faces say, one for each cut
    (1; frame is null where it lies outside the clip), and one for frame 0 of each clip (0).

    The key of a clip without frames is null; a clip without samples has one key in its middle; clips without media are
    left out. Faces go by frame, sample_idx and face_idx, so the frames of samples grow with their numbers. The window
    that numbers a clip's rows brings them together and into order; it shuffles only what is not together yet.
    """
    by = Window.partitionBy("clip_id").orderBy("frame", "kind", "sample_idx", "face_idx")
    names = ["clip_id", "place", *[f.split(" ")[0] for f in ROW.split(", ")]]
    out = [f.split(" ")[0] for f in SAMPLE.split(", ")]
    spoken = pa.list_(pa.struct([("face_idx", pa.int64()), ("track", pa.int64()), ("speaking", pa.float64())]))
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.bool_(), pa.bool_(), spoken, pa.int32(), pa.int32(), pa.float64(), pa.int64()]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clip, fold, last, at, faces = None, None, 0, None, []
        made: list[tuple] = []

        def close() -> None:
            """The sample that is open becomes a row."""
            nonlocal at, faces
            if at is not None:
                k, said = fold.sample(at[0], [f[1:] for f in faces])
                spoken = [{"face_idx": f[0], "track": t, "speaking": x} for f, (t, x) in zip(faces, said, strict=True)]
                made.append((clip, KEY, fold.seq, at[1], *((k.frame, k.cx, k.hard, k.reset, k.change) if k else (None,) * 5), spoken, *fold.media))
                fold.seq += 1
            at, faces = None, []

        def end() -> None:
            close()
            if fold and not fold.seq and fold.media[3] > 0:
                k = fold.middle()
                made.append((clip, KEY, 0, None, k.frame, k.cx, False, False, False, [], *fold.media))

        def batch_of() -> pa.RecordBatch:
            full = pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)], out)
            made.clear()
            return full

        for batch in batches:
            for own, place, frame, kind, sample, face, cx, area, sure, width, mouth, *media in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if place == 1:
                    end()
                    clip, fold = own, None
                elif (own, place) != (clip, last + 1):
                    raise ValueError("the rows of a clip are out of order")
                last = place
                if at is not None and at != (frame, sample):
                    close()
                if kind == BEGIN and fold is None:
                    fold = Fold(*media, conf)
                    if media[3] > 0:
                        made.append((clip, BEGIN, None, None, 0, None, False, False, False, None, *media))
                elif kind == CUT and fold:
                    inside = fold.within(frame)
                    fold.cut |= inside
                    made.append((clip, CUT, None, None, frame if inside else None, None, True, False, False, None, *fold.media))
                elif kind == KEY and fold:
                    at = (frame, sample)
                    if face is not None:
                        faces.append((face, cx, area, sure, width, mouth))
            if made:
                yield batch_of()
        end()
        if made:
            yield batch_of()

    return timeline.withColumn("place", F.row_number().over(by)).select(*names).mapInArrow(of, SAMPLE)


def keys(samples: DataFrame) -> DataFrame:
    """The key frames of samples."""
    return samples.where(f"kind = {KEY} and frame is not null").select("clip_id", "seq", "frame", "cx", "hard", "reset", "change")


def spoken(samples: DataFrame) -> DataFrame:
    """Track and speech of each face of samples."""
    some = samples.select("clip_id", "sample_idx", F.explode_outer("spoken").alias("s"))
    return some.where("s is not null").select("clip_id", "sample_idx", "s.*")


def pieces_of(samples: DataFrame, together: bool = False) -> DataFrame:
    """The pieces of the samples' keys and cuts."""
    marks = samples.where("frame is not null").select("clip_id", "frame", "seq", "cx", F.col("hard").alias("starts"), "src_w", "src_h", "fps", "total_frames")
    return path.pieces(marks, F.col("src_w") / 2, together=together)


def paths(samples: DataFrame, conf: Config = DEFAULT, together: bool = False) -> DataFrame:
    """clip_id, frame and cx of every frame, held within the picture, with src_w, src_h and total_frames. Samples of a table
    that is bucketed by clip_id (together) are not shuffled."""
    made = path.smoothed(pieces_of(samples, together), conf, jumps=False, keep=("src_w", "src_h", "total_frames"), deal=not together)
    return path.held(made, F.col("src_w"), F.col("src_h")).drop("jump")


def stats(samples: DataFrame, conf: Config = DEFAULT) -> DataFrame:
    """The counts that a clip's crop path is reported with; clips without frames have none.

    What samples and cuts add to them goes along with the marks of their frame, so all is one pass over the samples.
    """
    one = lambda c: F.when(c, 1).otherwise(0)
    key = F.col("kind") == KEY
    counts = {"n_keys": one(key), "n_resets": one(key & F.col("reset")), "n_changes": one(key & F.col("change")), "n_cuts": one(F.col("kind") == CUT)}
    # Cuts outside a clip count as well; they are put on its first frame.
    some = samples.withColumns(counts).withColumns({"frame": F.when((F.col("kind") == CUT) & F.col("frame").isNull(), 0).otherwise(F.col("frame")), "hard": F.col("hard") & F.col("frame").isNotNull()})
    marks = some.where("frame is not null and total_frames > 0").select("clip_id", "frame", "seq", "cx", F.col("hard").alias("starts"), "src_w", "src_h", "fps", "total_frames", *counts)
    each = path.pieces(marks, F.col("src_w") / 2, sums=tuple(counts)).withColumn("first", F.col("begin"))
    made = path.smoothed(each, conf, keep=("first", *counts))
    long = lambda c: F.sum(F.when(F.col("frame") == F.col("first"), F.col(c))).cast("long")
    return made.groupBy("clip_id").agg(long("n_keys").alias("target_keyframes"), long("n_resets").alias("source_cut_resets"), long("n_changes").alias("smooth_focus_changes"), F.count_if("jump").alias("hard_crop_jumps"), long("n_cuts").alias("scene_cuts"))
