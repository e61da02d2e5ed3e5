"""The crop path: key frames to a centre for each frame, smoothed and held within the picture.

Keys and cuts are laid out as pieces, spans of frames between two marks with one formula each, by windows over a clip's
marks; frames come into being only when a piece is spelled out. Smoothing starts anew at every cut, so the pieces of each
segment between two cuts are folded on their own: a clip's segments spread over tasks, and a task holds one piece and
one centre at a time, however long the clip or the segment.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelframe.config import DEFAULT, Config
from reelframe.functions.scalars import clamp, crop_left, crop_width

#: Frames that a task hands on together.
CHUNK = 1 << 14


def deduplicated(keys: DataFrame) -> DataFrame:
    """One row for each frame: the centre of the last key (by seq); hard if any key there is."""
    return keys.groupBy("clip_id", "frame").agg(F.max_by("cx", "seq").alias("cx"), F.max("hard").alias("hard"))


def all_cuts(cuts: DataFrame, keys: DataFrame) -> DataFrame:
    """Scene cuts and hard key frames, each frame once."""
    return cuts.select("clip_id", "frame").union(keys.where("hard").select("clip_id", "frame")).distinct()


def marks(keys: DataFrame, cuts: DataFrame, media: DataFrame) -> DataFrame:
    """The marks of clips (clip_id, frame, seq, cx, starts and all else of media): a key has a centre cx and starts a
    segment if it is hard, a cut starts one, and each clip has a mark at frame 0. Marks outside a clip are left out; each of
    the three tables is read once and joined by clip_id."""
    bare = lambda df, seq, cx, starts: df.select("clip_id", F.col("frame").cast("long").alias("frame"), seq.cast("long").alias("seq"), cx.cast("double").alias("cx"), starts.alias("starts"))
    null = F.lit(None)
    begin = media.withColumn("frame", F.lit(0))
    each = bare(keys, F.col("seq"), F.col("cx"), F.col("hard")).union(bare(cuts, null, null, F.lit(True))).union(bare(begin, null, null, F.lit(False)))
    return each.join(media, "clip_id").where("frame >= 0 and frame < total_frames")


def pieces(marks: DataFrame, middle: Column, sums: tuple[str, ...] = (), together: bool = False) -> DataFrame:
    """Spans of frames [begin, end) of the marks' clips, with seg (counted from 0 in each clip), starts, and the key before
    and after (at, x, next_at, next_x): between both a centre is eased, without the latter it is x. All else that the
    marks say goes along: the sums over a frame's marks, or what one of them has.

    In a segment the first key's centre holds before it and the last one's after it; a segment without keys goes on with
    the key before it, or the middle. Of keys of one frame the last (by seq) counts. Frame 0 starts no segment. together
    says that Spark knows the marks to be dealt out by clip_id, as those of a bucketed table.
    """
    rest = [c for c in marks.columns if c not in ("clip_id", "frame", "seq", "cx", "starts")]
    # One shuffle by clip, if any, serves the groups and the windows.
    by_frame = (marks if together else marks.repartition("clip_id")).groupBy("clip_id", "frame").agg(F.max_by("cx", F.when(F.col("cx").isNotNull(), F.col("seq"))).alias("cx"), F.max(F.col("starts") & (F.col("frame") > 0)).alias("starts"), *[(F.sum if c in sums else F.first)(c).alias(c) for c in rest])
    by = Window.partitionBy("clip_id").orderBy("frame")
    before = by.rowsBetween(Window.unboundedPreceding, 0)
    x = by_frame.withColumn("seg", F.sum(F.col("starts").cast("long")).over(before))
    x = x.withColumn("key", F.when(F.col("cx").isNotNull(), F.struct("frame", "cx", "seg")))
    following = F.expr("lead(key, 1) IGNORE NULLS OVER (PARTITION BY clip_id ORDER BY frame)")
    x = x.withColumns({"p": F.last("key", ignorenulls=True).over(before), "n": following, "end": F.coalesce(F.lead("frame").over(by), F.col("total_frames"))})
    has_p, has_n = F.col("p.seg").eqNullSafe(F.col("seg")), F.col("n.seg").eqNullSafe(F.col("seg"))
    both = has_p & has_n
    return x.select("clip_id", "seg", F.col("frame").alias("begin"), "end", "starts", F.when(both, F.col("p.frame")).alias("at"), F.when(has_n & ~has_p, F.col("n.cx")).otherwise(F.coalesce(F.col("p.cx"), middle)).alias("x"), F.when(both, F.col("n.frame")).alias("next_at"), F.when(both, F.col("n.cx")).alias("next_x"), *rest)


def interpolated(pieces: DataFrame) -> DataFrame:
    """cx and is_cut of every frame of the pieces."""
    t = (F.col("frame") - F.col("at")) / (F.col("next_at") - F.col("at"))
    eased = F.col("x") + (F.col("next_x") - F.col("x")) * (t * t * (3 - 2 * t))
    each = pieces.withColumn("frame", F.explode(F.sequence(F.col("begin"), F.col("end") - 1)))
    return each.select("clip_id", "frame", F.coalesce(eased, F.col("x")).alias("cx"), (F.col("starts") & (F.col("frame") == F.col("begin"))).alias("is_cut"))


class Smoother:
    """The crop's centre, frame after frame: a dead zone, a share of what goes beyond it, and a limit of speed; a cut jumps."""

    def __init__(self, width: float, fps: float, conf: Config = DEFAULT, centre: float | None = None):
        self.dead, self.most = max(conf.crop_deadzone * width, conf.crop_min_deadzone_px), max(1.0, conf.crop_max_speed / max(fps, 1.0))
        self.alpha = 1 - math.exp(-1 / max(fps * conf.crop_smoothing_tau, 1.0))
        self.centre = centre

    def cut_to(self, x: float) -> bool:
        """Whether the crop visibly jumps."""
        jump = self.centre is not None and abs(x - self.centre) > self.dead
        self.centre = x
        return jump

    def follow(self, targets: Iterable[float]) -> list[float]:
        c, dead, most, alpha, out = self.centre, self.dead, self.most, self.alpha, []
        for x in targets:
            if c is None:
                c = x
            away = x - c
            if abs(away) > dead:
                c += min(max((x - math.copysign(dead, away) - c) * alpha, -most), most)
            out.append(c)
        self.centre = c
        return out


def smooth(targets: Iterable[float], cuts: Iterable[bool], width: float, fps: float, conf: Config = DEFAULT) -> tuple[list[float], list[bool]]:
    """The centres of a whole path, and where a cut made them jump."""
    s, out, jumps = Smoother(width, fps, conf), [], []
    for x, cut in zip(targets, cuts, strict=True):
        jumps.append(s.cut_to(x) if cut else False)
        out += s.follow([x])
    return out, jumps


def eased(begin: int, end: int, at: int | None, x: float, next_at: int | None, next_x: float | None) -> np.ndarray:
    """The targets of the frames of a piece, or of a part of one."""
    if next_at is None:
        return np.full(end - begin, float(x))
    t = (np.arange(begin, end) - at) / (next_at - at)
    return x + (next_x - x) * (t * t * (3 - 2 * t))


def smoothed(pieces: DataFrame, conf: Config = DEFAULT, jumps: bool = True, keep: tuple[str, ...] = (), deal: bool = True) -> DataFrame:
    """clip_id, frame, cx and jump of every frame of pieces that have src_h and fps too, with the columns to keep.

    Each segment is dealt out and folded on its own. Whether its first frame is a jump depends on where the crop stood
    before: for that the segment before is folded ahead of it, unless jumps are not asked for (all are false then).
    Without deal a clip's segments stay together, which saves a shuffle where there are many clips to a task.
    """
    columns = ["clip_id", "seg", "part", "begin", "end", "starts", "at", "x", "next_at", "next_x", "src_h", "fps"]
    own = pieces.withColumn("part", F.lit(1))
    if jumps:
        own = own.withColumn("followed", F.col("seg") < F.max("seg").over(Window.partitionBy("clip_id")))
        own = own.withColumn("part", F.explode(F.when(F.col("followed"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1))))).withColumn("seg", F.col("seg") + 1 - F.col("part"))
    own = own.select(*dict.fromkeys([*columns, *keep]))
    dealt = (own.repartition("clip_id", "seg") if deal else own).sortWithinPartitions("clip_id", "seg", "part", "begin")
    kinds = dict(pieces.dtypes)
    schema = "clip_id bigint, frame bigint, cx double, jump boolean" + "".join(f", {c} {kinds[c]}" for c in keep)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, s, made = None, None, []
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in columns], strict=True)
            of_row: list[int] = []
            for k, (clip, seg, part, begin, end, starts, at, x, next_at, next_x, src_h, fps) in enumerate(rows):
                if (clip, seg) != segment:
                    segment, s = (clip, seg), Smoother(int(src_h * 9 / 16), fps, conf)
                for a in range(begin, end, CHUNK):
                    b = min(a + CHUNK, end)
                    targets = eased(a, b, at, x, next_at, next_x).tolist()
                    jump = starts and a == begin and part == 1 and s.cut_to(targets[0])
                    cx = s.follow(targets)
                    if part == 1:
                        flags = np.zeros(b - a, bool)
                        flags[0] = jump
                        made.append((np.full(b - a, clip), np.arange(a, b), np.array(cx), flags))
                        of_row += [k] * (b - a)
                        if len(of_row) >= CHUNK:
                            yield batch_of(made, batch, of_row)
                            made, of_row = [], []
            if made:
                yield batch_of(made, batch, of_row)
                made = []

    def batch_of(made: list, batch: pa.RecordBatch, of_row: list[int]) -> pa.RecordBatch:
        columns = [pa.array(np.concatenate([m[k] for m in made])) for k in range(4)]
        return pa.RecordBatch.from_arrays([*columns, *[batch.column(c).take(pa.array(of_row)) for c in keep]], ["clip_id", "frame", "cx", "jump", *keep])

    return dealt.mapInArrow(of, schema)


def held(path: DataFrame, src_w: Column, src_h: Column) -> DataFrame:
    """The path within what the crop's width allows."""
    half = crop_width(src_h) / 2
    return path.withColumn("cx", clamp(F.col("cx"), half, src_w - half))


def crop_windows(path: DataFrame, src_w: Column, src_h: Column) -> DataFrame:
    """The columns each frame keeps: x and width."""
    width = crop_width(src_h)
    return path.select("clip_id", "frame", crop_left(F.col("cx"), width, src_w).cast("int").alias("x"), width.alias("width"))


def padded(path: DataFrame, decoded: Column) -> DataFrame:
    """The path (with total_frames) for as many frames as are decoded: past its end the last centre holds."""
    upto = F.when(F.col("frame") == F.col("total_frames") - 1, F.greatest(F.col("frame"), decoded.cast("long") - 1)).otherwise(F.col("frame"))
    return path.where(F.col("frame") < decoded).withColumn("frame", F.explode(F.sequence("frame", upto)))
