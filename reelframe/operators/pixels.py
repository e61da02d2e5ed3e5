"""Scene cuts from pixels: thumbnails and histograms of frames, differences of neighbours, then the rules of cuts.

A frame is worked on where it lies, and only its thumbnail in grey and its histogram (14 and 2 KB) are shuffled, by pieces of clips. A
fold over each piece in order gives differences; a window over the clip's numbers then brings together what the last frame of one
piece and the first of the next one kept. So neither a task's work nor its memory depends on a clip's length, but for numbers.
Kernels are NumPy over a few frames at a time, and rows go to Python by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, pairwise
from math import gcd

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelframe.batches import in_small_batches, slices
from reelframe.config import DEFAULT, Config
from reelframe.operators import cuts

# The thumbnail's size, the bins of hue and saturation and their ranges, and the weights of grey (of 2^14).
THUMB_W, THUMB_H = 160, 90
BINS, HUES, LEVELS = 32, 180, 256
GREY = (1868, 9617, 4899)
#: Frames that go through Python together, and bytes of those of one size that kernels take at a time.
ROWS, AREA = 64, 1 << 18
#: Numbers of frames that a piece of a clip spans.
PIECE = 256
FEATURES = "clip_id bigint, frame bigint, grey binary, hist binary"
#: Each frame's place in its piece; its differences to the one before it, but for the first; features of the first and the last.
IN_PIECES = "clip_id bigint, frame bigint, place bigint, hist_diff double, pixel_diff double, grey binary, hist binary"


@lru_cache(maxsize=64)
def area_weights(size: int, to: int) -> np.ndarray:
    """(b, a): the shares, as whole numbers that add up to a, that each of a cells has in each of b cells over the same length;
    a to b is size to to in lowest terms, and the pattern repeats from there on."""
    a, b = size // gcd(size, to), to // gcd(size, to)
    edges, cells = np.arange(b + 1) * a, np.arange(a) * b
    over = np.minimum(edges[1:, None], cells + b) - np.maximum(edges[:-1, None], cells)
    return np.clip(over, 0, None)


def thumbnails(frames: np.ndarray) -> np.ndarray:
    """Frames (n, height, width, blue green red) at the thumbnail's size, (n, 3, THUMB_H, THUMB_W): each pixel the mean of the
    area it covers, halves to even. Sums are of whole numbers, so they are exact in whatever order they are made."""
    n, h, w, _ = frames.shape
    down, across = area_weights(h, THUMB_H), area_weights(w, THUMB_W)
    (_, a), (_, c) = down.shape, across.shape
    # Sums up to 255 * a * c, and what two means that differ are apart at least, must fit the kind.
    kind = np.float32 if a * c < 1 << 14 else np.float64
    rows = down.astype(kind) @ frames.reshape(n, h // a, a, w * 3).astype(kind)
    channels = np.moveaxis(rows.reshape(n, THUMB_H, w, 3), 3, 1).reshape(-1, c)
    sums = channels @ across.T.astype(kind)
    return np.rint(sums / kind(a * c)).astype(np.uint8).reshape(n, 3, THUMB_H, THUMB_W)


def thumbnail(frame: np.ndarray) -> np.ndarray:
    """One frame (height, width, blue green red) at the thumbnail's size."""
    return np.moveaxis(thumbnails(frame[None])[0], 0, 2)


def _grey(b: np.ndarray, g: np.ndarray, r: np.ndarray) -> np.ndarray:
    b, g, r = (x.astype(np.uint32) * k for x, k in zip((b, g, r), GREY, strict=True))
    return ((b + g + r + (1 << 13)) >> 14).astype(np.uint8)


def grey(small: np.ndarray) -> np.ndarray:
    return _grey(*np.moveaxis(small, -1, 0))


@lru_cache(maxsize=1)
def _colours() -> tuple[np.ndarray, np.ndarray]:
    """All hues and saturations there are, as _places finds them: hue by which channel is the highest (red, green, blue), the
    difference of the other two and the span from the lowest; saturation by the highest and the span."""
    span, high, apart = np.arange(256), np.arange(256)[:, None], np.arange(-255, 256)[:, None]
    turn = apart / np.where(span > 0, span, 1)
    hue = np.rint(30 * np.where(span > 0, np.stack([turn, 2 + turn, 4 + turn]), 0)).astype(np.int32) % HUES
    return hue.ravel(), np.rint(255 * span / np.where(high > 0, high, 1)).astype(np.int32).ravel()


@lru_cache(maxsize=1)
def _bins() -> tuple[np.ndarray, np.ndarray]:
    hue, saturation = _colours()
    return hue * BINS // HUES * BINS, saturation * BINS // LEVELS


def _places(b: np.ndarray, g: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in the tables of _colours pixels stand."""
    high = np.maximum(np.maximum(b, g), r)
    span = high - np.minimum(np.minimum(b, g), r)
    blue, green, red = (x.astype(np.int32) for x in (b, g, r))
    apart = np.where(high == r, green - blue, np.where(high == g, blue - red + 511, red - green + 2 * 511))
    return (apart + 255 << 8) + span, (high.astype(np.int32) << 8) + span


def hue_saturation(small: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hue in 0 .. 179 (two degrees each) and saturation in 0 .. 255, rounded; both 0 where there is no colour."""
    hue, saturation = (table.take(at) for table, at in zip(_colours(), _places(*np.moveaxis(small, -1, 0)), strict=True))
    return hue, saturation


def _histograms(b: np.ndarray, g: np.ndarray, r: np.ndarray) -> np.ndarray:
    """(n, BINS * BINS) of channels (n, pixels)."""
    hue, saturation = (table.take(at) for table, at in zip(_bins(), _places(b, g, r), strict=True))
    n, each = len(b), BINS * BINS
    at = hue + saturation + (np.arange(n, dtype=np.int32) * each)[:, None]
    return np.bincount(at.ravel(), minlength=n * each).reshape(n, each)


def histogram(small: np.ndarray) -> np.ndarray:
    """Pixels in each of BINS by BINS bins of hue and saturation."""
    return _histograms(*np.moveaxis(small, -1, 0).reshape(3, 1, -1))[0]


def alike(sizes: list[tuple[int, int] | None]) -> Iterator[tuple[int, int, int, int]]:
    """(begin, end, height, width) of stretches of one size, of at most AREA bytes or one frame; none of frames without a size."""
    for size, run in groupby(range(len(sizes)), sizes.__getitem__):
        if size:
            some, step = list(run), max(1, AREA // (size[0] * size[1] * 3))
            yield from ((some[k], min(some[k] + step, some[-1] + 1), *size) for k in range(0, len(some), step))


def features(frames: DataFrame) -> DataFrame:
    """FEATURES of frames (clip_id, frame, height, width, pixels): rows of pixels, three bytes each, blue, green, red. A
    frame whose bytes don't match its size, or are null, has null features and is no neighbour of any."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            heights, widths, pixels = (batch.column(c).to_pylist() for c in ("height", "width", "pixels"))
            sizes = [(h, w) if px and h and w and h > 0 and w > 0 and len(px) == h * w * 3 else None for h, w, px in zip(heights, widths, pixels, strict=True)]
            greys, hists = [None] * len(batch), [None] * len(batch)
            for begin, end, h, w in alike(sizes):
                small = thumbnails(np.frombuffer(b"".join(pixels[begin:end]), np.uint8).reshape(-1, h, w, 3))
                channels = [small[:, k].reshape(end - begin, -1) for k in range(3)]
                greys[begin:end] = [x.tobytes() for x in _grey(*channels)]
                hists[begin:end] = [x.tobytes() for x in _histograms(*channels).astype("<u2")]
            yield pa.RecordBatch.from_arrays([batch.column("clip_id"), batch.column("frame"), pa.array(greys, pa.binary()), pa.array(hists, pa.binary())], ["clip_id", "frame", "grey", "hist"])

    in_small_batches(frames.sparkSession)
    return frames.select(F.col("clip_id").cast("long"), F.col("frame").cast("long"), "height", "width", "pixels").mapInArrow(of, FEATURES)


def _stacked(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bhattacharyya distance of each two histograms."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    both = np.sqrt(a * b).sum(1) / np.sqrt(a.sum(1) * b.sum(1))
    return np.sqrt(np.maximum(0, 1 - both))


def mean_differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean difference of each two rows of grey values, of 1."""
    return (np.maximum(a, b) - np.minimum(a, b)).sum(1, dtype=np.int64) / a.shape[1] / 255


def _in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """IN_PIECES of rows (clip_id, piece, frame, grey, hist) in order."""

    def some(rows: pa.RecordBatch, found: list[tuple], last: list[bool]) -> pa.RecordBatch:
        place, hist, pixel = zip(*found, strict=True)
        edges = [pa.array([x.as_py() if k == 0 or end else None for x, k, end in zip(rows.column(c), place, last, strict=True)], pa.binary()) for c in ("grey", "hist")]
        return pa.RecordBatch.from_arrays([rows.column("clip_id"), rows.column("frame"), pa.array(place, pa.int64()), pa.array(hist, pa.float64()), pa.array(pixel, pa.float64()), *edges], ["clip_id", "frame", "place", "hist_diff", "pixel_diff", "grey", "hist"])

    # A batch's last row is held back until it is known whether its piece goes on.
    held, found = None, [(0, None, None)]
    for batch in slices(batches, ROWS):
        rows = batch if held is None else pa.concat_batches([held, batch])
        keys = list(zip(rows.column("clip_id").to_pylist(), rows.column("piece").to_pylist(), strict=True))
        on = [a == b for a, b in pairwise(keys)]
        grey, hist = _stacked(rows.column("grey"), "u1"), _stacked(rows.column("hist"), "<u2")
        for goes_on, *apart in zip(on, distances(hist[:-1], hist[1:]), mean_differences(grey[:-1], grey[1:]), strict=True):
            found.append((found[-1][0] + 1, *apart) if goes_on else (0, None, None))
        if on:
            yield some(rows.slice(0, len(on)), found[:-1], [not goes_on for goes_on in on])
        held, found = rows.slice(len(on)), found[-1:]
    if held is not None:
        yield some(held, found, [True])


def _across(grey0: pa.Array, hist0: pa.Array, grey: pa.Array, hist: pa.Array) -> pa.Array:
    """hist_diff and pixel_diff of two frames; null where one of them is."""
    met = pc.and_(grey0.is_valid(), grey.is_valid())
    found = np.zeros((2, len(met)))
    at = np.flatnonzero(met.to_numpy(zero_copy_only=False))
    for k in range(0, len(at), ROWS):
        g0, h0, g, h = (c.take(pa.array(at[k : k + ROWS])) for c in (grey0, hist0, grey, hist))
        found[:, at[k : k + ROWS]] = distances(_stacked(h0, "<u2"), _stacked(h, "<u2")), mean_differences(_stacked(g0, "u1"), _stacked(g, "u1"))
    return pa.StructArray.from_arrays(list(map(pa.array, found)), ["hist_diff", "pixel_diff"], mask=pc.invert(met))


def differences(features: DataFrame) -> DataFrame:
    """hist_diff and pixel_diff of each frame to the one before it; equal frames of a clip count by their features' order."""
    pieces = features.where("grey is not null").withColumn("piece", F.expr(f"frame div {PIECE}")).repartition("clip_id", "piece")
    in_small_batches(features.sparkSession)
    each = pieces.sortWithinPartitions("clip_id", "piece", "frame", "grey", "hist").select("clip_id", "piece", "frame", "grey", "hist").mapInArrow(_in_pieces, IN_PIECES)
    by, first = Window.partitionBy("clip_id").orderBy("frame", "place"), F.col("place") == 0
    met = each.withColumns({"grey0": F.when(first, F.lag("grey").over(by)), "hist0": F.when(first, F.lag("hist").over(by))}).where("place > 0 or grey0 is not null")
    met = met.withColumn("across", F.arrow_udf(_across, "hist_diff double, pixel_diff double")("grey0", "hist0", F.when(first, F.col("grey")), F.when(first, F.col("hist"))))
    return met.select("clip_id", "frame", *(F.coalesce(c, f"across.{c}").alias(c) for c in ("hist_diff", "pixel_diff")))


def scene_cuts(frames: DataFrame, media: DataFrame, conf: Config = DEFAULT) -> DataFrame:
    """(clip_id, frame) of the accepted cuts of frames, by the rates of media (clip_id, fps)."""
    return cuts.accepted(differences(features(frames)), media, conf)
