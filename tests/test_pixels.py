"""Pixels against plain loops."""

import colorsys
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelframe import batches
from reelframe.operators import pixels
from reelframe.plans import catalog, inputs
from tests.conftest import SMALL


def plain_thumbnail(frame, to_w=pixels.THUMB_W, to_h=pixels.THUMB_H):
    """Means over areas, cell by cell."""
    h, w, _ = frame.shape
    out = np.zeros((to_h, to_w, 3), int)
    for y in range(to_h):
        for x in range(to_w):
            top, low, left, right = y * h / to_h, (y + 1) * h / to_h, x * w / to_w, (x + 1) * w / to_w
            total = np.zeros(3)
            for j in range(int(top), min(h, int(np.ceil(low)))):
                for i in range(int(left), min(w, int(np.ceil(right)))):
                    total += frame[j, i] * (min(low, j + 1) - max(top, j)) * (min(right, i + 1) - max(left, i))
            out[y, x] = np.rint(np.round(total / ((low - top) * (right - left)), 6))
    return out


def plain_bins(small):
    """Pixels by hue and saturation, and grey values, one pixel at a time."""
    hist, greys = np.zeros((32, 32), int), []
    for b, g, r in small.reshape(-1, 3).tolist():
        h, s, _ = colorsys.rgb_to_hsv(r / 255, g / 255, b / 255)
        hist[int(np.rint(h * 180)) % 180 * 32 // 180, int(np.rint(s * 255)) * 32 // 256] += 1
        greys.append((b * 1868 + g * 9617 + r * 4899 + 8192) >> 14)
    return hist.ravel(), greys


@pytest.mark.parametrize("h, w", [(180, 320), (108, 192), (97, 161), (40, 50)])
def test_thumbnail(h, w):
    frame = np.random.default_rng(h).integers(0, 256, (h, w, 3)).astype(np.uint8)
    small = pixels.thumbnail(frame)
    assert (small == plain_thumbnail(frame)).mean() > 0.999 and np.abs(small.astype(int) - plain_thumbnail(frame)).max() <= 1
    assert pixels.grey(small).ravel().tolist() == plain_bins(small)[1]


@pytest.mark.parametrize("h, w", [(108, 192), (97, 161), (40, 50), (1080, 1920)])
def test_thumbnails_are_exact(h, w):
    """Frames taken together: sums of whole numbers over areas, divided once, halves to even."""
    frames = np.random.default_rng(w).integers(0, 256, (3, h, w, 3)).astype(np.uint8)
    frames[1] = frames[1] // 128 * 255
    down, across = (np.array([[max(0, min((j + 1) * size, (i + 1) * to) - max(j * size, i * to)) for i in range(size)] for j in range(to)]) for size, to in ((h, pixels.THUMB_H), (w, pixels.THUMB_W)))
    for frame, small in zip(frames, pixels.thumbnails(frames), strict=True):
        for k in range(3):
            whole, part = np.divmod(down @ frame[..., k].astype(int) @ across.T, h * w)
            assert (small[k] == whole + ((2 * part > h * w) | ((2 * part == h * w) & (whole % 2 == 1)))).all()


def test_histogram():
    small = np.random.default_rng(2).integers(0, 256, (90, 160, 3)).astype(np.uint8)
    small[:9] = small[:9, :, :1]
    hist, _ = plain_bins(small)
    # Rounding of halves may put a pixel into a bin next to its own.
    assert np.abs(pixels.histogram(small) - hist).sum() <= 20 and pixels.histogram(small).sum() == 90 * 160
    red = np.zeros((1, 1, 3), np.uint8)
    red[..., 2] = 255
    assert [int(x[0, 0]) for x in pixels.hue_saturation(red)] == [0, 255]


def test_cuts_equal_loops(spark):
    """All frames of three clips: differences, the predicate and the gap, by loops over plain thumbnails."""
    frames = inputs.pixels(spark, SMALL).where("clip_id < 3")
    rows = sorted((r.clip_id, r.frame, np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 3)) for r in frames.where("frame < 9").collect())
    gaps, found, diffs = {0: 9, 1: 7, 2: 18}, [], {}
    before: dict = {}
    last = {k: -gaps[k] for k in gaps}
    for clip, frame, px in sorted(rows, key=lambda r: r[:2]):
        hist, greys = plain_bins(plain_thumbnail(px))
        if clip in before:
            h0, g0 = before[clip]
            pixel = np.abs(np.array(greys) - np.array(g0)).mean() / 255
            both = (np.sqrt(h0 * hist)).sum() / np.sqrt(float(h0.sum()) * hist.sum())
            away = np.sqrt(max(0, 1 - both))
            diffs[clip, frame] = (away, pixel)
            score = 0.6 * away + 0.4 * pixel
            is_cut = (score >= 0.22 and away >= 0.14 and pixel >= 0.08) or (away >= 0.45 and score >= 0.22) or (pixel >= 0.22 and away >= 0.105)
            if is_cut and frame - last[clip] >= gaps[clip]:
                found.append((clip, frame))
                last[clip] = frame
        before[clip] = (hist, greys)
    some = frames.where("frame < 9")
    got = {(r.clip_id, r.frame): (r.hist_diff, r.pixel_diff) for r in pixels.differences(pixels.features(some)).collect()}
    assert got.keys() == diffs.keys() and all(abs(a - b) < 0.01 for k in got for a, b in zip(got[k], diffs[k]))
    media = spark.createDataFrame([(0, 0.0), (1, 25.0), (2, 60.0)], "clip_id bigint, fps double")
    assert sorted(map(tuple, pixels.scene_cuts(some, media).collect())) == found and len(found) > 2


def test_frames_that_cannot_be_read(spark):
    """Null, empty and short bytes have no features; their neighbours are those of the frames around them."""
    one = bytes([10, 20, 30]) * 12
    rows = [(1, 0, 3, 4, one), (1, 1, 3, 4, None), (1, 2, 3, 4, one[:-1]), (1, 3, None, 4, one), (1, 4, 3, 4, b""), (1, 5, 3, 4, one)]
    df = spark.createDataFrame(rows, "clip_id int, frame int, height int, width int, pixels binary")
    assert pixels.features(df).where("grey is null").count() == 4
    assert [tuple(r) for r in pixels.differences(pixels.features(df)).collect()] == [(1, 5, 0.0, 0.0)]
    assert pixels.differences(pixels.features(df.limit(0))).count() == 0


@pytest.mark.parametrize("piece", [1, 3, pixels.PIECE])
def test_pieces_of_clips(spark, monkeypatch, piece):
    """Dense, scattered, equal, negative and null frames, of null clips too: by a loop over each clip, whatever a piece spans."""
    monkeypatch.setattr(pixels, "PIECE", piece)
    gen = np.random.default_rng(6)
    numbers = {1: range(700), 2: [*gen.integers(-3000, 3000, 200).tolist(), None], 3: [5], 4: [-1, 0, 0, 0, 1, 10**15], None: [None, None, 2, 3, 255, 256, 257], 5: [3 * k for k in range(300)]}
    rows = [(clip, frame, gen.integers(0, 256, 6).astype("u1").tobytes(), gen.integers(1, 9, 4).astype("<u2").tobytes()) for clip, frames in numbers.items() for frame in frames]
    rows += [(1, 1000, None, None), (4, 7, None, None), rows[0], (6, 1, None, None)]
    want = []
    before = None
    for clip, frame, grey, hist in sorted((r for r in rows if r[2]), key=lambda r: (r[0] or -1, r[1] is not None, r[1] or 0, *r[2:])):
        now = (clip, np.frombuffer(grey, "u1").astype(float), np.frombuffer(hist, "<u2").astype(float))
        if before and before[0] == clip:
            g, h, g0, h0 = *now[1:], *before[1:]
            away = np.sqrt(max(0, 1 - np.sqrt(h * h0).sum() / np.sqrt(h.sum() * h0.sum())))
            want.append((clip, frame, round(float(away), 9), round(float(np.abs(g - g0).mean() / 255), 9)))
        before = now
    features = spark.createDataFrame([rows[k] for k in gen.permutation(len(rows))], pixels.FEATURES)
    got = [(r.clip_id, r.frame, round(r.hist_diff, 9), round(r.pixel_diff, 9)) for r in pixels.differences(features).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 1200


def test_a_clip_is_no_one_task(spark):
    """Features go by pieces; of a clip only numbers come together, and features of the first and last frame of each piece."""
    frames = spark.range(4000).selectExpr("1L clip_id", "id frame", "cast(repeat('a', 60) as binary) grey", "cast('abcdefgh' as binary) hist")
    found = pixels.differences(frames)
    assert found.count() == 3999 and found.where("hist_diff != 0 or pixel_diff != 0").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    (by_piece,) = [line for line in plan.splitlines() if "Exchange" in line and "piece#" in line]
    assert "piece#" in by_piece.split("hashpartitioning(")[1].split("),")[0]
    dealt = frames.withColumn("piece", F.expr(f"frame div {pixels.PIECE}")).coalesce(1).sortWithinPartitions("piece", "frame")
    kept = dealt.mapInArrow(pixels._in_pieces, pixels.IN_PIECES).where("grey is not null")
    assert {r.frame % pixels.PIECE for r in kept.collect()} == {0, pixels.PIECE - 1, 3999 % pixels.PIECE}


def test_sizes_may_differ(spark):
    """Frames of several sizes in turn, alike and not, have the features that each has on its own."""
    gen = np.random.default_rng(3)
    sizes = [(30, 40), (30, 40), (40, 30), (1, 1), (300, 400), (300, 400), (-3, -4), (30, 40)]
    frames = [gen.integers(0, 256, (abs(h), abs(w), 3)).astype(np.uint8) for h, w in sizes]
    rows = [(1, k, h, w, f.tobytes()) for k, ((h, w), f) in enumerate(zip(sizes, frames, strict=True))]
    df = spark.createDataFrame(rows, "clip_id int, frame int, height int, width int, pixels binary").coalesce(1)
    got = {r.frame: r for r in pixels.features(df).collect()}
    for k, (size, frame) in enumerate(zip(sizes, frames, strict=True)):
        small = pixels.thumbnail(frame)
        want = (None, None) if min(size) < 0 else (pixels.grey(small).tobytes(), pixels.histogram(small).astype("<u2").tobytes())
        assert (got[k].grey, got[k].hist) == want
    assert list(pixels.alike([(300, 400)] * 2 + [None, (30, 40), (30, 40)])) == [(0, 1, 300, 400), (1, 2, 300, 400), (3, 5, 30, 40)]


def test_frames_are_quick(spark):
    """Kernels take far less than a fiftieth of a second a frame, and all cores make frames of one file."""
    frames = np.random.default_rng(4).integers(0, 256, (50, 108, 192, 3)).astype(np.uint8)
    pixels.histogram(pixels.thumbnail(frames[0]))
    began = time.process_time()
    for frame in frames:
        pixels.histogram(pixels.thumbnail(frame))
    assert time.process_time() - began < 1
    made = inputs.pixels(spark, SMALL).groupBy(F.spark_partition_id()).count().collect()
    assert len(made) >= spark.sparkContext.defaultParallelism


def test_batches_are_bounded(spark):
    """Frames are made, reach Python and leave it a few at a time, however many rows Spark puts together."""
    many = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("embedding", "label").crossJoin(spark.range(2)).coalesce(1)
    n = many.count()

    def size(some):
        yield from (pa.RecordBatch.from_pydict({"rows": [len(b)], "bytes": [b.nbytes]}) for b in some)

    def wide(some):
        for b in some:
            px = np.zeros(108 * 192 * 3, np.uint8).tobytes()
            yield pa.RecordBatch.from_pydict({"clip_id": [1] * len(b), "frame": list(range(len(b))), "height": pa.array([108] * len(b), pa.int32()), "width": pa.array([192] * len(b), pa.int32()), "pixels": [px] * len(b)})

    frames = many.mapInArrow(wide, "clip_id bigint, frame bigint, height int, width int, pixels binary")
    pixels.features(frames)
    got = frames.mapInArrow(size, "rows bigint, bytes bigint").collect()
    assert sum(r.rows for r in got) == n and n * 62_208 > 16 << 20 and max(r.bytes for r in got) < 16 << 20
    sizes = [len(b) for b in batches.slices([pa.RecordBatch.from_pydict({"x": list(range(150))}), pa.RecordBatch.from_pydict({"x": [1]})], pixels.ROWS)]
    assert sizes == [64, 64, 22, 1]


def test_pixels_are_not_shuffled(spark):
    """Only features go through the exchange, and whole frames are read once."""
    plan = catalog.queries()["pixel_cuts"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    tree = plan.split("== Initial Plan ==")[-1]
    assert tree.count("MapInArrow") == 3
    for line in tree.splitlines():
        assert "Exchange" not in line or "pixels#" not in line


def test_query(spark):
    found = catalog.queries()["pixel_cuts"](spark, SMALL)
    assert 0 < found.count() < inputs.pixels(spark, SMALL).select(F.col("clip_id")).count()
