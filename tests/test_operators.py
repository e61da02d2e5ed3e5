"""Worked examples of the operators."""

import json

import numpy as np
from pyspark.sql import functions as F

from reelframe.config import Config
from reelframe.functions.scalars import smoothing_window
from reelframe.operators import captions, crop, cuts, logs, path
from reelframe.operators.focus import Face, Focus, Track, focus_step, speak
from reelframe.sources import manifest
from tests import plain


def test_captions_cross_segments(spark):
    words = spark.createDataFrame([(1, 0, 0, "a", 0.0, 0.1), (1, 0, 1, " b\t", 0.2, 0.2), (1, 1, 0, "c", 0.3, 0.4)], "clip_id bigint, seg_idx int, word_idx int, word string, start double, end double")
    found = captions.events(captions.numbered(words)).orderBy("rn").collect()
    assert [r.text for r in found] == [r"{\c&H0000FFFF}A{\c&H00FFFFFF} B", r"A {\c&H0000FFFF}B{\c&H00FFFFFF}", r"{\c&H0000FFFF}C{\c&H00FFFFFF}"]
    assert found[1].end == 0.2 + 0.01


def test_refractory(spark):
    found = cuts.refractory(spark.createDataFrame([(1, f) for f in (20, 5, 10, 14, 23)], "clip_id bigint, frame bigint"), 9)
    assert sorted(r.frame for r in found.collect()) == [5, 14, 23]


def test_exclusion_keeps_null_ids(spark):
    clips = spark.createDataFrame([(1,), (None,), (2,)], "clip_id bigint")
    assert sorted(manifest.included(clips, clips.where("clip_id = 1")).collect(), key=str) == [(2,), (None,)]


MEDIA = "clip_id bigint, src_w int, src_h int, fps double, total_frames bigint"


def test_interpolation(spark):
    keys = spark.createDataFrame([(1, 0, 2, 100.0, False), (1, 1, 6, 150.0, False), (1, 2, 6, 200.0, False), (2, 0, 3, 50.0, True), (1, 3, 99, 5.0, False)], "clip_id bigint, seq bigint, frame bigint, cx double, hard boolean")
    cut = spark.createDataFrame([(1, 8), (1, 0), (1, -3), (3, 1)], "clip_id bigint, frame bigint")
    media = spark.createDataFrame([(1, 1920, 1080, 30.0, 10), (2, 1920, 1080, 30.0, 5), (3, 1920, 1080, 30.0, 3)], MEDIA)
    pieces = path.pieces(path.marks(keys, cut, media), F.lit(960.0))
    found = [(r.clip_id, r.cx, r.is_cut) for r in path.interpolated(pieces).orderBy("clip_id", "frame").collect()]
    assert [x for c, x, _ in found if c == 1] == [100, 100, 100, 115.625, 150, 184.375, 200, 200, 200, 200]
    assert [(x, cut) for c, x, cut in found if c == 2] == [(960, False)] * 3 + [(50, True), (50, False)]
    assert [(x, cut) for c, x, cut in found if c == 3] == [(960, False), (960, True), (960, False)]


def test_smoothing():
    assert path.smooth([500, 530], [False, False], 607, 30)[0] == [500, 500]
    assert path.smooth([500, 900], [False, True], 607, 30) == ([500, 900], [False, True])
    assert path.smooth([500, 900], [False, False], 607, 30)[0] == [500, 516]


def test_speech_by_track():
    tracks: list[Track] = []
    mouth = lambda v: np.full((2, 2), v)
    assert speak(tracks, [Face(100, 1, 1, 40, mouth(1)), Face(500, 1, 1, 40, mouth(1))], 2) == [(0, 0.0), (1, 0.0)]
    assert speak(tracks, [Face(510, 1, 1, 40, mouth(5))], 2) == [(1, 2.0)]
    assert speak(tracks, [Face(540, 1, 1, 40, None)], 2) == [(2, 0.0)]


def test_a_missing_patch_keeps_the_last_one():
    tracks: list[Track] = []
    mouth = lambda v: None if v is None else np.full((2, 2), v)
    assert [speak(tracks, [Face(100, 1, 1, 40, mouth(v))], 1)[0][1] for v in (1.0, None, 9.0)] == [0.0, 0.0, 8.0]


def test_window_goes_by_the_rate_of_samples():
    assert smoothing_window(30.0) == 2 and smoothing_window(30.0, Config(face_sample_fps=15.0)) == 7


def test_radius_has_the_least_dead_zone():
    conf = Config(crop_min_deadzone_px=400.0)
    s = Focus()
    focus_step(s, 0, [Face(500, 100, 1)], [0.0], False, **STEP, conf=conf)
    assert focus_step(s, 7, [Face(850, 100, 1)], [0.0], False, **STEP, conf=conf).cx == 850


def test_cuts_outside_a_clip_reset_nothing(spark):
    samples = spark.createDataFrame([(1, 0, 0), (1, 1, 7), (1, 2, 14)], "clip_id bigint, sample_idx bigint, frame bigint")
    cut = spark.createDataFrame([(1, 0), (1, 7), (1, 12)], "clip_id bigint, frame bigint")
    media = spark.createDataFrame([(1, 12)], "clip_id bigint, total_frames bigint")
    assert [r.reset for r in cuts.with_reset(samples, cut).orderBy("frame").collect()] == [False, True, True]
    assert [r.reset for r in cuts.with_reset(samples, cut, media).orderBy("frame").collect()] == [False, True, False]


def face(sample, frame, cx, area=100.0, idx=0):
    return {"sample_idx": sample, "frame": frame, "face_idx": idx, "cx": cx, "area": area, "conf": 1.0, "width": 40.0, "mouth": None}


def test_crop_of_a_clip():
    made = plain.crop_clip([face(0, 0, 300.0), face(1, 7, 310.0), face(2, 14, 900.0)], [10, 99], 1280, 720, 25.0, 20)
    assert [(k["frame"], k["cx"], k["reset"]) for k in made["keys"]] == [(0, 300.0, False), (7, 310.0, False), (14, 900.0, True)]
    at = [p["cx"] for p in made["path"]]
    # The picture's width is 1280, the crop's 405: a dead zone of 36 pixels hides the step of ten, the cut jumps.
    assert at[:10] == [300.0] * 10 and at[10:] == [900.0] * 10 and [p["frame"] for p in made["path"] if p["jump"]] == [10]


FACES = "clip_id bigint, sample_idx bigint, frame bigint, face_idx bigint, cx double, area double, conf double, width double, mouth array<double>"
CUTS = "clip_id bigint, frame bigint"


def test_pass_over_clips(spark):
    """Clips with one face, without faces, with an empty sample, without frames, and faces without a clip."""
    faces = spark.createDataFrame([(1, 0, 0, 0, 300.0, 100.0, 1.0, 40.0, None), (3, 0, 0, None, None, None, None, None, None), (4, 0, 0, 0, 1.0, 1.0, 1.0, None, [1.0]), (9, 0, 0, 0, 1.0, 1.0, 1.0, 1.0, None)], FACES)
    media = spark.createDataFrame([(1, 1920, 1080, 0.0, 3), (2, 1920, 1080, 30.0, 2), (3, 1920, 1080, 30.0, 3), (4, 1920, 1080, 30.0, 0)], MEDIA)
    samples = crop.samples(crop.timeline(faces, spark.createDataFrame([], CUTS), media)).cache()
    made = crop.paths(samples)
    assert sorted((r.clip_id, r.frame, r.cx) for r in made.collect()) == [(1, k, 303.5) for k in range(3)] + [(2, k, 960.0) for k in range(2)] + [(3, k, 960.0) for k in range(3)]
    assert sorted(tuple(r) for r in crop.keys(samples).select("clip_id", "seq", "frame", "cx").collect()) == [(1, 0, 0, 303.5), (2, 0, 0, 960.0), (3, 0, 0, 960.0)]
    assert sorted((r.clip_id, r.track) for r in crop.spoken(samples).collect()) == [(1, 0), (4, 0)]
    padded = path.crop_windows(path.padded(made, F.when(F.col("clip_id") == 1, 5).otherwise(1)), F.col("src_w"), F.col("src_h"))
    assert sorted(map(tuple, padded.collect())) == [(1, k, 0, 607) for k in range(5)] + [(2, 0, 656, 607), (3, 0, 656, 607)]


def clip_of(samples, seed=4, every=7):
    rng = np.random.default_rng(seed)
    faces = [(1, k, k * every, j, float(rng.integers(0, 1920)), float(rng.integers(1, 40000)), float(rng.random()), 120.0, [float(rng.integers(0, 9))] * 4 if rng.random() < 0.9 else None) for k in range(samples) for j in range(int(rng.integers(1, 4)))]
    cuts = [(1, int(x)) for x in rng.integers(-20, samples * every + 50, samples // 15)]
    return faces, cuts, samples * every + 3


def test_long_clip(spark):
    """A clip of 17,503 frames: keys, speech, path, jumps and counts as a plain pass has them, its segments in many tasks."""
    faces, cut, total = clip_of(2500)
    names = [c.split()[0] for c in FACES.split(", ")]
    made = plain.crop_clip([dict(zip(names, f, strict=True)) for f in faces], [c for _, c in cut], 1280, 720, 25.0, total)
    media = spark.createDataFrame([(1, 1280, 720, 25.0, total)], MEDIA)
    samples = crop.samples(crop.timeline(spark.createDataFrame(faces, FACES).repartition(5), spark.createDataFrame(cut, CUTS), media)).cache()
    assert sorted(tuple(r)[1:] for r in crop.spoken(samples).collect()) == sorted((s["sample_idx"], s["face_idx"], s["track"], s["speaking"]) for s in made["spoken"])
    assert [tuple(r)[1:] for r in crop.keys(samples).orderBy("seq").collect()] == [tuple(k.values()) for k in made["keys"]]
    found = path.smoothed(crop.pieces_of(samples), keep=("src_w", "src_h"))
    rows = path.held(found, F.col("src_w"), F.col("src_h")).orderBy("frame").collect()
    assert [(r.frame, r.cx, r.jump) for r in rows] == [(p["frame"], p["cx"], p["jump"]) for p in made["path"]]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found.select(F.spark_partition_id()).distinct().count() == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    many = lambda field, of: sum(x[field] for x in made[of])
    assert tuple(crop.stats(samples).first()) == (1, len(made["keys"]), many("reset", "keys"), many("change", "keys"), many("jump", "path"), len(cut))


def test_pieces_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(path, "CHUNK", 5)
    faces = spark.createDataFrame([(1, 0, 0, 0, 300.0, 100.0, 1.0, 40.0, None), (1, 1, 90, 0, 900.0, 100.0, 1.0, 40.0, None)], FACES)
    media = spark.createDataFrame([(1, 1920, 1080, 30.0, 100)], MEDIA)
    made = plain.crop_clip([{**face(0, 0, 300.0)}, face(1, 90, 900.0)], [40], 1920, 1080, 30.0, 100)
    found = crop.paths(crop.samples(crop.timeline(faces, spark.createDataFrame([(1, 40)], CUTS), media)))
    assert [r.cx for r in found.orderBy("frame").collect()] == [p["cx"] for p in made["path"]]


def test_each_fold_runs_once(spark):
    """One reading of events, one fold of samples and one of segments in each query."""
    from reelframe.plans import catalog
    from tests.conftest import SMALL

    for name, folds in [("track_assign", 1), ("speaking_scores", 1), ("focus_keyframes", 1), ("crop_path", 2), ("clip_pipeline", 2), ("crop_stats", 2), ("smooth_path", 1), ("hard_jumps", 1)]:
        plan = catalog.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        tree = plan.split("== Initial Plan ==")[-1]
        assert (tree.count("MapInArrow") + tree.count("ArrowEvalPython"), tree.count("FileScan")) == (folds, 1), (name, plan)


def test_hidden_lines(spark):
    lines = spark.range(5).select("id")
    assert [tuple(logs.hidden(lines, n).first()) for n in (3, 9)] == [(2, "... 2 baris sebelumnya disembunyikan dari live view ..."), (0, None)]


def test_card_of_a_log(spark):
    lines = spark.createDataFrame([(0, 0, "a"), (1, 0, ""), (1, 1, "<b>")], "seq bigint, part int, line string")
    card = lambda df, n: [tuple(r) for r in logs.card(df, n).orderBy("place").collect()]
    assert card(lines, 2) == [(0, "&lt;b&gt;"), (1, "&nbsp;"), (2, logs.NOTE % 1)] and len(card(lines, 3)) == 3
    assert card(lines.limit(0), 3) == [(0, logs.NOTHING)]


def test_manifests_from_files(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"video_title": "é", "own": {"a": [1, null]}, "clips": [{"clip_id": 1, "mine": null}, {"clip_id": null, "b": 2.50}, {"start_time": "0:01"}]}')
    (tmp_path / "a.MP4").write_bytes(b"x")
    (tmp_path / "b.txt").write_text("x")
    raw = manifest.read_manifests(spark, f"file://{tmp_path}/*.json")
    assert raw.select(manifest.validated(F.col("raw")).alias("s")).first().s == "ok"
    assert [(r.pos, r.clip_id) for r in manifest.clips_of(raw).orderBy("pos").collect()] == [(0, 1), (1, None), (2, None)]
    text = raw.select(manifest.rendered(F.col("raw"), F.array(F.lit(1))).alias("t")).first().t
    assert text.startswith('{\n  "video_title": "é",\n  "own": {') and '"b": 2.5' in text and '"mine"' not in text and '"start_time": "0:01"' in text
    assert spark.createDataFrame([("[]",), (None,), ('{"clips": 1}',)], "r string").select(manifest.rendered(F.col("r"), F.array(F.lit(1))).alias("t")).distinct().collect() == [(None,)]
    odd = ['{"clips": [{"clip_id": [1]}, {"clip_id": 1}, {"clip_id": {"a": 2}}]}', '{"clips": ' + "[" * 200_000, '{"clips": [], "x": "\\\\ud800"}'.replace("\\\\", "\\")]
    found = [r.t for r in spark.createDataFrame([(k, x) for k, x in enumerate(odd)], "k int, r string").orderBy("k").select(manifest.rendered(F.col("r"), F.array(F.lit(1))).alias("t")).collect()]
    assert json.loads(found[0])["clips"] == [{"clip_id": [1]}, {"clip_id": {"a": 2}}] and found[1] is None and json.loads(found[2])["x"] == "?"
    assert [r.path.rsplit("/", 1)[1] for r in manifest.video_files(spark, f"file://{tmp_path}").collect()] == ["a.MP4"]


def test_subtitle_files(spark, tmp_path):
    """One file a clip; writing again gives the same, replaces files of its clips, and without overwrite keeps others."""
    kinds = "clip_id bigint, seg_idx int, word_idx int, word string, start double, end double"
    rows = [(k, 0, j, f"w{j}", j * 1.0, j + 0.5) for k in range(9) for j in range(12)]
    events = captions.events(captions.numbered(spark.createDataFrame(rows, kinds)))
    for _ in range(2):
        captions.write_subtitles(events, f"file://{tmp_path}/out")
        assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"clip_{k}.ass" for k in range(9)]
    text = (tmp_path / "out/clip_3.ass").read_text()
    want = [r.line for r in captions.lines(events).where("clip_id = 3").orderBy("ord").collect()]
    assert text == "\n".join([captions.HEADER, *want]) + "\n" and text.count("Dialogue:") == 12
    one = captions.events(captions.numbered(spark.createDataFrame([(3, 0, 0, "new", 0.0, 0.1), (40, 0, 0, "x", 0.0, 0.1), (None, 0, 0, "y", 0.0, 0.1)], kinds)))
    captions.write_subtitles(one, f"file://{tmp_path}/out", overwrite=False)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(f"clip_{k}.ass" for k in [*range(9), 40]) and "NEW" in (tmp_path / "out/clip_3.ass").read_text()
    captions.write_subtitles(one, f"file://{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["clip_3.ass", "clip_40.ass"]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    """Clips that are done when another fails don't appear, and what was there stays."""
    import pytest

    from reelframe.sources.subtitles import registered

    lines = spark.createDataFrame([(k, j, f"line {j}") for k in range(6) for j in range(3)], "clip_id bigint, ord bigint, line string")
    target = tmp_path / "out"
    write = lambda df, mode: df.write.format(registered(spark)).mode(mode).save(f"file://{target}")
    write(lines.where("clip_id = 1").coalesce(1).sortWithinPartitions("clip_id", "ord"), "append")
    before = {p.name: p.read_text() for p in target.iterdir()}
    bad = lines.withColumn("line", F.when((F.col("clip_id") == 5) & (F.col("ord") == 2), F.raise_error(F.lit("broken"))).otherwise(F.col("line")))
    for df in (bad.repartition(3, "clip_id").sortWithinPartitions("clip_id", "ord"), lines.repartition(2, "ord").sortWithinPartitions("line", "clip_id"), lines.coalesce(1).sortWithinPartitions("clip_id", F.desc("ord"))):
        for mode in ("append", "overwrite"):
            with pytest.raises(Exception, match="broken|not together|out of order"):
                write(df, mode)
            assert {p.name: p.read_text() for p in target.iterdir()} == before


def test_listing_in_ranges(spark):
    """Places over several partitions, with nulls and equal paths; ids make the order whole."""
    names = spark.createDataFrame([(None if k == 7 else f"n{k * 37 % 50}", k) for k in range(60)], "path string, id int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = manifest.numbered(names, ["path", "id"], "place")
        rows = found.orderBy("place").collect()
        assert found.rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(r.path, r.id) for r in rows] == sorted(((r.path, r.id) for r in rows), key=lambda r: (r[0] or "", r[1])) and [r.place for r in rows] == list(range(1, 61))
    assert manifest.numbered(names.limit(0), ["path", "id"], "place").count() == 0


STEP = {"src_w": 1920, "src_h": 1080, "fps": 30.0}


def test_focus_branches():
    s = Focus()
    assert focus_step(s, 0, [], [], False, **STEP).cx == 960.0  # nothing yet, no face
    s = Focus()
    a, b = Face(500, 100, 1), Face(1500, 200, 1)
    assert focus_step(s, 0, [a], [0.0], False, **STEP).cx == 500 and s.locked == 45
    assert focus_step(s, 7, [Face(520, 100, 1)], [0.0], False, **STEP).cx == 520  # follows
    assert focus_step(s, 14, [b, Face(520, 100, 1)], [0.0, 0.0], False, **STEP).cx == 520 and s.pending is None  # locked
    assert focus_step(s, 49, [b, a], [0.0, 0.0], False, **STEP).cx == 500 and s.pending == 1500  # size wins, pending
    assert focus_step(s, 56, [a], [0.0], False, **STEP).cx == 500 and s.pending is None  # no candidate any more
    focus_step(s, 63, [b, a], [0.0, 0.0], False, **STEP)
    key = focus_step(s, 91, [b, a], [0.0, 0.0], False, **STEP)
    assert key.cx == 1500 and key.change and not key.hard  # confirmed
    key = focus_step(s, 140, [Face(1500, 200, 1), Face(500, 210, 1)], [0.0, 9.0], False, **STEP)
    assert key.hard and key.cx == 500 and s.blocked == 170  # lips win at once, first rung
    key = focus_step(s, 147, [], [], True, **STEP)
    assert key.reset and key.cx == 960.0 and s.lips == [140]  # a source cut without faces; lips stay
    key = focus_step(s, 154, [], [], False, **STEP)
    assert key.cx == 960.0


def test_faces_in_focus_are_no_candidates():
    """All faces lie within the radius: none takes over from the one in focus, larger or louder, whatever is pending."""
    s = Focus(cx=29.95, area=12476.0, seen=77, locked=51, pending=212.45, since=63)
    faces = [Face(89.70, 29391, 0.9), Face(57.13, 14320, 0.9), Face(40.39, 8512, 0.9)]
    key = focus_step(s, 84, faces, [36.5, 58.5, 33.0], False, src_w=1280, src_h=720, fps=25.0)
    assert (key.cx, key.hard, key.change) == (40.39, False, False) and (s.area, s.locked, s.pending) == (8512, 51, None)
