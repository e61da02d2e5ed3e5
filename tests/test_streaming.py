"""Streams give what batches give."""

from pyspark.sql import functions as F

from reelframe.operators import cuts, path
from reelframe.streaming import stateful


def streamed(spark, df, folder, of):
    df.repartitionByRange(3, "frame").sortWithinPartitions("frame").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 10).parquet(f"{folder}/in")
    of(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect()))


def test_cuts(spark, tmp_path):
    df = spark.range(60).select((F.col("id") % 3).alias("clip_id"), (F.col("id") * 7 % 61).alias("frame"))
    batch = sorted(map(tuple, cuts.refractory(df, 9).collect()))
    assert streamed(spark, df, tmp_path, lambda s: stateful.cut_stream(s, 9)) == batch


def test_smoothing(spark, tmp_path):
    df = spark.range(60).select((F.col("id") % 2).alias("clip_id"), F.floor(F.col("id") / 2).alias("frame"), (F.col("id") * 131 % 1900).cast("double").alias("cx"), (F.col("id") % 13 == 0).alias("is_cut"))
    batch = []
    for clip in (0, 1):
        rows = sorted(r[1:] for r in df.collect() if r.clip_id == clip)
        batch += [(clip, r[0], x, j) for r, x, j in zip(rows, *path.smooth([r[1] for r in rows], [r[2] for r in rows], 607, 30.0), strict=True)]
    assert streamed(spark, df, tmp_path, lambda s: stateful.smooth_stream(s, 607)) == batch


def test_focus(spark, tmp_path):
    """Key frames of a stream are those of the fold over a whole clip."""
    from reelframe.operators import crop
    from reelframe.plans import inputs
    from tests.conftest import SMALL

    faces = inputs.faces(spark, SMALL).withColumn("mouth", F.lit(None).cast("array<double>"))
    media, cut = inputs.media(faces), inputs.cuts(faces)
    batch = sorted(tuple(r) for r in crop.keys(crop.samples(crop.timeline(faces, cut, media))).drop("seq").collect())
    reset = cuts.with_reset(inputs.samples(faces).drop("n_faces"), cut, media).select("clip_id", "sample_idx", F.col("reset").alias("cut"))
    df = faces.join(reset, ["clip_id", "sample_idx"]).join(media, "clip_id").select("clip_id", "frame", "face_idx", "cx", "area", "conf", F.lit(0.0).alias("speaking"), "cut", "total_frames")
    assert streamed(spark, df, tmp_path, lambda s: stateful.focus_stream(s, 1920, 1080)) == batch


def replayed(spark, df, folder, of, parts=3):
    """Rows with a time `at`, in files that lie apart in time and overlap a little, one a batch; the query is stopped after
    the first files and started anew. A row of a clip of its own in the far future brings the watermark past all ends."""
    rows = df.withColumn("late", F.when(F.xxhash64("at", "frame") % 3 == 0, F.lit(40)).otherwise(F.lit(0)))
    span = df.agg(F.min("at").cast("long").alias("a"), F.max("at").cast("long").alias("b")).first()
    cut = F.least(F.lit(parts - 1), F.floor((F.col("at").cast("long") + F.col("late") - span.a) * parts / (span.b - span.a + 1)))
    kinds = dict(df.dtypes)
    far = spark.range(1).select(*[F.lit("2100-01-01").cast("timestamp").alias(c) if c == "at" else (F.lit(-5) if c == "clip_id" else F.lit(0) if c in ("frame", "kind") else F.lit(None)).cast(kinds[c]).alias(c) for c in df.columns])
    for k in range(parts):
        rows.where(cut == k).drop("late").coalesce(1).write.parquet(f"{folder}/in/{k}")
    far.write.parquet(f"{folder}/in/{parts}")
    import shutil

    (folder / "now").mkdir()
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/now")
    for k in range(parts + 1):
        for n, p in enumerate((folder / f"in/{k}").glob("part-*.parquet")):
            shutil.copy(p, folder / f"now/{k}-{n}.parquet")
        if k in (0, parts):
            of(stream.withWatermark("at", "60 seconds")).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def at(frame, fps):
    """The time of a frame of a clip that begins at a minute of its own."""
    return F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("clip_id") % 5) * 30 + F.greatest(frame, F.lit(0)) / fps)


def timed(spark, sf):
    """The timeline of inputs with times; a row's rate is its clip's."""
    from pyspark.sql import Window

    from reelframe.plans import inputs

    line = inputs.timeline(inputs.faces(spark, sf), False).where("clip_id < 12")
    rate = F.max("fps").over(Window.partitionBy("clip_id"))
    return line.withColumn("at", at(F.col("frame"), rate))


def test_samples_and_speech(spark, tmp_path):
    """Tracks as entries of a map, replayed in batches, give what the fold over whole clips gives."""
    from reelframe.operators import crop
    from reelframe.streaming import clips
    from tests.conftest import SMALL

    df = timed(spark, SMALL)
    found = replayed(spark, df, tmp_path, clips.sample_stream)
    batch = crop.samples(df.drop("at"))
    assert found.where(f"kind = {clips.END}").count() == df.select("clip_id").distinct().count()
    some = lambda x: sorted(map(str, x.collect()))
    assert some(crop.spoken(found)) == some(crop.spoken(batch)) and crop.spoken(batch).count() > 500
    assert some(crop.keys(found)) == some(crop.keys(batch))


def test_whole_path_in_one_query(spark, tmp_path):
    """Two stateful operators in a chain, stopped and started anew, give the batch's path and jumps."""
    from reelframe.operators import crop
    from reelframe.streaming import clips
    from tests.conftest import SMALL

    df = timed(spark, SMALL)
    found = replayed(spark, df, tmp_path, clips.path_stream)
    samples = crop.samples(df.drop("at"))
    made = path.held(path.smoothed(crop.pieces_of(samples), keep=("src_w", "src_h")), F.col("src_w"), F.col("src_h"))
    some = lambda x: sorted(map(tuple, x.select("clip_id", "frame", "cx", "jump").collect()))
    assert some(found) == some(made) and made.where("jump").count() > 5


def test_targets(spark, tmp_path):
    """Frames held open until the next key, a cut or the clip's end."""
    from reelframe.plans import inputs
    from reelframe.streaming import clips
    from tests.conftest import SMALL

    marks = inputs.marks(inputs.faces(spark, SMALL)).withColumn("at", at(F.col("frame"), F.col("fps")))
    found = replayed(spark, marks, tmp_path, clips.target_stream)
    batch = path.interpolated(path.pieces(marks.drop("at"), F.lit(960.0)))
    some = lambda x: sorted(map(tuple, x.select("clip_id", "frame", "cx", "is_cut").collect()))
    assert some(found) == some(batch) and batch.count() > 1000


def test_late_rows_are_dropped(spark, tmp_path):
    """A row behind the watermark changes nothing."""
    from reelframe.operators import crop
    from reelframe.streaming import clips
    from tests.conftest import SMALL

    df = timed(spark, SMALL).where("clip_id = 1").cache()
    late = df.where("kind = 2 and sample_idx = 1").limit(1).withColumn("cx", F.lit(1.0))
    (tmp_path / "now").mkdir()
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/now")
    for part in (df, late, df.where("kind = 2").limit(1).withColumns({"clip_id": F.lit(-5).cast("bigint"), "at": F.lit("2100-01-01").cast("timestamp")})):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/now")
        clips.sample_stream(stream.withWatermark("at", "1 second")).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    keys = lambda x: sorted(map(str, crop.keys(x).collect()))
    assert keys(spark.read.parquet(f"{tmp_path}/out")) == keys(crop.samples(df.drop("at")))


def test_live_log(spark, tmp_path):
    """Pieces that end within lines, out of order and repeated, over several batches and a restart: all lines, and a tail that
    is the same when a batch is run again."""
    import random

    from reelframe.streaming import logs

    rng = random.Random(3)
    texts = {k: "\n".join(f"log {k} line {j}" + ("\rover" if j % 5 == 0 else "") for j in range(40 + k)) + ("\n" if k else "") for k in range(3)}
    pieces = []
    for k, text in texts.items():
        cuts = sorted(rng.sample(range(1, len(text)), 25))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        pieces += [(k, n, p, n == len(parts) - 1) for n, p in enumerate(parts)]
    order = sorted(range(len(pieces)), key=lambda n: pieces[n][1] + rng.randint(0, 6))
    kinds = "log_id bigint, piece bigint, text string, last boolean"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(kinds).parquet(f"{tmp_path}/in")
    want = sorted((k, n, p, part) for k, text in texts.items() for n, line in enumerate(text.removesuffix("\n").split("\n")) for p, part in enumerate(line.split("\r")))
    seen = []
    tail = logs.kept_tail(f"{tmp_path}/tail", 15)

    def each(lines, batch):
        lines = lines.persist()
        tail(lines, batch)
        once = sorted(map(tuple, logs.tail_at(spark, f"{tmp_path}/tail", batch).collect()))
        tail(lines, batch)
        assert once == sorted(map(tuple, logs.tail_at(spark, f"{tmp_path}/tail", batch).collect()))
        seen.extend(map(tuple, lines.collect()))

    for k in range(4):
        some = order[k * 20 : k * 20 + 20] + order[:3]
        spark.createDataFrame([pieces[n] for n in some], kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        logs.line_stream(stream).writeStream.foreachBatch(each).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen) == want
    last = sorted((tmp_path / "tail").iterdir(), key=lambda p: int(p.name.split("=")[1]))
    assert len(last) == 2
    got = sorted(map(tuple, logs.tail_at(spark, f"{tmp_path}/tail", int(last[-1].name.split("=")[1])).collect()))
    assert got == sorted(x for k in texts for x in [w for w in want if w[0] == k][-15:])
