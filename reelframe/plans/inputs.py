"""The engine's inputs, made from the driver's tables by rule; SQL holds the same rules for the oracle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelframe.batches import slices
from reelframe.operators import crop

SRC_W, SRC_H, FPS = 1920, 1080, 30.0
EVERY = 7
TASKS_A_CORE = 4
RATES_OF_AUDIO = (44_100, 48_000, 16_000, 8_000)
#: Which faces stand for a cut, a simple key, and a clip as a whole.
CUT_IF, KEY_IF, FIRST_IF = "det = 0 and kind = 'error' and frame > 2", "face_idx = 0 and sample_idx % 2 = 0", "det = 0 and sample_idx = 0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as spoken words: (clip_id, seg_idx, word_idx, word, rn, start, end)."""
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("clip_id"), F.col("turn").alias("seg_idx"), F.posexplode(F.split("text", r"\s+")).alias("word_idx", "word")).where("word != ''")
    by = Window.partitionBy("clip_id").orderBy("seg_idx", "word_idx")
    said = said.withColumn("rn", (F.row_number().over(by) - 1).cast("long")).withColumn("start", F.col("rn") * 0.37)
    return said.withColumn("end", F.when(F.col("rn") % 11 == 0, F.col("start")).otherwise(F.col("start") + 0.05 * F.length("word")))


WORDS = r"""w0 AS (SELECT conv_id AS clip_id, turn AS seg_idx, unnest(string_split_regex(text, '\s+')) AS word, generate_subscripts(string_split_regex(text, '\s+'), 1) - 1 AS word_idx FROM conversations),
w1 AS (SELECT *, (row_number() OVER (PARTITION BY clip_id ORDER BY seg_idx, word_idx) - 1)::BIGINT AS rn FROM w0 WHERE word <> ''),
words AS (SELECT clip_id, seg_idx, word_idx, word, rn, rn * 0.37::DOUBLE AS "start", CASE WHEN rn % 11 = 0 THEN rn * 0.37::DOUBLE ELSE rn * 0.37::DOUBLE + 0.05::DOUBLE * length(word) END AS "end" FROM w1)"""


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as faces of sampled frames: (clip_id, sample_idx, frame, det, face_idx, cx, area, conf, width, speaking, kind)."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(by) - 1).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    e = e.select(F.col("user_id").alias("clip_id"), F.floor(F.col("rn") / 3).alias("sample_idx"), (F.col("rn") % 3).alias("det"), (F.col("value") * SRC_W / 491).alias("cx"), (F.lit(2000) + (F.col("event_id") * 7919) % 40000).cast("double").alias("area"), (0.5 + (F.col("k") % 50) / 100).alias("conf"), F.lit(120.0).alias("width"), (F.col("k") / 4).alias("speaking"), "k", F.col("event_type").alias("kind"))
    order = Window.partitionBy("clip_id", "sample_idx").orderBy(F.col("area").desc(), "det")
    return e.withColumn("frame", F.col("sample_idx") * EVERY).withColumn("face_idx", (F.row_number().over(order) - 1).cast("long"))


FACES = """f0 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn, (props->>'$.k')::INT AS k FROM events),
f1 AS (SELECT user_id AS clip_id, (rn // 3)::BIGINT AS sample_idx, (rn % 3)::INT AS det, value * 1920 / 491 AS cx, (2000 + (event_id * 7919) % 40000)::DOUBLE AS area, 0.5::DOUBLE + (k % 50) / 100::DOUBLE AS conf, 120::DOUBLE AS width, k / 4::DOUBLE AS speaking, k, event_type AS kind FROM f0),
faces AS (SELECT *, sample_idx * 7 AS frame, (row_number() OVER (PARTITION BY clip_id, sample_idx ORDER BY area DESC, det) - 1)::BIGINT AS face_idx FROM f1)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as frames of 192 by 108 pixels, (clip_id, frame, height, width, pixels): 8 by 8 fields, whose colours differ
    the more the higher the label's remainder by four."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A batch of embeddings would be hundreds of times its size as frames.
        for batch in slices(batches, 64):
            ids, labels = batch.column("vec_id").to_pylist(), batch.column("label").to_pylist()
            fields = np.stack([np.resize(np.array(values, float), (8, 8)) * 120 * ((label or 0) % 4) for values, label in zip(batch.column("embedding").to_pylist(), labels, strict=True)])
            colours = np.clip(np.stack([100 + fields, 130 - fields, 90 + np.roll(fields, 1, 1)], 3), 0, 255).astype(np.uint8)
            frames = [f.tobytes() for f in np.repeat(np.repeat(colours, 24, 2), 14, 1)[:, :108]]
            yield pa.RecordBatch.from_arrays([pa.array([k % 20 for k in ids]), pa.array([k // 20 for k in ids]), pa.array([108] * len(ids), pa.int32()), pa.array([192] * len(ids), pa.int32()), pa.array(frames, pa.binary())], ["clip_id", "frame", "height", "width", "pixels"])

    some = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label").where("vec_id is not null and embedding is not null")
    # A file, or a group of rows in it, is one task's, so small rows are dealt out before each becomes a frame of 62 KB.
    return some.repartition(TASKS_A_CORE * spark.sparkContext.defaultParallelism, "vec_id").mapInArrow(of, "clip_id bigint, frame bigint, height int, width int, pixels binary")


def audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as chunks of audio, (clip_id, start, rate, channels, samples), in four rates, in one or two channels."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            px = [np.floor(np.array(v, float) * 20_000).clip(-32_768, 32_767).astype("<i2").tobytes() for v in batch.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(px, pa.binary())], ["vec_id", "samples"])

    k = F.col("vec_id") % 20
    some = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").where("vec_id is not null and embedding is not null").mapInArrow(of, "vec_id bigint, samples binary")
    channels = F.when(k % 2 == 0, 1).otherwise(2)
    return some.select(k.alias("clip_id"), (F.floor(F.col("vec_id") / 20) * 64 / channels).cast("long").alias("start"), F.element_at(F.array(*map(F.lit, RATES_OF_AUDIO)), (k % 4 + 1).cast("int")).alias("rate"), channels.alias("channels"), "samples")


#: By hand what audio() and its resampling say, one sum over the taps of each output sample.
AUDIO = """s0 AS (SELECT vec_id % 20 AS clip_id, vec_id // 20 AS chunk, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings),
s1 AS (SELECT clip_id, (chunk * 64 + j) // (CASE WHEN clip_id % 2 = 0 THEN 1 ELSE 2 END) AS k, avg(greatest(-32768, least(32767, floor(e::DOUBLE * 20000)))) AS v FROM s0 GROUP BY ALL),
r AS (SELECT clip_id, [44100, 48000, 16000, 8000][clip_id % 4 + 1] AS rate, max(k) + 1 AS total FROM s1 GROUP BY clip_id),
r1 AS (SELECT *, least(1, 16000 / rate)::DOUBLE AS cut, ceil(16 * greatest(1, rate / 16000))::BIGINT AS half FROM r),
o AS (SELECT *, unnest(generate_series(0, ceil(total * 16000 / rate)::BIGINT - 1)) AS n FROM r1),
t AS (SELECT *, (n * rate) // 16000 + unnest(generate_series(1 - half, half)) AS k, ((n * rate) % 16000) / 16000::DOUBLE AS part, (n * rate) // 16000 AS place FROM o),
w AS (SELECT clip_id, n, k, cut, part - (k - place) AS x, 16 / cut AS width FROM t),
audio AS (SELECT w.clip_id, n, sum(CASE WHEN abs(x) < width THEN coalesce(v, 0) * cut * (CASE WHEN x = 0 THEN 1 ELSE sin(pi() * cut * x) / (pi() * cut * x) END) * (0.5::DOUBLE + 0.5::DOUBLE * cos(pi() * x / width)) ELSE 0 END) / 32768 AS value FROM w LEFT JOIN s1 ON s1.clip_id = w.clip_id AND s1.k = w.k GROUP BY ALL)"""


def samples(faces_: DataFrame) -> DataFrame:
    return faces_.groupBy("clip_id", "sample_idx").agg(F.min("frame").alias("frame"), F.count("*").alias("n_faces"))


def cuts(faces_: DataFrame) -> DataFrame:
    """Two frames before each sample whose first event is an error."""
    return faces_.where(CUT_IF).select("clip_id", (F.col("frame") - 2).alias("frame"))


def frames(faces_: DataFrame) -> DataFrame:
    n = faces_.groupBy("clip_id").agg((F.max("sample_idx") * EVERY + EVERY).alias("n"))
    return n.select("clip_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("frame"))


def keys(faces_: DataFrame) -> DataFrame:
    """Simple key frames: the largest face of every other sample, hard where it speaks loudest."""
    return faces_.where(KEY_IF).select("clip_id", F.col("sample_idx").alias("seq"), "frame", "cx", (F.col("k") >= 95).alias("hard"))


def _media(fixed: bool) -> dict:
    k = F.col("clip_id") % 4
    if fixed:
        return {"src_w": F.lit(SRC_W), "src_h": F.lit(SRC_H), "fps": F.lit(FPS)}
    fps = F.when(k == 0, 0.0).when(k == 1, 25.0).when(k == 2, 60.0).otherwise(FPS)
    return {"src_w": F.when(k == 1, 1280).otherwise(SRC_W), "src_h": F.when(k == 1, 720).otherwise(SRC_H), "fps": fps}


def media(faces_: DataFrame, fixed: bool = True) -> DataFrame:
    """What a clip's file says of itself: (clip_id, src_w, src_h, fps, total_frames); one size and rate for all clips, or
    by clip some that differ, with a rate that is missing."""
    n = faces_.groupBy("clip_id").agg((F.max("sample_idx") * EVERY + EVERY).alias("total_frames"))
    return n.withColumns(_media(fixed)).select("clip_id", "src_w", "src_h", "fps", "total_frames")


def _with_media(faces_: DataFrame, fixed: bool = True) -> DataFrame:
    """The faces with their clip's media, so that what is made of them needs one reading and no join."""
    return faces_.withColumn("total_frames", F.max("sample_idx").over(Window.partitionBy("clip_id")) * EVERY + EVERY).withColumns(_media(fixed))


def timeline(faces_: DataFrame, fixed: bool = True) -> DataFrame:
    """Faces, the cuts of cuts() and the media of media() as a timeline; a clip's rows are together."""
    px = F.when(F.col("area").cast("long") % 11 != 0, F.array(*[(F.col("k") + j).cast("double") for j in range(4)]))
    cut = F.when(F.expr(CUT_IF), crop.row(crop.CUT, frame=F.col("frame") - 2))
    each = F.array_compact(F.array(crop.face_row(), cut, F.when(F.expr(FIRST_IF), crop.media_row())))
    return _with_media(faces_, fixed).withColumn("mouth", px).select("clip_id", F.inline(each))


def marks(faces_: DataFrame) -> DataFrame:
    """The keys of keys(), the cuts of cuts() and frame 0 of each clip as marks."""
    null = F.lit(None)
    mark = lambda frame, seq, cx, starts: F.struct(frame.cast("long").alias("frame"), seq.cast("long").alias("seq"), cx.cast("double").alias("cx"), starts.alias("starts"))
    key = F.when(F.expr(KEY_IF), mark(F.col("frame"), F.col("sample_idx"), F.col("cx"), F.col("k") >= 95))
    cut = F.when(F.expr(CUT_IF), mark(F.col("frame") - 2, null, null, F.lit(True)))
    each = F.array_compact(F.array(key, cut, F.when(F.expr(FIRST_IF), mark(F.lit(0), null, null, F.lit(False)))))
    return _with_media(faces_).select("clip_id", "src_w", "src_h", "fps", "total_frames", F.inline(each))


MEDIA = """media AS (SELECT clip_id, CASE WHEN clip_id % 4 = 1 THEN 1280 ELSE 1920 END AS src_w, CASE WHEN clip_id % 4 = 1 THEN 720 ELSE 1080 END AS src_h,
  CASE clip_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 25 WHEN 2 THEN 60 ELSE 30 END::DOUBLE AS fps, max(sample_idx) * 7 + 7 AS total_frames FROM faces GROUP BY clip_id)"""


_BASE = (
    FACES
    + """,
samples AS (SELECT clip_id, sample_idx, min(frame) AS frame, count(*) AS n_faces FROM faces GROUP BY ALL),
cuts AS (SELECT clip_id, frame - 2 AS frame FROM faces WHERE det = 0 AND kind = 'error' AND frame > 2),
frames AS (SELECT clip_id, unnest(generate_series(0, max(sample_idx) * 7 + 6)) AS frame FROM faces GROUP BY clip_id)"""
)

PATH = (
    _BASE
    + """,
keys AS (SELECT clip_id, sample_idx AS seq, frame, cx, k >= 95 AS hard FROM faces WHERE face_idx = 0 AND sample_idx % 2 = 0)"""
)


#: Tracks and speech of faces: in each sample all faces find their tracks, then all tracks move on. A patch is four
#: pixels k .. k + 3, so two patches differ by the difference of their k; some faces have none.
SPOKEN = (
    _BASE
    + """,
steps AS (SELECT clip_id, sample_idx, face_idx, cx, CASE WHEN area::BIGINT % 11 <> 0 THEN k END AS px, phase, row_number() OVER (PARTITION BY clip_id ORDER BY sample_idx, phase, face_idx) AS n FROM faces, (VALUES (0), (1)) AS p(phase)),
said AS (SELECT DISTINCT clip_id, 0::BIGINT AS n, -1::BIGINT AS sample_idx, -1::BIGINT AS face_idx, -1 AS phase, []::STRUCT(cx DOUBLE, px INT, h DOUBLE[])[] AS tracks, []::BIGINT[] AS own, NULL::BIGINT AS track, NULL::DOUBLE AS speaking FROM faces
 UNION ALL SELECT clip_id, n, sample_idx, face_idx, phase,
  CASE WHEN phase = 0 AND nr > len(tracks) THEN list_append(tracks, {'cx': cx, 'px': NULL::INT, 'h': []::DOUBLE[]}) WHEN phase = 0 THEN tracks
   ELSE list_transform(tracks, lambda t, i: CASE WHEN i = nr THEN {'cx': cx, 'px': coalesce(px, t.px), 'h': list_append(t.h, moved)[-2:]} ELSE t END) END,
  CASE WHEN phase = 1 THEN own WHEN face_idx = 0 THEN [nr] ELSE list_append(own, nr) END, nr - 1,
  CASE WHEN phase = 1 THEN list_avg(list_append(tracks[nr].h, moved)[-2:]) END
 FROM (SELECT *, CASE WHEN phase = 1 THEN coalesce(abs(px - tracks[nr].px), 0)::DOUBLE END AS moved
  FROM (SELECT *, CASE WHEN phase = 1 THEN own[face_idx + 1] WHEN len(d) > 0 AND list_min(d) < 90 THEN list_position(d, list_min(d)) ELSE len(tracks) + 1 END::BIGINT AS nr
   FROM (SELECT s.*, said.tracks, said.own, list_transform(said.tracks, lambda t: abs(t.cx - s.cx)) AS d FROM said JOIN steps s ON s.clip_id = said.clip_id AND s.n = said.n + 1)))),
spoken AS (SELECT clip_id, sample_idx, face_idx, track, speaking FROM said WHERE phase = 1)"""
)

#: The focus, a sample at a time: init, none, lips, wait, pend or rest.
FOCUS = (
    SPOKEN
    + """,
seen AS (SELECT *, coalesce(lag(frame) OVER (PARTITION BY clip_id ORDER BY frame), -1) AS before, row_number() OVER (PARTITION BY clip_id ORDER BY sample_idx) AS n FROM samples),
listed AS (SELECT clip_id, sample_idx, list({'cx': cx, 'area': area, 'sp': speaking, 'score': CASE WHEN speaking < 3 THEN area * (0.75::DOUBLE + conf) ELSE (1 - 0.6::DOUBLE) * (area * (0.75::DOUBLE + conf)) + 0.6::DOUBLE * (area * (0.75::DOUBLE + conf)) * (1 + 3 * least(speaking / 20, 1)) END} ORDER BY face_idx) AS fs
 FROM (SELECT f.clip_id, f.sample_idx, f.face_idx, f.cx, f.area, f.conf, s.speaking FROM faces f JOIN spoken s USING (clip_id, sample_idx, face_idx)) GROUP BY ALL),
asked AS (SELECT s.clip_id, s.n, s.frame, fs, EXISTS (SELECT 1 FROM cuts c WHERE c.clip_id = s.clip_id AND c.frame > s.before AND c.frame <= s.frame) AS reset, 0.35::DOUBLE * 607 AS r FROM seen s JOIN listed USING (clip_id, sample_idx)),
focus AS (SELECT DISTINCT clip_id, 0::BIGINT AS n, 0::BIGINT AS frame, NULL::DOUBLE AS cx, 0::DOUBLE AS area, -1000000000::BIGINT AS last, -1::BIGINT AS locked, NULL::DOUBLE AS pending, 0::BIGINT AS since, []::BIGINT[] AS lips, -1::BIGINT AS blocked, FALSE AS hard, FALSE AS reset, FALSE AS change FROM faces
 UNION ALL SELECT clip_id, n, frame,
  CASE WHEN act = 'init' THEN fs[best].cx WHEN act IN ('lips', 'switch') THEN fs[other].cx ELSE cx1 END,
  CASE WHEN act = 'init' THEN fs[best].area WHEN act IN ('lips', 'switch') THEN fs[other].area ELSE area1 END,
  CASE WHEN act IN ('init', 'lips', 'switch') THEN frame ELSE last1 END,
  CASE WHEN act IN ('init', 'lips', 'switch') THEN frame + 45 ELSE locked END,
  CASE WHEN act IN ('init', 'lips', 'switch') THEN NULL WHEN act = 'pend' THEN fs[other].cx WHEN act = 'wait' THEN pending WHEN near IS NOT NULL THEN NULL ELSE pending END,
  CASE WHEN act IN ('pend', 'switch') THEN since1 ELSE since END,
  CASE WHEN act = 'lips' THEN list_append(lips1, frame) ELSE lips END,
  CASE WHEN act = 'lips' THEN frame + [30, 60, 30][least(len(lips1), 2) + 1] ELSE blocked END,
  act = 'lips', reset, act = 'lips' OR (act = 'switch' AND abs(fs[other].cx - cx1) > r / 2)
 FROM (SELECT *, CASE WHEN reset OR cx IS NULL THEN 'init' WHEN other IS NULL OR frame < locked THEN 'none' WHEN by_lips AND NOT by_size AND NOT lost THEN CASE WHEN frame >= blocked THEN 'lips' ELSE 'wait' END
    WHEN by_lips OR by_size OR lost THEN CASE WHEN frame - since1 >= 25 THEN 'switch' ELSE 'pend' END ELSE 'rest' END AS act, list_filter(lips, lambda x: frame - x <= 120) AS lips1
  FROM (SELECT *, area1 <= 0 OR fs[other].area >= 1.35::DOUBLE * area1 AS by_size, fs[other].sp >= 3 AND fs[other].sp > 1.5::DOUBLE * coalesce(fs[held].sp, 0) AS by_lips, CASE WHEN pending IS NULL OR abs(fs[other].cx - pending) > r THEN frame ELSE since END AS since1
   FROM (SELECT *, list_position(list_transform(fs, lambda f: abs(f.cx - cx1) <= r), TRUE) AS held, list_position(list_transform(fs, lambda f: CASE WHEN abs(f.cx - cx1) > r THEN f.sp END), list_max(list_transform(fs, lambda f: CASE WHEN abs(f.cx - cx1) > r THEN f.sp END))) AS other
    FROM (SELECT *, coalesce(fs[near].cx, cx) AS cx1, coalesce(fs[near].area, area) AS area1, CASE WHEN near IS NULL THEN last ELSE frame END AS last1, near IS NULL AND frame - last > 24 AS lost
     FROM (SELECT *, CASE WHEN list_min(d) <= r THEN list_position(d, list_min(d)) END AS near, list_position(list_transform(fs, lambda f: f.score), list_max(list_transform(fs, lambda f: f.score))) AS best
      FROM (SELECT a.*, p.cx, p.area, p.last, p.locked, p.pending, p.since, p.lips, p.blocked, list_transform(a.fs, lambda f: abs(f.cx - p.cx)) AS d FROM focus p JOIN asked a ON a.clip_id = p.clip_id AND a.n = p.n + 1))))))),
keys AS (SELECT clip_id, n - 1 AS seq, frame, least(greatest(cx, 303.5), 1616.5) AS cx, hard, reset, change FROM focus WHERE n > 0)"""
)


#: What follows from each clip's size and rate.
RATES = """rates AS (SELECT *, w / 2::DOUBLE AS half, greatest(0.35::DOUBLE * w, 36) AS r, trunc(fps * 1.5::DOUBLE)::BIGINT AS lock, trunc(fps * 0.8::DOUBLE)::BIGINT AS grace, trunc(fps * 0.85::DOUBLE)::BIGINT AS confirm,
  trunc(fps)::BIGINT AS short, trunc(fps * 2)::BIGINT AS long, trunc(fps * 4)::BIGINT AS burst, greatest(0.07::DOUBLE * w, 36) AS dz, greatest(480 / fps, 1) AS vmax, 1 - exp(-1 / greatest(fps * 0.45::DOUBLE, 1)) AS alpha
 FROM (SELECT clip_id, src_w, total_frames, trunc(src_h * 9 / 16)::INT AS w, CASE WHEN fps > 0 THEN fps ELSE 30 END AS fps FROM media))"""


def by_rate(sql: str) -> str:
    """SQL of the focus and the path of clips of one size and rate, for clips that each have their own."""
    for fixed, own in [
        ("samples AS (SELECT clip_id, sample_idx, min(frame)", f"{MEDIA},\n{RATES},\nsamples AS (SELECT clip_id, sample_idx, min(frame)"),
        ("0.35::DOUBLE * 607 AS r FROM seen s JOIN listed USING (clip_id, sample_idx)", "g.r, g.lock, g.grace, g.confirm, g.short, g.long, g.burst FROM seen s JOIN listed USING (clip_id, sample_idx) JOIN rates g ON g.clip_id = s.clip_id"),
        ("frame + 45", "frame + lock"),
        ("[30, 60, 30]", "[short, long, short]"),
        ("frame - since1 >= 25", "frame - since1 >= confirm"),
        ("frame - x <= 120", "frame - x <= burst"),
        ("frame - last > 24", "frame - last > grace"),
        ("least(greatest(cx, 303.5), 1616.5) AS cx, hard, reset, change FROM focus WHERE n > 0", "least(greatest(cx, half), src_w - half) AS cx, hard, reset, change FROM focus JOIN rates USING (clip_id) WHERE n > 0"),
        ("coalesce(p.k, 960)", "coalesce(p.k, (SELECT src_w / 2 FROM rates g WHERE g.clip_id = t3.clip_id))"),
        ("g AS (SELECT 42.49::DOUBLE AS dz, 16::DOUBLE AS vmax, 1 - exp(-1 / 13.5::DOUBLE) AS alpha)", "g AS (SELECT clip_id AS of, dz, vmax, alpha FROM rates)"),
        ("t.frame = s.frame + 1, g)", "t.frame = s.frame + 1 JOIN g ON g.of = s.clip_id)"),
    ]:
        assert fixed in sql, fixed
        sql = sql.replace(fixed, own)
    return sql


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as clips of a customer's manifest; some lack an id, a length, a score or a caption."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    some = lambda x, n: F.when(k % n != 0, x)
    c = o.select(F.col("o_custkey").alias("video"), k.alias("key"), some(k, 17).alias("clip_id"), F.format_string("%02d:%02d:%02d", (k % 3).cast("int"), (k % 60).cast("int"), (k % 7).cast("int")).alias("start_time"), F.lit(None).cast("string").alias("end_time"), some((k % 180).cast("double"), 13).alias("duration_seconds"), F.col("c_name").alias("speaker"), some((k % 23) / 2, 19).alias("viral_score"), some(F.concat_ws(" ", "o_orderpriority", "c_mktsegment"), 29).alias("suggested_caption"))
    return c.withColumn("pos", (F.row_number().over(Window.partitionBy("video").orderBy("key")) - 1).cast("long"))


CLIPS = """c0 AS (SELECT o_custkey AS video, o_orderkey AS key, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderkey END AS clip_id, printf('%02d:%02d:%02d', o_orderkey % 3, o_orderkey % 60, o_orderkey % 7) AS start_time, NULL::VARCHAR AS end_time,
  CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey % 180)::DOUBLE END AS duration_seconds, c_name AS speaker, CASE WHEN o_orderkey % 19 <> 0 THEN (o_orderkey % 23) / 2::DOUBLE END AS viral_score,
  CASE WHEN o_orderkey % 29 <> 0 THEN concat_ws(' ', o_orderpriority, c_mktsegment) END AS suggested_caption FROM orders JOIN customer ON o_custkey = c_custkey),
clips AS (SELECT *, (row_number() OVER (PARTITION BY video ORDER BY key) - 1)::BIGINT AS pos FROM c0),
excluded AS (SELECT DISTINCT doc_id AS clip_id FROM labels WHERE quality = 0)"""


def excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("clip_id")).distinct()
