"""The registry of queries and of the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelframe.functions import scalars as S
from reelframe.operators import audio, captions, crop, cuts, logs, path, pixels, render, vision
from reelframe.plans import inputs as I
from reelframe.sources import manifest

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with the SQL for its rows."""

    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Manifests and clips


@query("SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def json_extract_props(spark, sf):
    props = F.from_json("props", "struct<k:int>")
    return I.table(spark, sf, "events").select("event_id", props["k"].alias("k"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'malformed' WHEN 2 THEN 'no_clips' WHEN 3 THEN 'malformed' ELSE 'ok' END AS state FROM orders""")
def manifest_validate(spark, sf):
    k = F.col("o_orderkey")
    raw = F.when(k % 5 == 0, F.lit("  \n")).when(k % 5 == 1, F.concat(F.lit('{"clips": ['), k)).when(k % 5 == 2, F.lit('{"clips": [], "x": 1}')).when(k % 5 == 3, F.lit("[1]")).otherwise(F.concat(F.lit('{"clips": [{"clip_id": '), k, F.lit("}]}")))
    return I.table(spark, sf, "orders").select("o_orderkey", manifest.validated(raw).alias("state"))


@query(f"""WITH {I.CLIPS} SELECT video, pos, coalesce(clip_id, pos + 1) AS "ID", start_time AS "Start", coalesce(end_time, '') AS "End", coalesce(duration_seconds, 0) AS "Dur(s)", coalesce(speaker, '') AS "Speaker", coalesce(viral_score, 0) AS "Viral", coalesce(suggested_caption, '') AS "Caption" FROM clips""")
def clip_table(spark, sf):
    c = manifest.with_defaults(I.clips(spark, sf))
    return c.select("video", "pos", F.col("shown_id").alias("ID"), F.col("start_time").alias("Start"), F.col("end_time").alias("End"), F.col("duration_seconds").alias("Dur(s)"), F.col("speaker").alias("Speaker"), F.col("viral_score").alias("Viral"), F.col("suggested_caption").alias("Caption"))


@query(f"""WITH {I.CLIPS} SELECT video, max(coalesce(duration_seconds, 0)) AS longest, sum(coalesce(duration_seconds, 0)) AS total, count(*) AS n_clips, count(*) FILTER (e.clip_id IS NULL) AS n_included FROM clips LEFT JOIN excluded e USING (clip_id) GROUP BY video""")
def clip_metrics(spark, sf):
    c = I.clips(spark, sf).join(I.excluded(spark, sf).withColumn("out", F.lit(True)), "clip_id", "left")
    d = F.coalesce("duration_seconds", F.lit(0.0))
    return c.groupBy("video").agg(F.max(d).alias("longest"), F.sum(d).alias("total"), F.count("*").alias("n_clips"), F.count_if(F.col("out").isNull()).alias("n_included"))


@query(f"WITH {I.CLIPS} SELECT video, pos, c.clip_id FROM clips c ANTI JOIN excluded e ON c.clip_id = e.clip_id")
def clip_include_anti(spark, sf):
    return manifest.included(I.clips(spark, sf), I.excluded(spark, sf)).select("video", "pos", "clip_id")


@query(f"""WITH {I.CLIPS}, m AS (SELECT *, max(coalesce(duration_seconds, 0)) OVER (PARTITION BY video) AS longest FROM clips)
SELECT video, pos, CASE WHEN longest > 0 THEN trunc(coalesce(duration_seconds, 0) / longest * 100)::INT ELSE 0 END AS pct FROM m""")
def clip_pct_bar(spark, sf):
    d = F.coalesce("duration_seconds", F.lit(0.0))
    return I.clips(spark, sf).select("video", "pos", S.percent_bar(d, F.max(d).over(Window.partitionBy("video"))).alias("pct"))


@query(f"WITH {I.CLIPS} SELECT video, pos, CASE WHEN viral_score IN (9, 10) THEN '#4ade80' WHEN viral_score IN (7, 8) THEN '#facc15' ELSE '#f87171' END AS band FROM clips")
def score_band(spark, sf):
    return I.clips(spark, sf).select("video", "pos", S.score_band(F.col("viral_score")).alias("band"))


def _trimmed(x: str) -> str:
    return rf"regexp_replace({x}, '\A[{S.SPACE}]+|[{S.SPACE}]+\z', '', 'g')"


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN printf('%02d:%02d:%02d', o_orderkey % 30, o_orderkey % 60, o_orderkey % 59) WHEN 1 THEN chr(160) || o_orderkey || ' :07' || chr(8195) WHEN 2 THEN o_orderkey::VARCHAR WHEN 3 THEN '1:2:3:' || o_orderkey WHEN 4 THEN o_orderkey || ':1.5' ELSE '-1:' || (o_orderkey % 60) END AS ts FROM orders),
p AS (SELECT *, list_transform(string_split(ts, ':'), lambda x: try_cast(CASE WHEN regexp_full_match(""" + _trimmed("x") + """, '[+-]?[0-9]+') THEN """ + _trimmed("x") + """ END AS BIGINT)) AS v FROM t)
SELECT o_orderkey, ts, coalesce(CASE len(v) WHEN 3 THEN v[1] * 3600 + v[2] * 60 + v[3] WHEN 2 THEN v[1] * 60 + v[2] ELSE v[1] END, 0)::BIGINT AS seconds FROM p""")
def timecode_parse(spark, sf):
    k = F.col("o_orderkey")
    kinds = [F.format_string("%02d:%02d:%02d", (k % 30).cast("int"), (k % 60).cast("int"), (k % 59).cast("int")), F.concat(F.lit("\u00a0"), k, F.lit(" :07\u2003")), k.cast("string"), F.concat(F.lit("1:2:3:"), k), F.concat(k, F.lit(":1.5"))]
    ts = F.concat(F.lit("-1:"), k % 60)
    for n, kind in enumerate(kinds):
        ts = F.when(k % 6 == n, kind).otherwise(ts)
    return I.table(spark, sf, "orders").select("o_orderkey", ts.alias("ts")).withColumn("seconds", S.timecode_seconds(F.col("ts")))


_TIME = "printf('%d:%02d:%02d.%02d', floor({0} / 3600)::INT, floor(({0} % 3600) / 60)::INT, trunc({0} % 60)::INT, trunc(({0} - floor({0})) * 100)::INT)"


@query("SELECT l_orderkey, l_linenumber, " + _TIME.format("(l_extendedprice / 7)") + " AS t FROM lineitem")
def timecode_format(spark, sf):
    return I.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.caption_time(F.col("l_extendedprice") / 7).alias("t"))


#: Of every five texts two have white space of other kinds at their ends and within.
_CAPTION = "CASE doc_id % 5 WHEN 0 THEN chr(160) || replace(text, ' ', chr(12288)) || chr(8232) || chr(9) WHEN 1 THEN chr(28) || text || chr(133) || ' ' ELSE text END"
_SLUG = rf"left(regexp_replace(regexp_replace(regexp_replace({_CAPTION}, '[^\p{{L}}\p{{N}}_{S.SPACE}-]', '', 'g'), '[-{S.SPACE}]+', '_', 'g'), '^_+|_+$', '', 'g'), 100)"


def _captions(spark, sf):
    k, x = F.col("doc_id"), F.col("text")
    odd = F.when(k % 5 == 0, F.concat(F.lit("\u00a0"), F.replace(x, F.lit(" "), F.lit("\u3000")), F.lit("\u2028\t"))).when(k % 5 == 1, F.concat(F.lit("\x1c"), x, F.lit("\x85 "))).otherwise(x)
    return I.table(spark, sf, "documents").withColumn("text", odd)


@query(f"SELECT doc_id, {_SLUG} AS slug, coalesce({_SLUG}, '') || '.mp4' AS file FROM documents")
def caption_slug(spark, sf):
    slug = S.slug(F.col("text"))
    return _captions(spark, sf).select("doc_id", slug.alias("slug")).withColumn("file", F.concat(F.coalesce("slug", F.lit("")), F.lit(".mp4")))


@query(f"SELECT doc_id, 'out/' || coalesce(source, '') || '/' || coalesce({_SLUG}, '') || '.mp4' AS path FROM documents")
def output_path(spark, sf):
    folder = F.concat(F.lit("out/"), F.coalesce("source", F.lit("")))
    return _captions(spark, sf).select("doc_id", S.output_path(folder, F.col("text")).alias("path"))


@query(f"SELECT slug, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, {_SLUG} AS slug FROM documents) GROUP BY slug HAVING count(*) > 1")
def slug_collisions(spark, sf):
    s = _captions(spark, sf).select("doc_id", S.slug(F.col("text")).alias("slug"))
    return s.groupBy("slug").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("SELECT doc_id, '#' || doc_id || ' — ' || left(text, 50) AS label FROM documents")
def clip_label(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", S.clip_label(F.col("doc_id"), F.col("text")).alias("label"))


_PATHS = "SELECT page_id, url || CASE page_id % 5 WHEN 0 THEN '.mp4' WHEN 1 THEN '.MKV' WHEN 2 THEN '.mov.txt' WHEN 3 THEN '.Avi' ELSE '' END AS path FROM pages"


def _names(spark, sf):
    k = F.col("page_id")
    end = F.when(k % 5 == 0, ".mp4").when(k % 5 == 1, ".MKV").when(k % 5 == 2, ".mov.txt").when(k % 5 == 3, ".Avi").otherwise("")
    return I.table(spark, sf, "pages").select("page_id", F.concat("url", end).alias("path"))


@query(rf"SELECT page_id, regexp_matches(lower(path), '\.(mp4|mkv|mov|avi)$') AS is_video FROM ({_PATHS})")
def suffix_filter(spark, sf):
    return _names(spark, sf).select("page_id", S.has_suffix(F.col("path"), manifest.VIDEO_SUFFIXES).alias("is_video"))


@query(rf"SELECT row_number() OVER (ORDER BY path, page_id) AS place, path FROM ({_PATHS}) WHERE regexp_matches(lower(path), '\.(mp4|mkv|mov|avi)$') AND path IS NOT NULL")
def file_listing(spark, sf):
    found = _names(spark, sf).where(S.has_suffix(F.col("path"), manifest.VIDEO_SUFFIXES))
    return manifest.numbered(found, ["path", "page_id"], "place").select("place", "path")


_DRAW = r"replace(replace(replace({0}, '\', '\\'), ':', '\:'), '''', '\''')"


@query("SELECT doc_id, " + _DRAW.format("text") + " AS t FROM documents")
def escape_drawtext(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", S.escape_drawtext(F.col("text")).alias("t"))


_HTML = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query("SELECT page_id, " + _HTML.format("html") + " AS t FROM pages WHERE html IS NOT NULL")
def escape_html(spark, sf):
    return I.table(spark, sf, "pages").where("html is not null").select("page_id", S.escape_html(F.col("html")).alias("t"))


def _part(x: str, look: str) -> str:
    return f"CASE WHEN {_trimmed(x)} <> '' THEN 'drawtext=text=''' || {_DRAW.format(_trimmed(x))} || '''{look}' END"



@query(rf"""SELECT c_custkey, concat_ws(',', 'ass=' || replace(replace('C:\v\' || c_name, '\', '/'), ':', '\:'), {_part("CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment || ':''' || chr(8195) ELSE chr(160) || ' ' END", render.CHANNEL)}, {_part("CASE WHEN c_custkey % 2 > 0 THEN c_name END", render.CREDIT)}) AS graph, c_custkey % 3 > 0 AND c_custkey % 2 > 0 AS ready FROM customer""")
def filter_graph(spark, sf):
    k = F.col("c_custkey")
    channel = F.when(k % 3 > 0, F.concat("c_mktsegment", F.lit(":'\u2003"))).otherwise("\u00a0 ")
    credit = F.when(k % 2 > 0, F.col("c_name"))
    return I.table(spark, sf, "customer").select("c_custkey", render.filter_graph(F.concat(F.lit("C:\\v\\"), "c_name"), channel, credit).alias("graph"), render.ready(channel, credit).alias("ready"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'Menunggu' WHEN 'click' THEN 'Siap' WHEN 'error' THEN 'Error' WHEN 'purchase' THEN 'Processing' ELSE 'Menunggu' END AS badge FROM events")
def status_badge(spark, sf):
    e = F.col("event_type")
    status = F.when(e == "view", "idle").when(e == "click", "ready").when(e == "purchase", "running").when(e == "error", "error").otherwise("other")
    return I.table(spark, sf, "events").select("event_id", S.status_badge(status).alias("badge"))


@query(f"WITH {I.CLIPS} SELECT video, pos, lag(key) OVER w AS prev_key, lead(key) OVER w AS next_key FROM clips WINDOW w AS (PARTITION BY video ORDER BY pos)")
def clip_nav(spark, sf):
    w = Window.partitionBy("video").orderBy("pos")
    return I.clips(spark, sf).select("video", "pos", F.lag("key").over(w).alias("prev_key"), F.lead("key").over(w).alias("next_key"))


@query(f"WITH {I.CLIPS} SELECT video, key, suggested_caption FROM clips WHERE pos = 1")
def clip_pick(spark, sf):
    return I.clips(spark, sf).where("pos = 1").select("video", "key", "suggested_caption")


@query(f"""WITH {I.CLIPS}, k AS (SELECT c.* FROM clips c ANTI JOIN excluded e ON c.clip_id = e.clip_id)
SELECT video, pos, clip_id, duration_seconds, suggested_caption FROM k""")
def manifest_json(spark, sf):
    """Included clips written as JSON for each manifest and read back."""
    kept = manifest.included(I.clips(spark, sf), I.excluded(spark, sf)).select("video", "pos", F.col("pos").alias("at"), "clip_id", "duration_seconds", "suggested_caption")
    text = manifest.to_json(kept, "video")
    back = F.from_json("json", "struct<clips:array<struct<at:bigint,clip_id:bigint,duration_seconds:double,suggested_caption:string>>>")
    return text.select("video", F.inline(back["clips"])).withColumnRenamed("at", "pos")


@query("""SELECT o_orderkey, o_orderpriority AS title, '{"n":' || o_custkey || '}' AS extra, (o_orderkey % 3)::INT AS n_clips, CASE WHEN o_orderkey % 3 > 0 THEN 'x' || o_orderkey END AS first_note, len(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' ' END) AS indented FROM orders""")
def manifest_rendered(spark, sf):
    """A manifest without its excluded clip, read back: keys that the engine doesn't know stay."""
    k = F.col("o_orderkey")
    clip = lambda id_: F.to_json(F.struct(id_.alias("clip_id"), F.concat(F.lit("x"), k).alias("note")))
    clips = F.concat_ws(",", clip(k), *[F.when(k % 3 > n, clip(k + 1 + n)) for n in range(2)])
    raw = F.concat(F.lit('{"video_title": '), F.to_json(F.struct(F.col("o_orderpriority").alias("t"))), F.lit(', "extra": {"n": '), F.col("o_custkey"), F.lit('}, "clips": ['), clips, F.lit("]}"))
    text = manifest.rendered(raw, F.array(k))
    back = F.from_json("json", "struct<video_title:struct<t:string>,extra:struct<n:bigint>,clips:array<struct<clip_id:bigint,note:string>>>")
    made = I.table(spark, sf, "orders").select("o_orderkey", text.alias("json")).withColumn("b", back)
    return made.select("o_orderkey", F.col("b.video_title.t").alias("title"), F.to_json("b.extra").alias("extra"), F.size("b.clips").alias("n_clips"), F.get("b.clips", F.lit(0))["note"].alias("first_note"), F.col("json").contains('\n    {\n      "clip_id"').cast("long").alias("indented"))


_OTHERS = """SELECT 'own_' || o_orderkey % 4 AS key, CASE o_orderkey % 6 WHEN 0 THEN '7' WHEN 1 THEN '"t"' WHEN 2 THEN 'true' WHEN 3 THEN '[1, ' || o_orderkey || ']' WHEN 4 THEN '{"a": 1.5}' ELSE 'null' END AS value FROM orders WHERE o_orderkey % 7 > 0"""


@query(f"""WITH o AS ({_OTHERS}), k AS (SELECT key, CASE json_type(value::JSON) WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'VARCHAR' THEN 'STRING' WHEN 'NULL' THEN 'VOID' ELSE json_type(value::JSON) END AS kind FROM o)
SELECT key, kind, count(*) AS n, CASE kind WHEN 'ARRAY' THEN 'ARRAY<BIGINT>' WHEN 'OBJECT' THEN 'OBJECT<a: DECIMAL(2,1)>' ELSE kind END AS shape FROM k GROUP BY key, kind""")
def manifest_other_keys(spark, sf):
    """Keys of manifests that the engine doesn't know; some manifests are cut off, or no objects."""
    k = F.col("o_orderkey")
    values = ["7", '"t"', "true", None, '{"a": 1.5}', "null"]
    value = F.concat(F.lit("[1, "), k, F.lit("]"))
    for n, v in enumerate(values):
        value = F.when(k % 6 == n, F.lit(v)).otherwise(value) if v else value
    whole = F.concat(F.lit('{"video_title": "x", "clips": [], "own_'), k % 4, F.lit('": '), value, F.lit("}"))
    raw = F.when(k % 7 > 0, whole).when(k % 2 == 0, F.lit('{"cut": ')).when(k % 3 == 0, F.lit("[1]"))
    return manifest.other_keys(I.table(spark, sf, "orders").select(raw.alias("raw")))


# Captions


@query(f"""WITH {I.WORDS} SELECT clip_id, rn // 2 AS chunk, count(*) AS n_words, min("start") AS first_start, string_agg(replace(upper(word), 'ẞ', 'SS'), ' ' ORDER BY rn) AS text FROM words GROUP BY 1, 2""")
def word_chunks(spark, sf):
    c = captions.chunks(I.words(spark, sf))
    return c.select("clip_id", "chunk", F.size("words").cast("long").alias("n_words"), F.get("words", F.lit(0))["start"].alias("first_start"), F.array_join("words.word", " ").alias("text"))


_EVENTS = I.WORDS + r""",
u AS (SELECT *, replace(upper(word), 'ẞ', 'SS') AS t, lag(replace(upper(word), 'ẞ', 'SS')) OVER (PARTITION BY clip_id ORDER BY rn) AS p, lead(replace(upper(word), 'ẞ', 'SS')) OVER (PARTITION BY clip_id ORDER BY rn) AS n FROM words),
caption AS (SELECT clip_id, rn, "start", CASE WHEN "end" <= "start" THEN "start" + 0.01::DOUBLE ELSE "end" END AS "end",
  CASE WHEN rn % 2 = 0 THEN concat_ws(' ', '{\c&H0000FFFF}' || t || '{\c&H00FFFFFF}', n) ELSE concat_ws(' ', p, '{\c&H0000FFFF}' || t || '{\c&H00FFFFFF}') END AS text FROM u)"""


@query(f'WITH {_EVENTS} SELECT clip_id, rn, "start", "end", text FROM caption')
def caption_events(spark, sf):
    return captions.events(I.words(spark, sf))


@query(f"""WITH {_EVENTS} SELECT clip_id, rn AS ord, 'Dialogue: 0,' || {_TIME.format('"start"')} || ',' || {_TIME.format('"end"')} || ',Default,,0,0,0,,' || text AS line FROM caption""")
def ass_lines(spark, sf):
    return captions.lines(captions.events(I.words(spark, sf)))


@query(f"""WITH {I.WORDS} SELECT clip_id, rn, word, "start" - 1.0::DOUBLE AS at FROM words WHERE "start" >= 1.0 AND "start" < 1.0 + 0.5 * (1 + clip_id % 7)""")
def segment_range(spark, sf):
    """The words of a time range, which differs from clip to clip, with times counted from its start."""
    end = 1.0 + 0.5 * (1 + F.col("clip_id") % 7)
    return I.words(spark, sf).where((F.col("start") >= 1.0) & (F.col("start") < end)).select("clip_id", "rn", "word", (F.col("start") - 1.0).alias("at"))


# Faces


_BOX = "SELECT *, cx - 60 AS x1, cx + 60 AS x2, 400::DOUBLE AS y1, 400 + area / 120 - 40 AS y2 FROM faces"


@query(f"""WITH {I.FACES}, b AS ({_BOX}), g AS (SELECT *, (x2 - x1) * (y2 - y1) AS a FROM b), m AS (SELECT *, greatest(0, trunc(x1 + (x2 - x1) * 0.25::DOUBLE)::INT) AS l, least(1920, trunc(x1 + (x2 - x1) * 0.75::DOUBLE)::INT) AS r, greatest(0, trunc(y1 + (y2 - y1) * 0.6::DOUBLE)::INT) AS t, least(1080, trunc(y1 + (y2 - y1) * 0.95::DOUBLE)::INT) AS o FROM g WHERE a > 0)
SELECT clip_id, sample_idx, det, round((x1 + x2) / 2, 4) AS cx, round((y1 + y2) / 2, 4) AS cy, round(a, 4) AS area, CASE WHEN r > l AND o > t THEN l || ',' || t || ',' || r || ',' || o END AS mouth FROM m""")
def face_geometry(spark, sf):
    c = F.col("cx")
    boxes = I.faces(spark, sf).select("clip_id", "sample_idx", "det", (c - 60).alias("x1"), (c + 60).alias("x2"), F.lit(400.0).alias("y1"), (F.lit(400) + F.col("area") / 120 - 40).alias("y2"))
    m = S.mouth_box(*[F.col(x) for x in ("x1", "y1", "x2", "y2")], F.lit(I.SRC_W), F.lit(I.SRC_H))
    g = vision.with_geometry(boxes).withColumn("m", m)
    return g.select("clip_id", "sample_idx", "det", F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"), F.round("area", 4).alias("area"), F.when(F.col("m").isNotNull(), F.concat_ws(",", "m.x1", "m.y1", "m.x2", "m.y2")).alias("mouth"))


@query(f"WITH {I.FACES} SELECT clip_id, sample_idx, det, face_idx FROM faces")
def face_rank(spark, sf):
    f = vision.ranked(I.faces(spark, sf).drop("face_idx"))
    return f.select("clip_id", "sample_idx", "det", F.col("face_idx").cast("long").alias("face_idx"))


@query(f"WITH {I.PATH} SELECT clip_id, frame FROM frames WHERE frame % greatest(1, trunc(30 / 4)::INT) = 0")
def frame_sampling(spark, sf):
    return vision.sampled(I.frames(I.faces(spark, sf)), F.lit(I.FPS))


_SCORE = "CASE WHEN speaking < 3 THEN area * (0.75::DOUBLE + conf) ELSE (1 - 0.6::DOUBLE) * (area * (0.75::DOUBLE + conf)) + 0.6::DOUBLE * (area * (0.75::DOUBLE + conf)) * (1 + 3 * least(speaking / 20, 1)) END"


@query(f"WITH {I.FACES} SELECT clip_id, sample_idx, face_idx, round({_SCORE}, 6) AS score FROM faces")
def face_score(spark, sf):
    score = S.face_score(F.col("area"), F.col("conf"), F.col("speaking"))
    return I.faces(spark, sf).select("clip_id", "sample_idx", "face_idx", F.round(score, 6).alias("score"))


@query(f"WITH {I.FACES}, s AS (SELECT *, {_SCORE} AS score FROM faces) SELECT clip_id, sample_idx, face_idx, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY clip_id, sample_idx ORDER BY score DESC, face_idx) = 1")
def best_face(spark, sf):
    return vision.best(I.faces(spark, sf)).select("clip_id", "sample_idx", "face_idx", F.round("score", 6).alias("score"))


@query(f"WITH {I.FACES} SELECT clip_id, sample_idx, face_idx, cx FROM faces WHERE abs(cx - 960) <= 212.45::DOUBLE QUALIFY row_number() OVER (PARTITION BY clip_id, sample_idx ORDER BY abs(cx - 960), face_idx) = 1")
def nearest_face(spark, sf):
    return vision.nearest(I.faces(spark, sf), F.lit(960.0), F.lit(212.45)).select("clip_id", "sample_idx", "face_idx", "cx")


@query(f"WITH {I.FACES} SELECT clip_id, sample_idx, count(*) FILTER (abs(cx - 960) <= 212.45::DOUBLE) AS near, count(*) FILTER (abs(cx - 960) > 212.45::DOUBLE) AS far FROM faces GROUP BY ALL")
def near_far_faces(spark, sf):
    near = F.abs(F.col("cx") - 960.0) <= 212.45
    return I.faces(spark, sf).groupBy("clip_id", "sample_idx").agg(F.count_if(near).alias("near"), F.count_if(~near).alias("far"))


@query(f"WITH {I.PATH} SELECT clip_id, count(*) AS n_samples, count(*) FILTER (n_faces > 0) AS with_faces, sum(n_faces)::BIGINT AS n_faces FROM samples GROUP BY clip_id")
def detection_stats(spark, sf):
    return vision.detection_stats(I.samples(I.faces(spark, sf)))


@query("SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 30 END AS fps, greatest(1, trunc(CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 30 END / 4)::INT) AS every FROM supplier")
def safe_fps(spark, sf):
    fps = S.safe_fps(F.col("s_acctbal"))
    return I.table(spark, sf, "supplier").select("s_suppkey", fps.alias("fps"), S.sampling_interval(fps).alias("every"))


# Cuts


_HIST = """h AS (SELECT vec_id % 20 AS clip_id, vec_id AS frame, list_transform(embedding, lambda x: abs(x)) AS a FROM embeddings),
d AS (SELECT clip_id, frame, a, lag(a) OVER (PARTITION BY clip_id ORDER BY frame) AS b FROM h),
x AS (SELECT clip_id, frame, CASE WHEN b IS NOT NULL THEN sqrt(greatest(0, 1 - list_sum(list_transform(list_zip(b, a), lambda p: sqrt(p[1]::DOUBLE * p[2]::DOUBLE))) / sqrt(list_sum(list_transform(b, lambda v: v::DOUBLE)) * list_sum(list_transform(a, lambda v: v::DOUBLE))))) END AS hist_diff FROM d)"""


def _hists(spark, sf):
    e = I.table(spark, sf, "embeddings")
    return cuts.distances(e.select((F.col("vec_id") % 20).alias("clip_id"), F.col("vec_id").alias("frame"), F.transform("embedding", F.abs).alias("hist")))


@query(f"WITH {_HIST} SELECT clip_id, frame, round(hist_diff, 6) AS hist_diff FROM x")
def hist_distance(spark, sf):
    return _hists(spark, sf).select("clip_id", "frame", F.round("hist_diff", 6).alias("hist_diff"))


@query(f"""WITH {_HIST}, p AS (SELECT *, (frame % 40) / 100::DOUBLE AS pixel, 0.6::DOUBLE * hist_diff + 0.4::DOUBLE * ((frame % 40) / 100::DOUBLE) AS score FROM x)
SELECT clip_id, frame FROM p WHERE (score >= 0.22::DOUBLE AND hist_diff >= 0.14::DOUBLE AND pixel >= 0.08::DOUBLE) OR (hist_diff >= 0.45::DOUBLE AND score >= 0.22::DOUBLE) OR (pixel >= 0.22::DOUBLE AND hist_diff >= 0.75::DOUBLE * 0.14::DOUBLE)""")
def cut_candidates(spark, sf):
    return _hists(spark, sf).where(S.is_cut(F.col("hist_diff"), (F.col("frame") % 40) / 100)).select("clip_id", "frame")


@query("""WITH RECURSIVE c AS (SELECT user_id AS clip_id, frame, row_number() OVER (PARTITION BY user_id ORDER BY frame) AS rn FROM (SELECT DISTINCT user_id, date_diff('hour', TIMESTAMP '1970-01-01', ts) AS frame FROM events)),
f AS (SELECT clip_id, rn, frame, frame AS kept, TRUE AS ok FROM c WHERE rn = 1
  UNION ALL SELECT c.clip_id, c.rn, c.frame, CASE WHEN c.frame - f.kept >= 240 THEN c.frame ELSE f.kept END, c.frame - f.kept >= 240 FROM f JOIN c ON c.clip_id = f.clip_id AND c.rn = f.rn + 1)
SELECT clip_id, frame FROM f WHERE ok""")
def cut_refractory(spark, sf):
    """Events thinned to one in ten days for each user, counted from the last one kept; hours stand for frames."""
    e = I.table(spark, sf, "events").select(F.col("user_id").alias("clip_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("frame"))
    return cuts.refractory(e, 240)


@query(f"WITH {I.PATH}, {I.MEDIA} SELECT clip_id, count(*) AS n FROM cuts JOIN media USING (clip_id) WHERE frame > 0 AND frame < total_frames GROUP BY clip_id")
def cut_count(spark, sf):
    """Cuts within each clip, up to its own last frame."""
    f = I.faces(spark, sf)
    return I.cuts(f).join(I.media(f), "clip_id").where("frame > 0 and frame < total_frames").groupBy("clip_id").agg(F.count("*").alias("n"))


@query(f"WITH {I.PATH}, l AS (SELECT *, coalesce(lag(frame) OVER (PARTITION BY clip_id ORDER BY frame), -1) AS before FROM samples) SELECT clip_id, sample_idx, frame, EXISTS (SELECT 1 FROM cuts c WHERE c.clip_id = l.clip_id AND c.frame > before AND c.frame <= l.frame) AS reset FROM l")
def sample_cut_reset(spark, sf):
    f = I.faces(spark, sf)
    return cuts.with_reset(I.samples(f).drop("n_faces"), I.cuts(f), I.media(f))


@query("SELECT hour(ts)::INT AS h, least(31, trunc(value / 16)::INT) AS bin, count(*) AS n, sqrt(sum(count(*) * count(*)) OVER ())::DOUBLE AS norm FROM events GROUP BY 1, 2")
def hist_2d(spark, sf):
    h = I.table(spark, sf, "events").groupBy(F.hour("ts").alias("h"), F.least(F.lit(31), (F.col("value") / 16).cast("int")).alias("bin")).agg(F.count("*").alias("n"))
    return h.withColumn("norm", F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy()).cast("double")))


@query("""WITH b AS (SELECT least(31, hour(ts) * 32 // 24)::INT AS h, least(31, trunc(value / 16)::INT) AS s, count(*) AS n FROM events GROUP BY 1, 2) SELECT h, s, round(n / sqrt(sum(n * n) OVER ()), 9) AS share FROM b""")
def hist_2d_normalised(spark, sf):
    """A histogram of 32 by 32 bins, scaled so that its squares add up to one."""
    h = I.table(spark, sf, "events").groupBy(F.least(F.lit(31), F.floor(F.hour("ts") * 32 / 24).cast("int")).alias("h"), F.least(F.lit(31), (F.col("value") / 16).cast("int")).alias("s")).agg(F.count("*").alias("n"))
    return h.select("h", "s", F.round(F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy()).cast("double")), 9).alias("share"))


_SCENES = """WITH RECURSIVE e AS (SELECT vec_id % 20 AS clip_id, vec_id // 20 AS frame, list_transform(embedding, lambda x: abs(x)) AS a, list_transform(embedding, lambda x: abs(x)::DOUBLE * 2000) AS p FROM embeddings),
d AS (SELECT clip_id, frame, a, p, lag(a) OVER w AS b, lag(p) OVER w AS q FROM e WINDOW w AS (PARTITION BY clip_id ORDER BY frame)),
x AS (SELECT clip_id, frame, sqrt(greatest(0, 1 - list_sum(list_transform(list_zip(b, a), lambda z: sqrt(z[1]::DOUBLE * z[2]::DOUBLE))) / sqrt(list_sum(list_transform(b, lambda v: v::DOUBLE)) * list_sum(list_transform(a, lambda v: v::DOUBLE))))) AS hist_diff,
  list_sum(list_transform(list_zip(q, p), lambda z: abs(z[1] - z[2]))) / len(p) / 255 AS pixel FROM d WHERE b IS NOT NULL),
y AS (SELECT *, 0.6::DOUBLE * hist_diff + 0.4::DOUBLE * pixel AS score FROM x),
c AS (SELECT clip_id, frame, row_number() OVER (PARTITION BY clip_id ORDER BY frame) AS rn, CASE clip_id % 3 WHEN 0 THEN 9 WHEN 1 THEN 7 ELSE 18 END AS gap FROM y
  WHERE (score >= 0.22::DOUBLE AND hist_diff >= 0.14::DOUBLE AND pixel >= 0.08::DOUBLE) OR (hist_diff >= 0.45::DOUBLE AND score >= 0.22::DOUBLE) OR (pixel >= 0.22::DOUBLE AND hist_diff >= 0.75::DOUBLE * 0.14::DOUBLE)),
f AS (SELECT clip_id, rn, frame, frame AS kept, TRUE AS ok FROM c WHERE rn = 1 UNION ALL SELECT c.clip_id, c.rn, c.frame, CASE WHEN c.frame - f.kept >= gap THEN c.frame ELSE f.kept END, c.frame - f.kept >= gap FROM f JOIN c ON c.clip_id = f.clip_id AND c.rn = f.rn + 1)
SELECT clip_id, frame FROM f WHERE ok"""


@query(_SCENES)
def scene_cuts(spark, sf):
    """From features of frames to accepted cuts, in clips with 30 (or no), 25 and 60 frames a second."""
    e = I.table(spark, sf, "embeddings")
    k = F.col("vec_id") % 20
    features = e.select(k.alias("clip_id"), F.floor(F.col("vec_id") / 20).alias("frame"), F.transform("embedding", F.abs).alias("hist"), F.transform("embedding", lambda x: F.abs(x).cast("double") * 2000).alias("gray"))
    media = e.select(k.alias("clip_id"), F.when(k % 3 == 0, 0.0).when(k % 3 == 1, 25.0).otherwise(60.0).alias("fps")).distinct()
    return cuts.scene_cuts(features, media)


@query()
def pixel_differences(spark, sf):
    """How much each frame differs from the one before it, from its pixels."""
    found = pixels.differences(pixels.features(I.pixels(spark, sf)))
    return found.select("clip_id", "frame", F.round("hist_diff", 6).alias("hist_diff"), F.round("pixel_diff", 6).alias("pixel_diff"))


@query()
def pixel_cuts(spark, sf):
    """Scene cuts from pixels, in clips with 30 (or no), 25 and 60 frames a second."""
    frames = I.pixels(spark, sf)
    k = F.col("clip_id") % 3
    media = I.table(spark, sf, "embeddings").select((F.col("vec_id") % 20).alias("clip_id")).distinct().withColumn("fps", F.when(k == 0, 0.0).when(k == 1, 25.0).otherwise(60.0))
    return pixels.scene_cuts(frames, media)


@query(f"WITH {I.AUDIO} SELECT clip_id, n, CASE WHEN abs(value * 32768) < 5e-4 THEN 0 ELSE round(value * 32768, 3) END::DOUBLE AS level FROM audio")
def speech_audio(spark, sf):
    """Audio in several rates and channels as 16 kHz, mono, in steps of 16 bits."""
    level = F.col("value") * audio.FULL
    found = audio.speech_audio(I.audio(spark, sf), 200)
    each = found.select("clip_id", "first", F.posexplode("samples").alias("k", "value"))
    return each.select("clip_id", (F.col("first") + F.col("k")).alias("n"), F.when(F.abs(level) < 5e-4, 0.0).otherwise(F.round(level, 3)).alias("level"))


# Sequences


@query(f"WITH {I.FACES} SELECT clip_id, sample_idx, det, round(avg(speaking) OVER (PARTITION BY clip_id, det ORDER BY sample_idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 6) AS mean FROM faces")
def rolling_motion(spark, sf):
    n = S.smoothing_window(I.FPS)
    w = Window.partitionBy("clip_id", "det").orderBy("sample_idx").rowsBetween(-(n - 1), 0)
    return I.faces(spark, sf).select("clip_id", "sample_idx", "det", F.round(F.avg("speaking").over(w), 6).alias("mean"))


@query(f"WITH {I.FACES} SELECT clip_id, sample_idx, det, count(*) FILTER (k >= 50) OVER (PARTITION BY clip_id ORDER BY frame RANGE BETWEEN 120 PRECEDING AND CURRENT ROW) AS n FROM faces")
def burst_history(spark, sf):
    w = Window.partitionBy("clip_id").orderBy("frame").rangeBetween(-120, 0)
    return I.faces(spark, sf).select("clip_id", "sample_idx", "det", F.count_if(F.col("k") >= 50).over(w).alias("n"))


@query(f"WITH {I.PATH} SELECT clip_id, frame FROM cuts UNION SELECT clip_id, frame FROM keys WHERE hard")
def cut_union(spark, sf):
    f = I.faces(spark, sf)
    return path.all_cuts(I.cuts(f), I.keys(f))


@query(f"WITH {I.PATH}, k AS (SELECT clip_id, seq, frame // 28 * 28 AS frame, cx, hard FROM keys) SELECT clip_id, frame, arg_max(cx, seq) AS cx, bool_or(hard) AS hard FROM k GROUP BY clip_id, frame")
def keyframe_dedupe(spark, sf):
    k = I.keys(I.faces(spark, sf)).withColumn("frame", F.floor(F.col("frame") / 28) * 28)
    return path.deduplicated(k)


_FRAMES = """,
allcuts AS (SELECT clip_id, frame FROM cuts UNION SELECT clip_id, frame FROM keys WHERE hard),
t0 AS (SELECT f.clip_id, f.frame, k.cx AS key, c.frame IS NOT NULL AND f.frame > 0 AS is_cut FROM frames f LEFT JOIN keys k ON k.clip_id = f.clip_id AND k.frame = f.frame LEFT JOIN allcuts c ON c.clip_id = f.clip_id AND c.frame = f.frame),
t1 AS (SELECT *, sum(is_cut::INT) OVER (PARTITION BY clip_id ORDER BY frame) AS seg FROM t0),
t2 AS (SELECT *, last_value(CASE WHEN key IS NOT NULL THEN {'f': frame, 'k': key, 's': seg} END IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
  first_value(CASE WHEN key IS NOT NULL THEN {'f': frame, 'k': key, 's': seg} END IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM t1),
t3 AS (SELECT *, (frame - p.f) / (n.f - p.f)::DOUBLE AS t FROM t2),
targets AS (SELECT clip_id, frame, is_cut, CASE WHEN p.s = seg AND n.s = seg AND n.f > p.f THEN p.k + (n.k - p.k) * (t * t * (3 - 2 * t)) WHEN p.s = seg THEN p.k WHEN n.s = seg THEN n.k ELSE coalesce(p.k, 960) END AS cx FROM t3)"""
_TARGETS = I.PATH + _FRAMES


def _pieces(spark, sf):
    return path.pieces(I.marks(I.faces(spark, sf)), F.lit(I.SRC_W / 2))


@query(f"WITH {_TARGETS} SELECT clip_id, frame, is_cut, round(cx, 4) AS cx FROM targets")
def interpolate_targets(spark, sf):
    return path.interpolated(_pieces(spark, sf)).withColumn("cx", F.round("cx", 4))


_STEPS = """,
g AS (SELECT 42.49::DOUBLE AS dz, 16::DOUBLE AS vmax, 1 - exp(-1 / 13.5::DOUBLE) AS alpha),
s AS (SELECT clip_id, frame, cx AS c, FALSE AS jump FROM targets WHERE frame = 0
 UNION ALL SELECT t.clip_id, t.frame, CASE WHEN t.is_cut THEN t.cx WHEN abs(t.cx - s.c) <= dz THEN s.c ELSE s.c + least(greatest((t.cx - sign(t.cx - s.c) * dz - s.c) * alpha, -vmax), vmax) END,
  t.is_cut AND abs(t.cx - s.c) > dz FROM s JOIN targets t ON t.clip_id = s.clip_id AND t.frame = s.frame + 1, g)"""
_SMOOTH = "WITH RECURSIVE " + _TARGETS + _STEPS
_CROP = "WITH RECURSIVE " + I.FOCUS + _FRAMES + _STEPS


def _smoothed(spark, sf, **asked):
    return path.smoothed(_pieces(spark, sf), **asked)


def _held(spark, sf):
    made = _smoothed(spark, sf, jumps=False, keep=("src_w", "src_h", "total_frames"))
    return path.held(made, F.col("src_w"), F.col("src_h"))


@query(f"{_SMOOTH} SELECT clip_id, frame, round(c, 4) AS cx, jump FROM s")
def smooth_path(spark, sf):
    return _smoothed(spark, sf).withColumn("cx", F.round("cx", 4))


@query(f"{_SMOOTH} SELECT clip_id, count(*) FILTER (jump) AS jumps FROM s GROUP BY clip_id")
def hard_jumps(spark, sf):
    return _smoothed(spark, sf).groupBy("clip_id").agg(F.count_if("jump").alias("jumps"))


@query(f"{_SMOOTH} SELECT clip_id, frame, greatest(0, least(trunc(least(greatest(c, 303.5), 1616.5) - 303.5)::INT, 1313)) AS x, 607 AS width FROM s")
def crop_windows(spark, sf):
    return path.crop_windows(_held(spark, sf), F.col("src_w"), F.col("src_h"))


@query(f"""{_SMOOTH}, m AS (SELECT clip_id, max(frame) AS last FROM s GROUP BY clip_id), o AS (SELECT clip_id, unnest(generate_series(0, last + clip_id % 5)) AS frame, last FROM m)
SELECT o.clip_id, o.frame, greatest(0, least(trunc(least(greatest(c, 303.5), 1616.5) - 303.5)::INT, 1313)) AS x, 607 AS width FROM o JOIN s ON s.clip_id = o.clip_id AND s.frame = least(o.frame, last)""")
def output_windows(spark, sf):
    """Windows of the frames that are decoded, some of which may lie past the path's end: the last centre holds there."""
    made = path.padded(_held(spark, sf), F.col("total_frames") + F.col("clip_id") % 5)
    return path.crop_windows(made, F.col("src_w"), F.col("src_h"))


@query(f"WITH {I.FACES}, {I.MEDIA} SELECT clip_id, src_w, src_h, CASE WHEN fps > 0 THEN fps ELSE 30 END::DOUBLE AS fps, total_frames FROM media")
def clip_media(spark, sf):
    """Size, rate and frames of each clip; a rate that is missing is 30."""
    return I.media(I.faces(spark, sf), False).withColumn("fps", S.safe_fps(F.col("fps")))


def _samples(spark, sf, fixed=True):
    """Tracks, speech and focus of every sample, in one reading and one shuffle by clip."""
    return crop.samples(I.timeline(I.faces(spark, sf), fixed))


@query(f"WITH RECURSIVE {I.SPOKEN} SELECT clip_id, sample_idx, face_idx, track FROM spoken")
def track_assign(spark, sf):
    return crop.spoken(_samples(spark, sf)).drop("speaking")


@query(f"WITH RECURSIVE {I.SPOKEN} SELECT clip_id, sample_idx, face_idx, track, speaking FROM spoken")
def speaking_scores(spark, sf):
    """Tracks and speech of faces."""
    return crop.spoken(_samples(spark, sf))


@query(f"WITH RECURSIVE {I.FOCUS} SELECT clip_id, seq, frame, cx, hard, reset, change FROM keys")
def focus_keyframes(spark, sf):
    """Key frames of the focus."""
    return crop.keys(_samples(spark, sf))


@query(f"{_CROP} SELECT clip_id, frame, round(least(greatest(c, 303.5), 1616.5), 4) AS cx FROM s")
def crop_path(spark, sf):
    """The whole way from faces to crop centres."""
    return crop.paths(_samples(spark, sf)).select("clip_id", "frame", F.round("cx", 4).alias("cx"))


@query(f"""{_CROP} SELECT clip_id, target_keyframes, source_cut_resets, smooth_focus_changes, hard_crop_jumps, coalesce(scene_cuts, 0) AS scene_cuts
FROM (SELECT clip_id, count(*) AS target_keyframes, count(*) FILTER (reset) AS source_cut_resets, count(*) FILTER (change) AS smooth_focus_changes FROM keys GROUP BY clip_id)
JOIN (SELECT clip_id, count(*) FILTER (jump) AS hard_crop_jumps FROM s GROUP BY clip_id) USING (clip_id) LEFT JOIN (SELECT clip_id, count(*) AS scene_cuts FROM cuts GROUP BY clip_id) USING (clip_id)""")
def crop_stats(spark, sf):
    """Counts of each clip's crop path."""
    return crop.stats(_samples(spark, sf))


@query(f"{I.by_rate(_CROP)} SELECT s.clip_id, frame, greatest(0, least(trunc(least(greatest(c, half), src_w - half) - half)::INT, src_w - w))::INT AS x, w AS width FROM s JOIN rates USING (clip_id)")
def clip_pipeline(spark, sf):
    """Crop windows of every frame of clips that differ in size and rate."""
    return path.crop_windows(crop.paths(_samples(spark, sf, False)), F.col("src_w"), F.col("src_h"))


@query(rf"""WITH {I.WORDS}, {I.FACES}, {I.MEDIA}, said AS (SELECT clip_id, count(*) AS n FROM words GROUP BY clip_id)
SELECT clip_id, src_w, src_h, CASE WHEN fps > 0 THEN fps ELSE 30 END::DOUBLE AS fps, total_frames::INT AS n_windows, coalesce(n, 0)::BIGINT AS n_lines, concat_ws(',', 'ass=out/clip_' || clip_id || '.ass', 'drawtext=text=''Talks''{render.CHANNEL}', CASE WHEN clip_id % 2 = 1 THEN 'drawtext=text=''by ' || clip_id || '''{render.CREDIT}' END) AS graph, 'out/clip_' || clip_id || '.mp4' AS path FROM media LEFT JOIN said USING (clip_id)""")
def render_jobs(spark, sf):
    """What the encoder gets for each clip: size, rate, windows, subtitle lines, filter graph and path."""
    said = captions.lines(captions.events(I.words(spark, sf))).groupBy("clip_id").agg(F.count("line").alias("n_lines"))
    k = F.col("clip_id").cast("string")
    graph = render.filter_graph(F.concat(F.lit("out/clip_"), k, F.lit(".ass")), F.lit("Talks"), F.when(F.col("clip_id") % 2 == 1, F.concat(F.lit("by "), k)))
    # Each frame has a window, so their number needs no path.
    jobs = clip_media(spark, sf).select("clip_id", "src_w", "src_h", "fps", F.col("total_frames").cast("int").alias("n_windows")).join(said, "clip_id", "left")
    return jobs.withColumns({"n_lines": F.coalesce("n_lines", F.lit(0)), "graph": graph, "path": S.output_path(F.lit("out"), F.concat(F.lit("clip "), k))})


@query("SELECT s_suppkey, round(1 - exp(-1 / greatest(CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 30 END * 0.45::DOUBLE, 1)), 9) AS alpha, greatest(1, trunc(CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 30 END * 0.3::DOUBLE)::INT) AS gap FROM supplier")
def rate_settings(spark, sf):
    """What follows from a clip's frames per second: the weight of smoothing and the least gap of cuts."""
    fps = S.safe_fps(F.col("s_acctbal"))
    return I.table(spark, sf, "supplier").select("s_suppkey", F.round(S.smoothing_alpha(fps), 9).alias("alpha"), S.cut_gap(fps).alias("gap"))


#: Every seventh document has an empty line and one of white space only.
_LOG = "replace(CASE WHEN doc_id % 7 = 0 THEN text || chr(10) || chr(10) || '  ' || chr(160) || chr(10) || 'end' ELSE text END, chr(10), chr(13))"


def _logs(spark, sf):
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\n\n  \u00a0\nend"))).otherwise(F.col("text"))
    return I.table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.translate(text, "\n", "\r").alias("raw"))


_TAIL_SQL = rf"""WITH l AS (SELECT doc_id AS seq, unnest(string_split(regexp_replace({_LOG}, '\n+$', ''), chr(13))) AS line, generate_subscripts(string_split(regexp_replace({_LOG}, '\n+$', ''), chr(13)), 1) - 1 AS part FROM documents),
t AS (SELECT * FROM l ORDER BY seq DESC, part DESC LIMIT 350)
SELECT seq, part::INT AS part, CASE WHEN line = '' THEN '&nbsp;' ELSE {_HTML.format("line")} END AS line FROM t"""


@query(_TAIL_SQL)
def log_tail(spark, sf):
    """The last 350 lines: the limit is the report's own."""
    raw = _logs(spark, sf)
    return logs.tail(logs.log_lines(raw))


@query(f"""WITH shown AS ({_TAIL_SQL}), n AS (SELECT sum(len(string_split(regexp_replace({_LOG}, '\\n+$', ''), chr(13))))::BIGINT AS n FROM documents)
SELECT row_number() OVER (ORDER BY seq DESC, part DESC) - 1 AS place, line FROM shown UNION ALL SELECT 350, printf('{logs.NOTE}', n - 350) FROM n WHERE n > 350 UNION ALL SELECT 0, '{logs.NOTHING}' FROM n WHERE n IS NULL""")
def log_card(spark, sf):
    """The log as it is shown: newest lines first, and a note on those before."""
    return logs.card(logs.log_lines(_logs(spark, sf)))


@query(f"SELECT greatest(0, sum(len(string_split(regexp_replace({_LOG}, '\n+$', ''), chr(13)))) - 350)::BIGINT AS hidden FROM documents")
def log_hidden(spark, sf):
    """How many lines the tail of the log leaves out."""
    raw = _logs(spark, sf)
    return logs.hidden(logs.log_lines(raw)).select("hidden")
