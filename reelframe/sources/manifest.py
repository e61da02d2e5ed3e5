"""Manifests: reading, checking, filtering and writing lists of clips."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelframe.functions.scalars import has_suffix, stripped
from reelframe.sources.steps import kept

CLIP = "struct<clip_id:bigint,start_time:string,end_time:string,duration_seconds:double,speaker:string,viral_score:double,category:string,hook:string,summary:string,suggested_caption:string>"
MANIFEST = f"struct<video_title:string,video_duration:string,clips:array<{CLIP}>>"
VIDEO_SUFFIXES = (".mp4", ".mkv", ".mov", ".avi")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw) of JSON files, each one manifest."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("raw"))


def video_files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of the videos in a folder, in order; contents are not read."""
    return spark.read.format("binaryFile").load(folder).where(has_suffix(F.col("path"), VIDEO_SUFFIXES)).select("path").orderBy("path")


def validated(raw: Column) -> Column:
    """ok, empty (blank text), malformed (no JSON object) or no_clips; null text is blank."""
    doc = F.try_parse_json(raw)
    clips = F.from_json(raw, MANIFEST)["clips"]
    blank = stripped(F.coalesce(raw, F.lit(""))) == ""
    return F.when(blank, "empty").when(doc.isNull() | ~F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False)), "malformed").when(F.coalesce(F.size(clips), F.lit(0)) < 1, "no_clips").otherwise("ok")


def clips_of(manifests: DataFrame) -> DataFrame:
    """One row for each clip of the manifests' column raw, with its 0-based place; other columns stay."""
    parsed = manifests.withColumn("__m", F.from_json("raw", MANIFEST))
    return parsed.select(*[c for c in manifests.columns if c != "raw"], F.posexplode("__m.clips").alias("pos", "clip")).select("*", "clip.*").drop("clip")


def with_defaults(clips: DataFrame) -> DataFrame:
    """The table of clips as it is shown; a null counts as absent."""
    empty = F.lit("")
    return clips.withColumns({"shown_id": F.coalesce("clip_id", F.col("pos") + 1), "start_time": F.coalesce("start_time", empty), "end_time": F.coalesce("end_time", empty), "duration_seconds": F.coalesce("duration_seconds", F.lit(0.0)), "speaker": F.coalesce("speaker", empty), "viral_score": F.coalesce("viral_score", F.lit(0.0)), "suggested_caption": F.coalesce("suggested_caption", empty)})


def included(clips: DataFrame, excluded: DataFrame) -> DataFrame:
    """The clips whose clip_id is not among the excluded ones; a clip without an id always stays."""
    return clips.join(excluded.select("clip_id").distinct(), "clip_id", "left_anti")


def to_json(clips: DataFrame, group: str) -> DataFrame:
    """(group, json): each manifest's clips in order as one JSON text, keys with nulls left out."""
    fields = [c for c in clips.columns if c not in (group, "pos")]
    listed = F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("clip"))))
    return clips.groupBy(group).agg(listed.alias("c")).select(group, F.to_json(F.struct(F.col("c.clip").alias("clips"))).alias("json"))


#: Keys that the engine itself reads from a manifest.
OWN_KEYS = ("video_title", "video_duration", "clips")


def other_keys(manifests: DataFrame, own: tuple[str, ...] = OWN_KEYS) -> DataFrame:
    """(key, kind, n, shape) of the keys in manifests (raw) that the engine doesn't read: how many have them with a value of
    which kind (STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, ARRAY, OBJECT or VOID), and the shape that all values of the key and
    kind fit. Texts that are no JSON object have none.
    """
    doc = F.try_parse_json("raw")
    values = F.try_variant_get(doc, "$", "map<string,variant>")
    each = manifests.select(F.explode(values).alias("key", "value")).where(~F.col("key").isin(*own))
    kind = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
    return each.groupBy("key", kind.alias("kind")).agg(F.count("*").alias("n"), F.schema_of_variant_agg("value").alias("shape"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _rendered(raw: str | None, excluded: list | None) -> str | None:
    """Indented JSON of a manifest without the excluded clips; every other key and value stays, in its order."""
    try:
        doc = json.loads(raw or "")
        if not isinstance(doc, dict) or not isinstance(doc.get("clips"), list):
            return None
        out = list(excluded or [])
        kept = [c for c in doc["clips"] if not isinstance(c, dict) or c.get("clip_id") is None or c["clip_id"] not in out]
        return json.dumps({**doc, "clips": kept}, ensure_ascii=False, indent=2).encode("utf-8", "replace").decode()
    except (ValueError, RecursionError):
        # No JSON, or nested too deeply to be read. Half a surrogate pair, which JSON may name, becomes a question mark.
        return None


def rendered(raw: Column, excluded: Column) -> Column:
    """The manifest's text to render from: without the clips whose ids are in excluded (an array). Null where the text
    is no manifest or nested too deeply; an id that is a list or an object is among none. Values keep their kinds and keys their order, so each text is parsed and written by a small helper."""

    def of(texts: pa.Array, ids: pa.Array) -> pa.Array:
        return pa.array([_rendered(t, i) for t, i in zip(texts.to_pylist(), ids.to_pylist(), strict=True)], pa.string())

    return F.arrow_udf(of, "string")(raw, excluded)


def numbered(listing: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows with their place from 1 in the given order, in which no two are equal.

    The rows are sorted by ranges, as many as there are shuffle partitions, and kept; a row's place is the one in its
    partition after the counts of the partitions before it, which are all that is in one place.
    """
    sorted_ = kept(listing.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).alias("__part")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = sorted_.groupBy(part).agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    place = F.col("__at").bitwiseAND((1 << 33) - 1) + F.col("__before") + 1
    return sorted_.withColumn("__part", part).join(F.broadcast(counts), "__part").withColumn(name, place.cast("long")).drop("__part", "__at", "__before")
