"""Captions: words into chunks, events and subtitle lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelframe.config import DEFAULT
from reelframe.functions.scalars import caption_time, stripped
from reelframe.sources.subtitles import registered

# Colours of the format, and the head of a subtitle file.
WHITE, YELLOW = "&H00FFFFFF", "&H0000FFFF"
HEADER = """[Script Info]
ScriptType: v4.00+
PlayResX: 608
PlayResY: 1080

[V4+ Styles]
Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding
Style: Default,Impact,64,&H00FFFFFF,&H0000FFFF,&H00000000,&HCC000000,-1,0,0,0,100,100,0,0,1,4,3,2,10,10,450,1

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"""


def numbered(words: DataFrame) -> DataFrame:
    """Words of a clip with rn, their number over all its segments."""
    by = Window.partitionBy("clip_id").orderBy("seg_idx", "word_idx")
    return words.withColumn("rn", (F.row_number().over(by) - 1).cast("long"))


def chunks(words: DataFrame, size: int = DEFAULT.words_per_caption) -> DataFrame:
    """(clip_id, chunk, words, first, last) of numbered words, so many to a chunk, across segments."""
    listed = F.array_sort(F.collect_list(F.struct("rn", F.upper(stripped(F.col("word"))).alias("word"), "start", "end")))
    grouped = words.groupBy("clip_id", F.floor(F.col("rn") / size).alias("chunk")).agg(listed.alias("words"))
    return grouped


def events(words: DataFrame, size: int = DEFAULT.words_per_caption) -> DataFrame:
    """(clip_id, rn, start, end, text): one event for each word, its chunk with the word marked.

    An event that would end no later than it starts lasts a hundredth of a second. Neighbours come from the same
    sorted window that numbers the words, so a clip is shuffled once.
    """
    by = Window.partitionBy("clip_id").orderBy("rn")
    text = F.upper(stripped(F.col("word")))
    parts = []
    for k in range(size):
        # The word at place k of this word's chunk: so many rows away.
        at = F.coalesce(*[F.when(F.col("rn") % size == j, (F.lag(text, j - k).over(by) if j >= k else F.lead(text, k - j).over(by))) for j in range(size)])
        marked = F.concat(F.lit("{\\c" + YELLOW + "}"), at, F.lit("{\\c" + WHITE + "}"))
        parts.append(F.when(F.col("rn") % size == k, marked).otherwise(at))
    end = F.when(F.col("end") <= F.col("start"), F.col("start") + 0.01).otherwise(F.col("end"))
    return words.select("clip_id", "rn", "start", end.alias("end"), F.concat_ws(" ", *parts).alias("text"))


def lines(events_: DataFrame) -> DataFrame:
    """(clip_id, ord, line) of the subtitle format: events in order; the header, with ord -1, is write_subtitles()'s."""
    line = F.concat(F.lit("Dialogue: 0,"), caption_time(F.col("start")), F.lit(","), caption_time(F.col("end")), F.lit(",Default,,0,0,0,,"), F.col("text"))
    return events_.select("clip_id", F.col("rn").alias("ord"), line.alias("line"))


def write_subtitles(events_: DataFrame, path: str, overwrite: bool = True) -> None:
    """A file clip_<id>.ass for each clip, header first; all of them or none. Without overwrite the files of other clips
    stay. A clip without an id has no file."""
    body = lines(events_).where("clip_id is not null")
    head = body.select("clip_id").distinct().select("clip_id", F.lit(-1).cast("long").alias("ord"), F.lit(HEADER).alias("line"))
    whole = body.unionByName(head).repartition("clip_id").sortWithinPartitions("clip_id", "ord")
    whole.select(F.col("clip_id").cast("long"), F.col("ord").cast("long"), "line").write.format(registered(whole.sparkSession)).mode("overwrite" if overwrite else "append").save(path)
