"""Logs: raw output into lines, and the last of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelframe.functions.scalars import escape_html

TAIL = 350


def log_lines(raw: DataFrame) -> DataFrame:
    """(seq, part, line) of rows (seq, raw): a carriage return begins a new line too."""
    parts = F.split(F.regexp_replace("raw", r"\n+$", ""), "\r")
    return raw.select("seq", F.posexplode(parts).alias("part", "line"))


def tail(lines: DataFrame, most: int = TAIL) -> DataFrame:
    """The last lines, the newest first, as HTML text. The sort keeps so many rows in each task."""
    last = lines.orderBy(F.col("seq").desc(), F.col("part").desc()).limit(most)
    return last.select("seq", "part", escape_html(F.col("line")).alias("line"))


# The wording of the note on hidden lines, and the line of a log without any.
NOTE, NOTHING = "... %d baris sebelumnya disembunyikan dari live view ...", "Menunggu output dari script.py..."


def card(lines: DataFrame, most: int = TAIL) -> DataFrame:
    """(place, line) as a live log shows them: the last lines, the newest at place 0, and after them the note on those before;
    a log without lines has one that says so."""
    newest = Window.orderBy(F.col("seq").desc(), F.col("part").desc())
    # Of no more than `most` rows.
    shown = tail(lines, most).select((F.row_number().over(newest) - 1).cast("long").alias("place"), "line")
    n = lines.agg(F.count("*").alias("n"))
    row = lambda place, line: F.struct(place.cast("long").alias("place"), line.alias("line"))
    more = F.array_compact(F.array(F.when(F.col("n") == 0, row(F.lit(0), F.lit(NOTHING))), F.when(F.col("n") > most, row(F.lit(most), F.format_string(NOTE, F.col("n") - most)))))
    return shown.union(n.select(F.inline(more)))


def hidden(lines: DataFrame, most: int = TAIL) -> DataFrame:
    """One row: how many lines come before the last ones, and the note that says so (null where there are none)."""
    n = lines.agg(F.greatest(F.lit(0), F.count("*") - most).alias("hidden"))
    return n.withColumn("note", F.when(F.col("hidden") > 0, F.format_string(NOTE, "hidden")))
