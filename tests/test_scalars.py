"""Worked examples of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from reelframe.config import Config
from reelframe.functions import scalars as S


def each(spark, f, values, kind):
    rows = spark.createDataFrame(list(enumerate(values)), f"k int, x {kind}").select("k", f(F.col("x")).alias("y")).orderBy("k").collect()
    return [r.y for r in rows]


def test_timecode(spark):
    given = ["01:02:03", "2:03", "45", "", "abc", "00:12:34.5", "1:2:3:4", "-1:30", " 7 ", "::", None, "\u00a01\u2003:\u20282 "]
    assert each(spark, S.timecode_seconds, given, "string") == [3723, 123, 45, 0, 0, 0, 1, -30, 7, 0, 0, 62]


def test_caption_time(spark):
    assert each(spark, S.caption_time, [0.0, 0.29, 1.15, 3661.5], "double") == ["0:00:00.00", "0:00:00.28", "0:00:01.14", "1:01:01.50"]


def test_score_band(spark):
    found = each(spark, S.score_band, [9.0, 10.0, 7.0, 8.0, 6.0, 8.5, 9.5, 11.0, None], "double")
    assert found == ["#4ade80"] * 2 + ["#facc15"] * 2 + ["#f87171"] * 5


def test_slug(spark):
    given = ["The 2-minute rule will fix!", "a_ b", "--x--", "!!!", "été à Paris", "a\u00a0b\u3000\x1cc\u2028"]
    assert each(spark, S.slug, given, "string") == ["The_2_minute_rule_will_fix", "a__b", "x", "", "été_à_Paris", "a_b_c"]


def test_percent_bar(spark):
    assert each(spark, lambda x: S.percent_bar(x, F.lit(100.0)), [29.0, 50.0], "double") == [28, 50]
    assert each(spark, lambda x: S.percent_bar(x, F.lit(0.0)), [5.0], "double") == [0]


def test_escapes(spark):
    assert each(spark, S.escape_drawtext, ["a\\b:c'd"], "string") == ["a\\\\b\\:c\\'d"]
    assert each(spark, S.escape_html, ["<a & 'b'>", "  ", "", None], "string") == ["&lt;a &amp; &#x27;b&#x27;&gt;", "  ", "&nbsp;", None]
    assert each(spark, S.stripped, ["\u00a0\x1fa b\x85\u205f"], "string") == ["a b"]


def test_cut_predicate(spark):
    rows = spark.createDataFrame([(0.30, 0.12), (0.50, 0.00), (0.11, 0.25), (0.30, 0.05)], "h double, p double")
    assert [r.c for r in rows.select(S.is_cut(F.col("h"), F.col("p")).alias("c")).collect()] == [True, True, True, False]


def test_config():
    assert Config.from_env({"REELFRAME_LIP_MIN_MOTION": "2.5"}).lip_min_motion == 2.5
    given = Config.from_env({"REELFRAME_CHANNEL": " Talks ", "REELFRAME_OUTDIR": "out", "REELFRAME_WORDS_PER_CAPTION": "3"})
    assert (given.channel, given.outdir, given.words_per_caption, given.json, given.source_credit, Config().outdir) == (" Talks ", "out", 3, "", "", ".")
    with pytest.raises(ValueError):
        Config.from_env({"REELFRAME_LIP_MIN_MOTION": "x"})


def test_settings_of_the_environment():
    import subprocess
    import sys

    from tests.conftest import ROOT

    asked = "from reelframe.config import DEFAULT; from reelframe.functions.scalars import smoothing_window; print(DEFAULT.lip_smooth_sec, smoothing_window(30.0))"
    made = subprocess.run([sys.executable, "-c", asked], cwd=ROOT, env={"REELFRAME_LIP_SMOOTH_SEC": "2", "PATH": "/usr/bin"}, capture_output=True, text=True, check=True)
    assert made.stdout.split() == ["2.0", "8"]
