"""Scalar functions of the engine; all are Column expressions, none needs Python in tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelframe.config import DEFAULT, Config

WHOLE = r"^[+-]?[0-9]+$"

# White space of any kind in Unicode, with the four separators of records; part of a class in a pattern.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def stripped(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def timecode_seconds(x: Column) -> Column:
    """Seconds of h:m:s or m:s; of any other number of parts the first counts; 0 unless all parts used are whole."""
    parts = F.split(stripped(F.coalesce(x, F.lit(""))), ":")
    at = lambda k: F.when(stripped(F.get(parts, F.lit(k))).rlike(WHOLE), stripped(F.get(parts, F.lit(k))).try_cast("bigint"))
    three = at(0) * 3600 + at(1) * 60 + at(2)
    return F.coalesce(F.when(F.size(parts) == 3, three).when(F.size(parts) == 2, at(0) * 60 + at(1)).otherwise(at(0)), F.lit(0).cast("bigint"))


def caption_time(s: Column) -> Column:
    """H:MM:SS.cc with hundredths cut off."""
    whole = lambda x: F.floor(x).cast("int")
    return F.format_string("%d:%02d:%02d.%02d", whole(s / 3600), whole((s % 3600) / 60), whole(s % 60), ((s - F.floor(s)) * 100).cast("int"))


def slug(x: Column) -> Column:
    """A caption as a file name: letters, digits and underscores, 100 characters at most."""
    plain = F.regexp_replace(x, rf"[^\p{{L}}\p{{N}}_{SPACE}-]", "")
    return F.substring(F.regexp_replace(F.regexp_replace(plain, rf"[-{SPACE}]+", "_"), "^_+|_+$", ""), 1, 100)


def output_path(folder: Column, caption: Column) -> Column:
    """Where a clip is written: the folder, and its caption as a file name."""
    return F.concat(folder, F.lit("/"), F.coalesce(slug(caption), F.lit("")), F.lit(".mp4"))


# Colours of score bands and labels of statuses.
HIGH, MIDDLE, REST = "#4ade80", "#facc15", "#f87171"
BADGES = {"idle": "Menunggu", "ready": "Siap", "running": "Processing", "error": "Error"}


def score_band(score: Column) -> Column:
    """The colour of a score: only the whole numbers 7 to 10 have one of their own."""
    return F.when(score.isin(9, 10), HIGH).when(score.isin(7, 8), MIDDLE).otherwise(REST)


def status_badge(status: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in BADGES.items() for x in kv]), status), F.lit(BADGES["idle"]))


def percent_bar(duration: Column, longest: Column) -> Column:
    """Whole percent of the longest, cut off; 0 where that is 0."""
    return F.when(longest > 0, (duration / longest * 100).cast("int")).otherwise(0)


def escape_drawtext(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\:")), F.lit("'"), F.lit("\\'"))


def escape_filter_path(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("/")), F.lit(":"), F.lit("\\:"))


def escape_html(x: Column) -> Column:
    """HTML text; an empty line is a hard space, one of white space stays as it is."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.when(x == "", F.lit("&nbsp;")).otherwise(x)


def clip_label(clip_id: Column, caption: Column) -> Column:
    return F.concat(F.lit("#"), clip_id.cast("string"), F.lit(" — "), F.substring(caption, 1, 50))


def has_suffix(x: Column, suffixes: tuple[str, ...]) -> Column:
    """Whether a name ends in one of the suffixes, in either case."""
    return F.lower(x).rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")


def crop_width(height: Column) -> Column:
    return (height * 9 / 16).cast("int")


def clamp(x: Column, low: Column, high: Column) -> Column:
    """Within bounds; the upper one where they cross."""
    return F.least(F.greatest(x, low), high)


def crop_left(cx: Column, width: Column, src_w: Column) -> Column:
    return F.greatest(F.lit(0), F.least((cx - width / 2).cast("int"), src_w - width))


def safe_fps(fps: Column) -> Column:
    return F.when(fps > 0, fps).otherwise(F.lit(30.0))


def frames_of(fps: Column, seconds: float) -> Column:
    """The whole frames of a time."""
    return (fps * seconds).cast("int")


def cut_gap(fps: Column, conf: Config = DEFAULT) -> Column:
    """Frames from one accepted cut to the next at least."""
    return F.greatest(F.lit(1), frames_of(fps, conf.scene_cut_min_gap))


def sampling_interval(fps: Column, sample_fps: float = DEFAULT.face_sample_fps) -> Column:
    return F.greatest(F.lit(1), (fps / sample_fps).cast("int"))


def smoothing_window(fps: float, conf: Config = DEFAULT) -> int:
    """Observations that a rolling mean of speech goes over."""
    return max(1, int(fps * conf.lip_smooth_sec / max(1.0, fps / conf.face_sample_fps)))


def smoothing_alpha(fps: Column, tau: float = DEFAULT.crop_smoothing_tau) -> Column:
    return 1 - F.exp(-1 / F.greatest(fps * tau, F.lit(1.0)))


def cut_score(hist: Column, pixel: Column) -> Column:
    return 0.60 * hist + 0.40 * pixel


def is_cut(hist: Column, pixel: Column, conf: Config = DEFAULT) -> Column:
    """Whether a frame may begin a scene: by both differences, or by one strong one."""
    score = cut_score(hist, pixel)
    normal = (score >= conf.scene_cut_score) & (hist >= conf.scene_cut_hist) & (pixel >= conf.scene_cut_pixel)
    by_hist = (hist >= max(0.45, 2.5 * conf.scene_cut_hist)) & (score >= conf.scene_cut_score)
    by_pixel = (pixel >= max(0.22, 2 * conf.scene_cut_pixel)) & (hist >= 0.75 * conf.scene_cut_hist)
    return normal | by_hist | by_pixel


def face_score(area: Column, conf_: Column, speaking: Column, conf: Config = DEFAULT) -> Column:
    """A face's size by its confidence, raised by speech that is loud enough."""
    size = area * (0.75 + conf_)
    w = conf.lip_motion_weight
    if w <= 0:
        return size
    loud = F.least(speaking / 20.0, F.lit(1.0))
    return F.when(speaking < conf.lip_min_motion, size).otherwise((1 - w) * size + w * size * (1 + 3 * loud))


def mouth_box(x1: Column, y1: Column, x2: Column, y2: Column, src_w: Column, src_h: Column) -> Column:
    """The part of a face box where the mouth is, within the frame; null where nothing is left."""
    w, h = x2 - x1, y2 - y1
    left, right = F.greatest(F.lit(0), (x1 + w * 0.25).cast("int")), F.least(src_w, (x1 + w * 0.75).cast("int"))
    top, bottom = F.greatest(F.lit(0), (y1 + h * 0.60).cast("int")), F.least(src_h, (y1 + h * 0.95).cast("int"))
    return F.when((right > left) & (bottom > top), F.struct(left.alias("x1"), top.alias("y1"), right.alias("x2"), bottom.alias("y2")))


def mean_difference(a: Column, b: Column) -> Column:
    """Mean of the absolute differences of two arrays of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda acc, x: acc + x) / F.size(a)


def bhattacharyya(a: Column, b: Column) -> Column:
    """Distance of two histograms, 0 to 1; their scales don't matter."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.sqrt(x.cast("double") * y.cast("double"))), F.lit(0.0), lambda acc, v: acc + v)
    return F.sqrt(F.greatest(F.lit(0.0), 1 - both / F.sqrt(total(a) * total(b))))
