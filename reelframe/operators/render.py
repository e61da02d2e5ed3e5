"""What the encoder is told: the text of the filter graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelframe.functions.scalars import escape_drawtext, escape_filter_path, stripped

# How the two texts look.
CHANNEL = ":font=Impact:fontsize=28:fontcolor=white@0.20:x=(w-text_w)/2:y=(h-text_h)/2:shadowcolor=black@0.20:shadowx=2:shadowy=2"
CREDIT = ":font=Impact:fontsize=28:fontcolor=white@0.55:x=(w-text_w)/2:y=40:shadowcolor=black@0.6:shadowx=2:shadowy=2"


def filter_graph(captions: Column, channel: Column, credit: Column) -> Column:
    """Captions, then channel, then credit; a blank or null text leaves its part out."""
    part = lambda x, look: F.when(stripped(x) != "", F.concat(F.lit("drawtext=text='"), escape_drawtext(stripped(x)), F.lit("'" + look)))
    return F.concat_ws(",", F.concat(F.lit("ass="), escape_filter_path(captions)), part(channel, CHANNEL), part(credit, CREDIT))


def ready(channel: Column, credit: Column) -> Column:
    """Whether both texts are given."""
    return F.coalesce((stripped(channel) != "") & (stripped(credit) != ""), F.lit(False))
