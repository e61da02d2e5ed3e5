"""Audio for speech recognition: chunks of samples in any rate to 16 kHz, mono.

A chunk's samples are cut to blocks of the input and go along to the block before or after where its filter reaches over the
border, so each block is worked on by itself, whatever the sizes of chunks, and all borders are heard through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples a second that come out, input samples of a block, zeros of the filter on each side, and the most that a sample is.
RATE, BLOCK, ZEROS, FULL = 16_000, 1 << 14, 16, 32_768


def reach(rate: int) -> int:
    """Input samples that the filter reaches to each side."""
    return ceil(ZEROS * max(1.0, rate / RATE))


@lru_cache(maxsize=32)
def filters(rate: int) -> np.ndarray:
    """(phase, tap): a sinc with a raised cosine as its window, below half of the lower rate, for each place of an output
    sample between two input ones; taps go from reach - 1 before to reach after."""
    cut, half = min(1.0, RATE / rate), reach(rate)
    phases = RATE // gcd(rate, RATE)
    away = np.arange(phases)[:, None] / phases - np.arange(1 - half, half + 1)[None, :]
    width = ZEROS / cut
    return np.where(np.abs(away) < width, cut * np.sinc(cut * away) * (0.5 + 0.5 * np.cos(np.pi * away / width)), 0.0)


def resampled(x: np.ndarray, first: int, begin: int, end: int, rate: int) -> tuple[int, np.ndarray]:
    """The number of the first output sample at or after input place begin, and those before end; x are the input samples
    from place first on, silence lies around them."""
    step = gcd(rate, RATE)
    low, high = -(-begin * RATE // rate), -(-end * RATE // rate)
    at = np.arange(low, high, dtype=np.int64) * rate
    place, phase = at // RATE, (at % RATE) // step
    taps = place[:, None] + np.arange(1 - reach(rate), reach(rate) + 1)[None, :] - first
    inside = (taps >= 0) & (taps < len(x))
    return low, (np.where(inside, x[np.clip(taps, 0, max(len(x) - 1, 0))] if len(x) else 0.0, 0.0) * filters(rate)[phase]).sum(1)


def speech_audio(chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """(clip_id, first, samples): runs of output samples from number first on, in -1 .. 1, of chunks (clip_id, start, rate,
    channels, samples): start counts the samples before a chunk, samples are 16 bits each, the lower byte first, channels by turns.

    A clip has one rate and number of channels. Samples that no chunk has are silent; chunks that are null, empty or of no
    rate are passed over; a chunk that comes twice counts once.
    """
    wide = F.lit(2) * F.col("channels")
    n = F.floor(F.octet_length("samples") / wide)
    some = chunks.where("rate > 0 and channels > 0 and start >= 0 and clip_id is not null").withColumn("n", n).where("n > 0")
    halo = F.ceil(ZEROS * F.greatest(F.lit(1.0), F.col("rate") / RATE))
    spread = some.withColumns({"halo": halo, "upto": F.col("start") + F.col("n")}).withColumn("block", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("start") - F.col("halo")) / block)), F.floor((F.col("upto") - 1 + F.col("halo")) / block))))
    low = F.greatest("start", F.col("block") * block - F.col("halo"))
    high = F.least("upto", (F.col("block") + 1) * block + F.col("halo"))
    part = F.substring("samples", ((low - F.col("start")) * wide + 1).cast("int"), ((high - low) * wide).cast("int"))
    cut = spread.where(low < high).select("clip_id", "block", "rate", "channels", F.struct(low.alias("at"), part.alias("bytes")).alias("part"))
    blocks = cut.groupBy("clip_id", "block").agg(F.first("rate").cast("int").alias("rate"), F.first("channels").cast("int").alias("channels"), F.array_sort(F.collect_set("part")).alias("parts"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, made = [], []
            for k, rate, channels, parts in zip(*[batch.column(c).to_pylist() for c in ("block", "rate", "channels", "parts")], strict=True):
                first, upto = parts[0]["at"], max(p["at"] + len(p["bytes"]) // (2 * channels) for p in parts)
                x = np.zeros(upto - first)
                for p in parts:
                    own = np.frombuffer(p["bytes"], "<i2").reshape(-1, channels).mean(1)
                    x[p["at"] - first : p["at"] - first + len(own)] = own
                low, out = resampled(x, first, k * block, min((k + 1) * block, max(upto, k * block)), rate)
                firsts.append(low)
                made.append(out / FULL)
            yield pa.RecordBatch.from_arrays([batch.column("clip_id"), pa.array(firsts, pa.int64()), pa.array(made, pa.list_(pa.float64()))], ["clip_id", "first", "samples"])

    found = blocks.select(F.col("clip_id").cast("long"), "block", "rate", "channels", "parts").mapInArrow(of, "clip_id bigint, first bigint, samples array<double>")
    return found.where("size(samples) > 0")
