"""Resampled audio against one plain convolution over whole clips."""

import numpy as np
import pytest

from reelframe.operators import audio

CHUNKS = "clip_id bigint, start bigint, rate int, channels int, samples binary"


def plain(x, rate):
    """Each output sample as a sum over all input samples."""
    cut = min(1.0, audio.RATE / rate)
    out = []
    for n in range(-(-len(x) * audio.RATE // rate)):
        away = n * rate / audio.RATE - np.arange(len(x))
        width = audio.ZEROS / cut
        out.append(float((x * np.where(np.abs(away) < width, cut * np.sinc(cut * away) * (0.5 + 0.5 * np.cos(np.pi * away / width)), 0)).sum()) / audio.FULL)
    return np.array(out)


def joined(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.clip_id, r["first"])):
        have = out.setdefault(r.clip_id, [])
        assert r["first"] == len(have)
        have += r.samples
    return out


@pytest.mark.parametrize("block", [50, 1000, audio.BLOCK])
def test_borders_are_not_heard(spark, block):
    """Chunks of all sizes, shorter than the filter too, in any order and blocks of any size."""
    gen, rows, want = np.random.default_rng(5), [], {}
    for clip, (rate, channels) in enumerate([(44_100, 2), (48_000, 1), (16_000, 1), (8_000, 2), (22_050, 1)]):
        x = gen.integers(-30_000, 30_000, (1500, channels)).astype("<i2")
        want[clip] = plain(x.mean(1), rate)
        at = 0
        while at < len(x):
            n = int(gen.integers(1, 120))
            rows.append((clip, at, rate, channels, x[at : at + n].tobytes()))
            at += n
    gen.shuffle(rows)
    rows = [(int(c), int(a), int(r), int(h), bytes(b)) for c, a, r, h, b in rows]
    got = joined(audio.speech_audio(spark.createDataFrame(rows + rows[:5], CHUNKS), block))
    assert got.keys() == want.keys() and all(len(got[k]) == len(want[k]) and np.allclose(got[k], want[k], atol=1e-9) for k in want)


def test_odd_chunks(spark):
    """Null, empty and rateless chunks are passed over; a gap is silence; a tone keeps its height."""
    t = np.arange(8000)
    tone = (20_000 * np.sin(2 * np.pi * 440 * t / 8000)).astype("<i2").tobytes()
    rows = [(1, 0, 8000, 1, tone), (1, 0, 8000, 1, None), (2, 0, 0, 1, tone), (3, 0, 16_000, 1, b""), (None, 0, 8000, 1, tone), (4, 100, 16_000, 1, b"\x10\x00" * 10)]
    got = joined(audio.speech_audio(spark.createDataFrame(rows, CHUNKS)))
    assert got.keys() == {1, 4} and len(got[1]) == 16_000
    clean = 20_000 / 32_768 * np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000)
    assert np.abs(np.array(got[1]) - clean)[200:-200].max() < 2e-3
    assert len(got[4]) == 110 and np.allclose(got[4][:100], 0, atol=1e-12) and np.allclose(got[4][100:], 16 / 32_768)
    assert audio.speech_audio(spark.createDataFrame([], CHUNKS)).count() == 0
