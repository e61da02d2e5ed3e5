"""Who is in focus: tracks and speech of faces, and the focus as a fold over a clip's samples.

The folds are plain functions of a state and one sample, used by the batch operator in crop.py and by the streaming
ones alike.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from reelframe.config import DEFAULT, Config

LONG_AGO = -(10**9)
# Fixed value: the width of a face without a box.
NO_BOX = 60.0


@dataclass
class Face:
    cx: float
    area: float
    conf: float
    width: float | None = None
    mouth: np.ndarray | None = None


def resized(px: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """A patch at another size, bilinear between pixel centres."""
    if px.shape == shape:
        return px
    at = [np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in zip(shape, px.shape, strict=True)]
    lo = [np.floor(a).astype(int) for a in at]
    hi = [np.minimum(a + 1, m - 1) for a, m in zip(lo, px.shape, strict=True)]
    fy, fx = (at[0] - lo[0])[:, None], (at[1] - lo[1])[None, :]
    top = px[np.ix_(lo[0], lo[1])] * (1 - fx) + px[np.ix_(lo[0], hi[1])] * fx
    low = px[np.ix_(hi[0], lo[1])] * (1 - fx) + px[np.ix_(hi[0], hi[1])] * fx
    return top * (1 - fy) + low * fy


@dataclass
class Track:
    cx: float
    mouth: np.ndarray | None
    motion: list[float] = field(default_factory=list)


def speak(tracks: list[Track], faces: list[Face], window: int) -> list[tuple[int, float]]:
    """(track, speaking score) of a sample's faces; the tracks move on.

    First every face finds its track, the nearest within three quarters of its width, new ones included; then motion
    goes over the faces in order, so two faces of one track compare within the sample.
    """
    own = []
    for f in faces:
        away = [abs(t.cx - f.cx) for t in tracks]
        k = away.index(min(away)) if away else -1
        if k < 0 or away[k] >= 0.75 * (NO_BOX if f.width is None else f.width):
            tracks.append(Track(f.cx, None))
            k = len(tracks) - 1
        own.append(k)
    out = []
    for f, k in zip(faces, own, strict=True):
        t, moved = tracks[k], 0.0
        if f.mouth is not None and t.mouth is not None:
            moved = float(np.abs(f.mouth.astype(float) - resized(t.mouth.astype(float), f.mouth.shape)).mean())
        t.motion = [*t.motion, moved][-window:]
        # A face without a patch leaves the track's last one in place.
        t.cx, t.mouth = f.cx, t.mouth if f.mouth is None else f.mouth
        out.append((k, sum(t.motion) / len(t.motion)))
    return out


def score_of(f: Face, speaking: float, conf: Config) -> float:
    size = f.area * (0.75 + f.conf)
    w = conf.lip_motion_weight
    if w <= 0 or speaking < conf.lip_min_motion:
        return size
    return (1 - w) * size + w * size * (1 + 3 * min(speaking / 20.0, 1.0))


@dataclass
class Focus:
    """The tracker's state."""

    cx: float | None = None
    area: float = 0.0
    seen: int = LONG_AGO
    locked: int = -1
    pending: float | None = None
    since: int = 0
    lips: list[int] = field(default_factory=list)
    blocked: int = -1
    last: int = -1


@dataclass
class Key:
    frame: int
    cx: float
    hard: bool = False
    reset: bool = False
    change: bool = False


def focus_step(s: Focus, frame: int, faces: list[Face], speaking: list[float], cut: bool, src_w: int, src_h: int, fps: float, conf: Config = DEFAULT) -> Key:
    """Moves the state on by one sample and gives its key frame."""
    width = int(src_h * 9 / 16)
    radius = max(conf.focus_match_distance * width, conf.crop_min_deadzone_px)
    middle = src_w / 2
    ladder = (conf.lip_cooldown_1, conf.lip_cooldown_2, conf.lip_cooldown_3)
    best = max(range(len(faces)), key=lambda k: (score_of(faces[k], speaking[k], conf), -k)) if faces else None
    s.last = frame

    def refocus(f: Face | None) -> None:
        s.cx, s.area, s.seen = (f.cx, f.area, frame) if f else (middle, 0.0, LONG_AGO)
        s.locked, s.pending = frame + int(fps * conf.focus_min_lock), None

    if cut or s.cx is None:
        refocus(faces[best] if best is not None else None)
        return Key(frame, s.cx, reset=cut)
    near = [k for k in range(len(faces)) if abs(faces[k].cx - s.cx) <= radius]
    lost = frame - s.seen > int(fps * conf.focus_lost_grace)
    if near:
        f = faces[min(near, key=lambda k: (abs(faces[k].cx - s.cx), k))]
        s.cx, s.area, s.seen, lost = f.cx, f.area, frame, False
    elif not faces and lost:
        s.cx, s.area, s.pending = middle, 0.0, None
    held = [k for k in range(len(faces)) if abs(faces[k].cx - s.cx) <= radius]
    now = speaking[held[0]] if held else 0.0
    far = [k for k in range(len(faces)) if abs(faces[k].cx - s.cx) > radius]
    other = max(far, key=lambda k: (speaking[k], -k)) if far and conf.lip_motion_weight > 0 else (best if best in far else None)
    key = Key(frame, s.cx)
    if other is None or frame < s.locked:
        s.pending = None if near else s.pending
        return key
    f = faces[other]
    by_size = s.area <= 0 or f.area >= conf.focus_area_ratio * s.area
    by_lips = conf.lip_motion_weight > 0 and speaking[other] >= conf.lip_min_motion and speaking[other] > 1.5 * now
    if by_lips and not by_size and not lost:
        if frame >= s.blocked:
            s.lips = [x for x in s.lips if frame - x <= int(fps * conf.lip_burst_window)]
            s.blocked = frame + int(fps * ladder[min(len(s.lips), 2)])
            s.lips.append(frame)
            refocus(f)
            return Key(frame, f.cx, hard=True, change=True)
    elif by_size or by_lips or lost:
        if s.pending is None or abs(f.cx - s.pending) > radius:
            s.since = frame
        s.pending = f.cx
        if frame - s.since >= int(fps * conf.focus_confirm):
            key.change = abs(f.cx - s.cx) > radius / 2
            refocus(f)
            key.cx = f.cx
    elif near:
        s.pending = None
    return key


def clamped(key: Key, src_w: int, src_h: int, frames: int) -> Key:
    half = int(src_h * 9 / 16) / 2
    key.frame = max(0, min(key.frame, frames - 1))
    key.cx = min(max(key.cx, half), src_w - half)
    return key


def mouth_of(px: object) -> np.ndarray | None:
    """A patch from a list of pixels, or none."""
    return None if px is None else np.atleast_2d(np.asarray(px, float))
