"""A clip's crop in one plain pass over lists: what the operators are held against."""

from __future__ import annotations

from bisect import bisect_right

from reelframe.config import DEFAULT, Config
from reelframe.functions.scalars import smoothing_window
from reelframe.operators.focus import Face, Focus, Key, Track, clamped, focus_step, mouth_of, speak
from reelframe.operators.path import smooth


def targets(keys: list[Key], cuts: list[int], total: int, middle: float) -> list[float]:
    """A centre for each frame: eased between the keys of a segment; segments begin at cuts. Of keys of one frame
    the last counts. A segment without keys goes on with the value before it."""
    of = {k.frame: k.cx for k in keys}
    starts = [0, *cuts]
    known: list[list[int]] = [[] for _ in starts]
    for f in sorted(of):
        known[bisect_right(starts, f) - 1].append(f)
    out: list[float] = []
    for begin, end, frames in zip(starts, [*cuts, total], known, strict=True):
        if not frames:
            out += [out[-1] if out else middle] * (end - begin)
            continue
        out += [of[frames[0]]] * (frames[0] - begin)
        for a, b in zip(frames[:-1], frames[1:], strict=True):
            part = [(f - a) / (b - a) for f in range(a, b)]
            out += [of[a] + (of[b] - of[a]) * (t * t * (3 - 2 * t)) for t in part]
        out += [of[frames[-1]]] * (end - frames[-1])
    return out


def crop_clip(faces: list[dict], cuts: list[int], src_w: int, src_h: int, fps: float, total: int, conf: Config = DEFAULT) -> dict:
    """spoken, keys and path of one clip; a face without face_idx stands for a sample without faces."""
    window, width = smoothing_window(fps, conf), int(src_h * 9 / 16)
    cuts = sorted({c for c in cuts if 0 < c < total})
    samples: dict[tuple[int, int], list[dict]] = {}
    for f in sorted(faces, key=lambda f: (f["sample_idx"], -1 if f["face_idx"] is None else f["face_idx"])):
        samples.setdefault((f["sample_idx"], f["frame"]), []).extend([f] if f["face_idx"] is not None else [])
    tracks: list[Track] = []
    state, before, spoken, keys = Focus(), -1, [], []
    for n, ((sample, frame), some) in enumerate(samples.items()):
        found = [Face(f["cx"], f["area"], f["conf"], f["width"], mouth_of(f["mouth"])) for f in some]
        said = speak(tracks, found, window)
        spoken += [{"sample_idx": sample, "face_idx": f["face_idx"], "track": k, "speaking": x} for f, (k, x) in zip(some, said, strict=True)]
        reset = bisect_right(cuts, frame) > bisect_right(cuts, before)
        key = focus_step(state, frame, found, [x for _, x in said], reset, src_w, src_h, fps, conf)
        before = frame
        if total > 0:
            keys.append((n, clamped(key, src_w, src_h, total)))
    if not keys and total > 0:
        keys.append((0, clamped(Key(0, src_w / 2), src_w, src_h, total)))
    hard = {k.frame for _, k in keys if k.hard}
    every = sorted(set(cuts) | hard)
    at = targets([k for _, k in keys], [c for c in every if c > 0], total, src_w / 2) if total > 0 else []
    jumps_at = set(every)
    cx, jumps = smooth(at, [f in jumps_at for f in range(len(at))], width, fps, conf)
    low, high = width / 2, src_w - width / 2
    path = [{"frame": f, "cx": min(max(x, low), high), "jump": j} for f, (x, j) in enumerate(zip(cx, jumps, strict=True))]
    return {"spoken": spoken, "keys": [{"seq": n, "frame": k.frame, "cx": k.cx, "hard": k.hard, "reset": k.reset, "change": k.change} for n, k in keys], "path": path}
