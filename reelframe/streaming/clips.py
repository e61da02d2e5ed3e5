"""From faces to the crop path over streams: tracks and focus in one stateful operator, the path in the next.

The first operator holds rows back until the watermark has passed their time, then takes them in order of their frames, so
rows may come in any order within the watermark's delay. The rule for late rows: a row of a frame that a clip has
passed already, or of a clip that has ended, is dropped. A timer at the time of a clip's last frame ends the
clip and clears all of its state. What it emits is in order, so the operator after it needs no time of its own.

Targets between two keys are known once the later key is; those frames are held open till then, or till a cut or the
clip's end, as one row of state.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reelframe.config import DEFAULT, Config
from reelframe.operators.crop import BEGIN, CUT, KEY, SAMPLE, Fold
from reelframe.operators.focus import Focus, Track, mouth_of
from reelframe.operators.path import Smoother, eased

END = 3
#: Columns of whole numbers, which pandas holds as floats where some are missing.
WHOLE = {"frame", "kind", "sample_idx", "face_idx", "src_w", "src_h", "total_frames", "seq"}
MEDIA = ("src_w", "src_h", "fps", "total_frames")
TRACK = "cx double, mouth array<double>, lines int, motion array<double>"
CLIP = "src_w int, src_h int, fps double, total bigint, seq bigint, cut boolean, cx double, area double, seen bigint, locked bigint, pending double, since bigint, lips array<bigint>, blocked bigint"
FOCUS = ("cx", "area", "seen", "locked", "pending", "since", "lips", "blocked")


def names(schema: str) -> list[str]:
    """The names of a schema's own columns, not of those within them."""
    out, depth = [], 0
    for part in schema.replace("<", " < ").replace(">", " > ").replace(",", " , ").split():
        depth += (part == "<") - (part == ">")
        out.append(part if depth == 0 else "")
    flat = " ".join(out).split(",")
    return [f.split()[0] for f in flat]


def plain(x: object) -> object:
    """A value of pandas as one of Python; missing ones are none."""
    if isinstance(x, (np.ndarray, list)):
        return [plain(v) for v in x]
    x = x.item() if isinstance(x, np.generic) else x
    return None if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else x


class InOrder(StatefulProcessor):
    """Rows of a clip, held back until the watermark has passed their time `at`, then taken frame by frame.

    A subclass has the input's columns, init of its own state, taken(frame, rows) and ended(), which give rows to emit.
    """

    columns: list[str]
    out: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at bigint, frame bigint", "rows binary")
        #: The last frame taken, the time of the clip's end, and the time of the timer that is set.
        self.passed = handle.getValueState("passed", "frame bigint, ends bigint, timer bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        last, ends, timer = self.passed.get() if self.passed.exists() else (-(1 << 63), None, None)
        fresh: dict[tuple[int, int], list[tuple]] = {}
        for some in rows:
            for at, row in zip(some["at_ms"].tolist(), some[self.columns].itertuples(index=False, name=None), strict=True):
                row = {c: int(v) if c in WHOLE and v is not None else v for c, v in zip(self.columns, map(plain, row), strict=True)}
                if row["frame"] > last:
                    fresh.setdefault((at, row["frame"]), []).append(row)
                    if row["total_frames"] is not None:
                        ends = at + int(max(row["total_frames"] - max(row["frame"], 0), 0) * 1000 / row["fps"])
        for k, more in fresh.items():
            held = pickle.loads(bytes(self.waiting.getValue(k)[0])) if self.waiting.containsKey(k) else []
            self.waiting.updateValue(k, (pickle.dumps(held + more),))
        self.passed.update((last, ends, timer))
        yield from self._advanced(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.passed.exists():
            last, ends, _ = self.passed.get()
            self.passed.update((last, ends, None))
            yield from self._advanced(key, timerValues.getCurrentWatermarkInMs())

    def _advanced(self, key: tuple, watermark: int) -> Iterator[pd.DataFrame]:
        last, ends, timer = self.passed.get()
        waiting = sorted((tuple(k) for k in self.waiting.keys()), key=lambda k: (k[1], k[0]))
        made: list[tuple] = []
        left = []
        self.load()
        ready: dict[int, list[dict]] = {}
        for at, frame in waiting:
            if at <= watermark:
                ready.setdefault(frame, []).extend(pickle.loads(bytes(self.waiting.getValue((at, frame))[0])))
                self.waiting.removeKey((at, frame))
            else:
                left.append(at)
        for frame, some in sorted(ready.items()):
            made += self.taken(frame, some)
            last = frame
        if ends is not None and ends <= watermark and not left:
            made += self.ended()
            for state in (self.waiting, self.passed, *self.states):
                state.clear()
            if timer is not None:
                self.handle.deleteTimer(timer)
        else:
            self.save()
            due = min([*left, *([ends] if ends is not None else [])], default=None)
            if due is not None and due != timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(max(due, watermark + 1))
                timer = max(due, watermark + 1)
            self.passed.update((last, ends, timer))
        yield pd.DataFrame([(key[0], *m) for m in made], columns=self.out)

    def close(self) -> None:
        pass


class Samples(InOrder):
    """SAMPLE rows of a timeline, and one of kind END when a clip has ended. Each track is an entry of a map."""

    columns = ["frame", "kind", "sample_idx", "face_idx", "cx", "area", "conf", "width", "mouth", *MEDIA]
    out = names(SAMPLE)

    def __init__(self, conf: Config):
        self.conf = conf

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.tracks = handle.getMapState("tracks", "track bigint", TRACK)
        self.clip = handle.getValueState("clip", CLIP)
        self.states = (self.tracks, self.clip)

    def load(self) -> None:
        self.fold = None
        if self.clip.exists():
            w, h, fps, total, seq, cut, *focus = self.clip.get()
            self.fold = Fold(w, h, fps, total, self.conf)
            self.fold.seq, self.fold.cut = seq, cut
            self.fold.state = Focus(**{k: plain(v) for k, v in zip(FOCUS, focus, strict=True)})
            for (k,), (cx, mouth, lines, motion) in sorted((tuple(k), tuple(v)) for k, v in self.tracks.iterator()):
                self.fold.tracks.append(Track(cx, None if mouth is None else np.array(mouth, float).reshape(lines, -1), list(motion)))
        self.kept = [(t.cx, t.motion) for t in self.fold.tracks] if self.fold else []

    def save(self) -> None:
        if not self.fold:
            return
        f = self.fold
        self.clip.update((*f.media, f.seq, f.cut, *(getattr(f.state, k) for k in FOCUS)))
        for k, t in enumerate(f.tracks):
            # A track that has moved has a list of motion of its own.
            if k >= len(self.kept) or t.motion is not self.kept[k][1]:
                self.tracks.updateValue((k,), (t.cx, None if t.mouth is None else t.mouth.ravel().tolist(), 0 if t.mouth is None else len(t.mouth), t.motion))

    def taken(self, frame: int, rows: list[dict]) -> list[tuple]:
        out: list[tuple] = []
        rows.sort(key=lambda r: (r["kind"], r["sample_idx"] or 0, -1 if r["face_idx"] is None else r["face_idx"]))
        samples: dict[int, list[dict]] = {}
        for r in rows:
            if r["kind"] == BEGIN and self.fold is None and r["total_frames"] is not None:
                self.fold = Fold(*(r[m] for m in MEDIA), self.conf)
                if r["total_frames"] > 0:
                    out.append((BEGIN, None, None, 0, None, False, False, False, None, *self.fold.media))
            elif r["kind"] == CUT and self.fold:
                inside = self.fold.within(frame)
                self.fold.cut |= inside
                out.append((CUT, None, None, frame if inside else None, None, True, False, False, None, *self.fold.media))
            elif r["kind"] == KEY and self.fold:
                samples.setdefault(r["sample_idx"], []).extend([r] if r["face_idx"] is not None else [])
        for sample, faces in samples.items():
            k, said = self.fold.sample(frame, [(f["cx"], f["area"], f["conf"], f["width"], f["mouth"]) for f in faces])
            spoken = [{"face_idx": f["face_idx"], "track": t, "speaking": x} for f, (t, x) in zip(faces, said, strict=True)]
            out.append((KEY, self.fold.seq, sample, *((k.frame, k.cx, k.hard, k.reset, k.change) if k else (None,) * 5), spoken, *self.fold.media))
            self.fold.seq += 1
        return out

    def ended(self) -> list[tuple]:
        f = self.fold
        if not f or f.media[3] <= 0:
            return []
        k = f.middle()
        none = [] if f.seq else [(KEY, 0, None, k.frame, k.cx, False, False, False, [], *f.media)]
        return [*none, (END, None, None, f.media[3], None, False, False, False, None, *f.media)]


def sample_stream(timeline: DataFrame, conf: Config = DEFAULT) -> DataFrame:
    """crop.samples over a stream of timeline rows with an event time `at` and a watermark on it; at is the time of the
    row's frame, the media row's that of the clip's start. A clip's last row is one of kind END."""
    return timeline.withColumn("at_ms", F.unix_millis("at")).groupBy("clip_id").transformWithStateInPandas(Samples(conf), SAMPLE, "Append", "EventTime")


class Open:
    """The frames of a clip that are not known yet: the mark before them, and the marks of the frame after them so far."""

    STATE = "frame bigint, cx double, starts boolean, next bigint, next_seq bigint, next_cx double, next_starts boolean, carry double, middle double"

    def __init__(self, middle: float):
        self.mark: tuple[int, float | None, bool] | None = None
        self.next: tuple[int, int, float | None, bool] | None = None
        self.carry, self.middle = None, middle

    @classmethod
    def of(cls, state: tuple) -> Open:
        frame, cx, starts, at, seq, next_cx, next_starts, carry, middle = map(plain, state)
        self = cls(middle)
        self.mark, self.next, self.carry = None if frame is None else (frame, cx, starts), None if at is None else (at, seq, next_cx, next_starts), carry
        return self

    def state(self) -> tuple:
        return (*(self.mark or (None,) * 3), *(self.next or (None,) * 4), self.carry, self.middle)

    def add(self, frame: int, seq: int | None, cx: float | None, starts: bool) -> list[tuple]:
        """Takes a mark; gives the pieces (begin, end, starts, at, x, next_at, next_x) that are known now."""
        starts = starts and frame > 0
        if self.next and frame <= self.next[0]:
            # One more mark of the same frame: its last key counts, and any start.
            at, known, key, begins = self.next
            later = cx is not None and (key is None or seq >= known)
            self.next = (at, seq if later else known, cx if later else key, begins or starts)
            return []
        out = self._settled()
        self.next = (frame, -1 if seq is None else seq, cx, starts)
        return out

    def end(self, total: int) -> list[tuple]:
        out = self._settled()
        if self.mark:
            out.append((self.mark[0], total, self.mark[2], None, self._held(), None, None))
        return out

    def _held(self) -> float:
        key = self.mark[1] if self.mark[1] is not None else self.carry
        return self.middle if key is None else key

    def _settled(self) -> list[tuple]:
        """The next mark is whole: it ends what is open."""
        if not self.next:
            return []
        frame, _, cx, starts = self.next
        out = []
        if self.mark:
            begin, key, begun = self.mark
            if starts or cx is None:
                out = [(begin, frame, begun, None, self._held(), None, None)]
            elif key is None:
                out = [(begin, frame, begun, None, cx, None, None)]
            else:
                out = [(begin, frame, begun, begin, key, frame, cx)]
        self.mark, self.next = (frame, cx, starts), None
        self.carry = self.carry if cx is None else cx
        return out


class Targets(InOrder):
    """Targets of marks: path.interpolated over a stream."""

    columns = ["frame", "seq", "cx", "starts", *MEDIA]
    out = ["clip_id", "frame", "cx", "is_cut"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open_state = handle.getValueState("open", Open.STATE + ", total bigint")
        self.states = (self.open_state,)

    def load(self) -> None:
        *state, self.total = self.open_state.get() if self.open_state.exists() else (None,)
        self.open = Open.of(tuple(state)) if state else None

    def save(self) -> None:
        if self.open:
            self.open_state.update((*self.open.state(), self.total))

    def taken(self, frame: int, rows: list[dict]) -> list[tuple]:
        out = []
        for r in rows:
            if r["total_frames"] is None:
                continue
            self.open, self.total = self.open or Open(r["src_w"] / 2), r["total_frames"]
            if 0 <= frame < self.total:
                out += self._spelled(self.open.add(frame, r["seq"], r["cx"], r["starts"]))
        return out

    def ended(self) -> list[tuple]:
        return self._spelled(self.open.end(self.total)) if self.open else []

    def _spelled(self, pieces: list[tuple]) -> list[tuple]:
        return [(begin + k, x, starts and k == 0) for begin, end, starts, *rest in pieces for k, x in enumerate(eased(begin, end, *rest).tolist())]


def target_stream(marks: DataFrame) -> DataFrame:
    """path.interpolated over a stream of marks (path.marks) with an event time `at` and a watermark on it. A clip's last
    frames come when the watermark has passed its end."""
    return marks.withColumn("at_ms", F.unix_millis("at")).groupBy("clip_id").transformWithStateInPandas(Targets(), "clip_id bigint, frame bigint, cx double, is_cut boolean", "Append", "EventTime")


class Paths(StatefulProcessor):
    """The path of samples that come in order: the open frames and the crop's centre are all that is kept."""

    def __init__(self, conf: Config):
        self.conf = conf

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("path", Open.STATE + ", centre double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        some = pd.concat(list(rows))
        # By frame; of one frame the begin and cuts come first, the end last, keys by number.
        order = [(r.frame, r.kind, -1 if plain(r.seq) is None else r.seq, r) for r in some[some.frame.notna()].itertuples(index=False)]
        order.sort(key=lambda r: r[:3])
        *state, centre = self.value.get() if self.value.exists() else (None,)
        held = Open.of(tuple(state)) if state else None
        made: list[tuple] = []
        for frame, kind, seq, r in order:
            held = held or Open(r.src_w / 2)
            width = int(r.src_h * 9 / 16)
            s = Smoother(width, r.fps, self.conf, plain(centre))
            pieces = held.end(int(frame)) if kind == END else held.add(int(frame), None if seq < 0 else int(seq), plain(r.cx), bool(r.hard))
            for begin, end, starts, *rest in pieces:
                targets = eased(begin, end, *rest).tolist()
                jump = starts and s.cut_to(targets[0])
                low, high = width / 2, r.src_w - width / 2
                made += [(key[0], begin + k, min(max(x, low), high), bool(jump and k == 0)) for k, x in enumerate(s.follow(targets))]
            centre = s.centre
            if kind == END:
                held = centre = None
        if held:
            self.value.update((*held.state(), centre))
        else:
            self.value.clear()
        yield pd.DataFrame(made, columns=["clip_id", "frame", "cx", "jump"])

    def close(self) -> None:
        pass


def path_stream(timeline: DataFrame, conf: Config = DEFAULT) -> DataFrame:
    """clip_id, frame, cx (held within the picture) and jump of every frame, from a stream of timeline rows as
    sample_stream has them: two stateful operators in one query."""
    found = sample_stream(timeline, conf)
    return found.groupBy("clip_id").transformWithStateInPandas(Paths(conf), "clip_id bigint, frame bigint, cx double, jump boolean", "Append", "None")
