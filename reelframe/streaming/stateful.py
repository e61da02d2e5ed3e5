"""The folds over streams: cuts, focus and smoothing keep their state from batch to batch.

Rows of a clip are taken in order of their frame within a batch; a row that is no later than the last one seen is
late and dropped. Each processor emits a row as soon as its input is there.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reelframe.config import DEFAULT, Config
from reelframe.operators.focus import Face, Focus, clamped, focus_step
from reelframe.operators.path import smooth


class Folded(StatefulProcessor):
    """A fold with its last frame and its state, pickled into one value for each clip."""

    def __init__(self, start: Callable[[], object], step: Callable[[object, int, pd.DataFrame], tuple[object, list[tuple]]], columns: list[str]):
        self.start, self.step, self.columns = start, step, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("state", "last bigint, state binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        some = pd.concat(list(rows)).sort_values("frame", kind="stable")
        last, state = -1, self.start()
        if self.value.exists():
            last, held = self.value.get()
            state = pickle.loads(bytes(held))
        out: list[tuple] = []
        for frame, each in some[some.frame > last].groupby("frame", sort=True):
            state, made = self.step(state, int(frame), each)
            out += [(key[0], *m) for m in made]
            last = int(frame)
        self.value.update((last, pickle.dumps(state)))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def _run(stream: DataFrame, start: Callable, step: Callable, schema: str) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]
    return stream.groupBy("clip_id").transformWithStateInPandas(Folded(start, step, columns), schema, "Append", "None")


def cut_stream(candidates: DataFrame, gap: int) -> DataFrame:
    """Accepted cuts of a stream of candidates (clip_id, frame)."""

    def step(state: object, frame: int, _: pd.DataFrame) -> tuple[object, list[tuple]]:
        return (frame, [(frame,)]) if state is None or frame - state >= gap else (state, [])

    return _run(candidates, lambda: None, step, "clip_id bigint, frame bigint")


def smooth_stream(path: DataFrame, width: int, fps: float = 30.0, conf: Config = DEFAULT) -> DataFrame:
    """Smoothed centres of a stream of (clip_id, frame, cx, is_cut)."""

    def step(state: object, frame: int, rows: pd.DataFrame) -> tuple[object, list[tuple]]:
        x, cut = float(rows.cx.iloc[-1]), bool(rows.is_cut.iloc[-1])
        if state is None:
            return x, [(frame, x, False)]
        cx, jumps = smooth([state, x], [False, cut], width, fps, conf)
        return cx[-1], [(frame, cx[-1], jumps[-1])]

    return _run(path, lambda: None, step, "clip_id bigint, frame bigint, cx double, jump boolean")


def focus_stream(faces: DataFrame, src_w: int, src_h: int, fps: float = 30.0, conf: Config = DEFAULT) -> DataFrame:
    """Key frames of a stream of faces (clip_id, frame, face_idx, cx, area, conf, speaking, cut, total_frames)."""

    def step(state: Focus, frame: int, rows: pd.DataFrame) -> tuple[object, list[tuple]]:
        some = rows[rows.face_idx.notna()].sort_values("face_idx")
        found = [Face(r.cx, r.area, r.conf) for r in some.itertuples()]
        k = clamped(focus_step(state, frame, found, some.speaking.tolist(), bool(rows["cut"].iloc[0]), src_w, src_h, fps, conf), src_w, src_h, int(rows.total_frames.iloc[0]))
        return state, [(k.frame, k.cx, k.hard, k.reset, k.change)]

    return _run(faces, Focus, step, "clip_id bigint, frame bigint, cx double, hard boolean, reset boolean, change boolean")
