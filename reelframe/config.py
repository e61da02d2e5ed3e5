"""Settings of the engine with their defaults; each can be set in the environment under the prefix REELFRAME_."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

PREFIX = "REELFRAME_"


@dataclass(frozen=True)
class Config:
    # The defaults.
    words_per_caption: int = 2
    face_sample_fps: float = 4.0
    scene_cut_score: float = 0.22
    scene_cut_hist: float = 0.14
    scene_cut_pixel: float = 0.08
    scene_cut_min_gap: float = 0.30
    focus_min_lock: float = 1.50
    focus_confirm: float = 0.85
    focus_area_ratio: float = 1.35
    focus_lost_grace: float = 0.80
    focus_match_distance: float = 0.35
    crop_deadzone: float = 0.07
    crop_min_deadzone_px: float = 36.0
    crop_smoothing_tau: float = 0.45
    crop_max_speed: float = 480.0
    lip_cooldown_1: float = 1.0
    lip_cooldown_2: float = 2.0
    lip_cooldown_3: float = 1.0
    lip_burst_window: float = 4.0
    lip_motion_weight: float = 0.6
    lip_smooth_sec: float = 0.5
    lip_min_motion: float = 3.0
    #: The manifest, the video, the folder for clips, and the texts of the channel and of the source's credit.
    json: str = ""
    video: str = ""
    outdir: str = "."
    channel: str = ""
    source_credit: str = ""

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Config:
        """Reads the settings that are in the environment; a number's value that is none raises ValueError."""
        env = dict(os.environ) if env is None else env
        given = {f.name: env[PREFIX + f.name.upper()] for f in fields(cls) if PREFIX + f.name.upper() in env}
        return cls(**{k: type(getattr(cls, k))(v) for k, v in given.items()})


#: As the environment has it when the engine is loaded.
DEFAULT = Config.from_env()
