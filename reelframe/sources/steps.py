"""Intermediate results that outlive lost executors."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """The frame, written to the folder that spark.checkpoint.dir names, and read from there from now on. In local mode,
    where that may be unset, a temporary folder serves; on a cluster it has to be set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="reelframe-"))
    return df.checkpoint()
