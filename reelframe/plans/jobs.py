"""The crop of many clips as a job that can be taken up again.

Timelines, samples and paths are tables bucketed by clip_id, so no step shuffles: rows of a clip lie in one bucket from the first
to the last. A step works on the clips that its own table lacks; what a run adds becomes visible as a whole or not at
all, so after a failure the next run goes on with what is open.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from reelframe.config import DEFAULT, Config
from reelframe.operators import crop


@dataclass
class CropJob:
    """Tables <name>_timeline, <name>_samples and <name>_paths, with their files in folder, which all machines share."""

    spark: SparkSession
    name: str
    folder: str
    buckets: int = 64

    def _append(self, rows: DataFrame, table: str) -> None:
        whole = f"{self.name}_{table}"
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "clip_id").sortBy("clip_id").option("path", f"{self.folder}/{table}").saveAsTable(whole)

    def table(self, table: str) -> DataFrame | None:
        whole = f"{self.name}_{table}"
        return self.spark.table(whole) if self.spark.catalog.tableExists(whole) else None

    def _open(self, source: str, target: str) -> DataFrame:
        """The rows of clips that the target lacks."""
        rows, done = self.table(source), self.table(target)
        return rows if done is None else rows.join(done.select("clip_id").distinct(), "clip_id", "left_anti")

    def add(self, timeline: DataFrame) -> None:
        """New clips' timelines (crop.timeline), whole clips each time; they are dealt to their buckets here, once."""
        self._append(timeline.repartition(self.buckets, "clip_id"), "timeline")

    def samples(self, conf: Config = DEFAULT) -> DataFrame:
        return crop.samples(self._open("timeline", "samples"), conf)

    def paths(self, conf: Config = DEFAULT) -> DataFrame:
        return crop.paths(self._open("samples", "paths"), conf, together=True)

    def run(self, conf: Config = DEFAULT) -> None:
        """Brings samples, then paths, up to date. Clips without media or frames have no rows and are looked at each time."""
        self._append(self.samples(conf), "samples")
        self._append(self.paths(conf), "paths")
