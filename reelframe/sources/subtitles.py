"""A sink for subtitle files, one for each clip, that are all there or none.

Each task writes its clips' files to a folder of its own attempt. When all tasks are done, the files that they report are moved to
their names, so a clip that is written again replaces its file; when one fails, and after any end, the job's folder goes
away, with what failed or repeated attempts left in it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "clip_subtitles"
PREFIX, SUFFIX, JOB = "clip_", ".ass", "_writing-"


@dataclass
class Written(WriterCommitMessage):
    """The files of one task: names by the places they lie at."""

    files: dict[str, str]


class SubtitleWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, JOB + uuid.uuid4().hex

    def _store(self) -> tuple[fs.FileSystem, str]:
        store, folder = fs.FileSystem.from_uri(self.path)
        return store, folder.rstrip("/")

    def begin(self) -> None:
        store, folder = self._store()
        store.create_dir(f"{folder}/{self.job}", recursive=True)

    def write(self, iterator: Iterator[Row]) -> Written:
        """Rows (clip_id, ord, line), each clip's one after the other by ord."""
        store, folder = self._store()
        own = f"{folder}/{self.job}/{uuid.uuid4().hex}"
        # Not with its parents: a task that outlives its job finds no folder any more.
        store.create_dir(own, recursive=False)
        files: dict[str, str] = {}
        clip = last = out = None
        try:
            for row in iterator:
                if row.clip_id != clip:
                    if out:
                        out.close()
                    name = f"{PREFIX}{row.clip_id}{SUFFIX}"
                    if f"{own}/{name}" in files:
                        raise ValueError(f"the lines of clip {row.clip_id} are not together")
                    out, clip, last = store.open_output_stream(f"{own}/{name}"), row.clip_id, None
                    files[f"{own}/{name}"] = name
                if last is not None and row.ord < last:
                    raise ValueError(f"the lines of clip {clip} are out of order")
                last = row.ord
                out.write((row.line + "\n").encode())
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = self._store()
        if self.overwrite:
            kept = {name for m in messages if m for name in m.files.values()}
            for old in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if old.is_file and old.base_name.startswith(PREFIX) and old.base_name.endswith(SUFFIX) and old.base_name not in kept:
                    store.delete_file(old.path)
        for m in messages:
            for at, name in (m.files if m else {}).items():
                store.move(at, f"{folder}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, folder = self._store()
        if store.get_file_info(f"{folder}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/{self.job}")


class SubtitleSource(DataSource):
    """Format `clip_subtitles`, option path: a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "clip_id bigint, ord bigint, line string"

    def writer(self, schema: object, overwrite: bool) -> SubtitleWriter:
        made = SubtitleWriter(self.options["path"], overwrite)
        made.begin()
        return made


def registered(spark: SparkSession) -> str:
    """The format's name, known to the session from now on."""
    spark.dataSource.register(SubtitleSource)
    return FORMAT
