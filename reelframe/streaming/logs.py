"""Live logs: text that comes in pieces of any size as whole lines, and a tail that is kept up to date.

A piece may end within a line; what has no end yet is kept as state until the rest comes. Pieces of a log are taken in order of
their numbers (from 0): one that comes too early waits, one that came already is dropped. The tail of each batch is made from
that of the batch before it, under the batch's number, so a batch that is run again gives the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reelframe.operators.logs import TAIL

LINE = "log_id bigint, seq bigint, part int, line string"


class Lines(StatefulProcessor):
    """Whole lines of a log; seq counts them, part the pieces of one between carriage returns."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.early = handle.getMapState("early", "piece bigint", "text string, last boolean")
        self.open = handle.getValueState("open", "next bigint, seq bigint, half string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        due, seq, half = self.open.get() if self.open.exists() else (0, 0, "")
        for some in rows:
            for piece, text, last in zip(some.piece.tolist(), some.text.tolist(), some["last"].tolist(), strict=True):
                if piece >= due and not self.early.containsKey((int(piece),)):
                    self.early.updateValue((int(piece),), (text or "", bool(last)))
        made: list[tuple] = []
        while self.early.containsKey((due,)):
            text, last = self.early.getValue((due,))
            self.early.removeKey((due,))
            *whole, half = (half + text).split("\n")
            if last and half:
                whole, half = [*whole, half], ""
            for line in whole:
                made += [(key[0], seq, k, part) for k, part in enumerate(line.split("\r"))]
                seq += 1
            due += 1
        self.open.update((due, seq, half))
        yield pd.DataFrame(made, columns=["log_id", "seq", "part", "line"])

    def close(self) -> None:
        pass


def line_stream(pieces: DataFrame) -> DataFrame:
    """LINE rows of a stream of pieces (log_id, piece, text, last). The last piece of a log ends its line too."""
    return pieces.groupBy("log_id").transformWithStateInPandas(Lines(), LINE, "Append", "None")


def tail_at(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    return spark.read.schema(LINE).parquet(f"{folder}/batch={batch}")


def kept_tail(folder: str, most: int = TAIL) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over line_stream: each batch's tail, its log's last lines, at folder/batch=<number>; that of two batches
    before goes."""

    def of(lines: DataFrame, batch: int) -> None:
        spark = lines.sparkSession
        both = lines.select("log_id", "seq", "part", "line")
        if batch > 0:
            both = both.union(tail_at(spark, folder, batch - 1))
        by = Window.partitionBy("log_id").orderBy(F.desc("seq"), F.desc("part"))
        last = both.withColumn("k", F.row_number().over(by)).where(F.col("k") <= most).drop("k")
        last.write.mode("overwrite").parquet(f"{folder}/batch={batch}")
        if batch > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={batch - 2}")
            old.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(old, True)

    return of
