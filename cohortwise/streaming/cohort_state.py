"""Cohort sums kept up to date by a stream of patients (A1-A9 as maintained state).

All measures of a cohort report are additive sums, so a batch of new patients is summed per cohort and added
to the stored sums; the report is finished from these without the rows. The stored table has a row per
cohort. Each batch writes a new version under its own number, so a batch that runs again after a failure
starts from the version before it and gives the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.cohorts import CohortSums
from ..operators.features import prepare_patients

KEPT = 2  # versions that stay


class CohortState:
    """Stored sums per cohort below `folder`, which all executors see."""

    def __init__(self, spark: SparkSession, folder: str, sums: CohortSums, keys: Sequence[str], as_of=None):
        if sums.score_first and sums.scope == "cohort":
            raise ValueError("a network fills nulls with means of the whole cohort before it scores; use training means")
        self.spark, self.folder, self.sums, self.keys, self.as_of = spark, folder.rstrip("/"), sums, list(keys), as_of

    def _files(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch-*/_SUCCESS")
        return jvm, path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        _, files, pattern = self._files()
        return sorted(int(f.getPath().getParent().getName().removeprefix("batch-")) for f in files.globStatus(pattern) or [])

    def _path(self, batch: int) -> str:
        return f"{self.folder}/batch-{batch:012d}"

    def merge(self, patients: DataFrame, batch: int) -> None:
        """Adds a batch of raw patients; called again with the same number it replaces what it wrote."""
        new = self.sums.aggregate(prepare_patients(patients, self.as_of), self.keys)
        before = [v for v in self.versions() if v < batch]
        if before:
            new = self.sums.combine(self.spark.read.parquet(self._path(before[-1])).unionByName(new), self.keys)
        # Few rows: one per cohort.
        new.write.mode("overwrite").parquet(self._path(batch))
        jvm, files, _ = self._files()
        for old in before[: -(KEPT - 1)] if KEPT > 1 else before:
            files.delete(jvm.org.apache.hadoop.fs.Path(self._path(old)), True)

    def current(self) -> DataFrame:
        """The stored sums after the last complete batch."""
        found = self.versions()
        if not found:
            raise ValueError(f"no batch below {self.folder}")
        return self.spark.read.parquet(self._path(found[-1]))

    def report(self, min_rows: int | None = None) -> DataFrame:
        """The report `cohort_summary` gives for all patients seen so far."""
        return self.sums.finish(self.current(), self.keys, min_rows)


def maintain(
    stream: DataFrame, state: CohortState, checkpoint: str, ids: Sequence[str], event_time: str | None = None, delay: str = "7 days",
    available_now: bool = True,
) -> StreamingQuery:
    """Starts the stream that feeds the state.

    A patient row counts once per `ids`, however often it arrives. With `event_time` a repetition is known
    as one while it is at most `delay` older than the newest row, after which its id is forgotten and
    rows that late are left out; without it all ids are remembered.
    """
    if event_time:
        once = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(ids))
    else:
        once = stream.dropDuplicates(list(ids))
    writer = once.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(state.merge)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
