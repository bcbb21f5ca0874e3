"""Task and file lifecycles kept up to date from a stream of events; see ``operators.lifecycle`` for what events do."""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.lifecycle import Machine

CHANGES = "task_id long, file_id long, status string, retries long, seq long"


class _Files(MutableMapping):
    """A task's files in Spark's keyed state, read once a batch as far as they are asked for."""

    def __init__(self, state):
        self.state, self.read, self.changed = state, {}, set()

    def __getitem__(self, key):
        if key not in self.read:
            found = self.state.getValue((key,))
            self.read[key] = None if found is None else tuple(found)
        if self.read[key] is None:
            raise KeyError(key)
        return self.read[key]

    def __setitem__(self, key, value):
        self.read[key] = value
        self.changed.add(key)

    def __delitem__(self, key):
        raise TypeError("files stay")

    def __iter__(self):
        stored = {k[0] for k in self.state.keys()}
        return iter(sorted(stored | {k for k, v in self.read.items() if v is not None}))

    def __len__(self):
        return sum(1 for _ in self)

    def save(self):
        for key in self.changed:
            self.state.updateValue((key,), self.read[key])


class Lifecycle(StatefulProcessor):
    """Takes in the events of a task batch by batch, those of one batch by seq, and tells what has changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.task = handle.getValueState("task", "status string, waiting int")
        self.files = handle.getMapState("files", "file_id long", "status string, retries long, ended boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  names that Spark calls
        status, waiting = tuple(self.task.get() or ()) or ("draft", 0)
        files = _Files(self.files)
        machine, last = Machine(files, status, waiting), None
        for r in sorted(rows, key=lambda r: r["seq"]):
            machine.apply(r["action"], r["file_id"], r["outcome"])
            last = r["seq"]
        files.save()
        self.task.update((machine.status, machine.waiting))
        for f in sorted(files.changed):
            state, retries, _ = files[f]
            yield Row(task_id=key[0], file_id=f, status=state, retries=retries, seq=last)
        yield Row(task_id=key[0], file_id=None, status=machine.status, retries=0, seq=last)

    def close(self) -> None:
        pass


def changes(log: DataFrame) -> DataFrame:
    """A streaming log -> (task_id, file_id, status, retries, seq): after each batch its tasks and the files that changed.

    Needs the RocksDB state store. A task's events must come in order from batch to batch; within one they are sorted.
    """
    known = log.where("task_id is not null").groupBy("task_id")
    return known.transformWithState(Lifecycle(), CHANGES, outputMode="Update", timeMode="None")


def start(log: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the changes as Parquet until all that is there has been read."""

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is done again after a failure replaces its own files
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return changes(log).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(changed: DataFrame) -> DataFrame:
    """Each task's and file's last change."""
    w = Window.partitionBy("task_id", "file_id").orderBy(F.desc("batch"))
    return changed.withColumn("k", F.row_number().over(w)).where("k = 1").select("task_id", "file_id", "status", "retries")
