"""Task and file lifecycles from an event log: the state that start, finish, cancel and retry leave behind.

A log has task_id, seq (the order within a task), action, file_id and outcome:

* ``add`` puts a pending file into a draft task; a file that is there already, or a task that isn't a draft, rejects it.
* ``start`` makes a draft with a pending file run; all its pending files are processed.
* ``finish`` ends a file that is processed as success, needs_review or failed. When the last of the files that were started has
  ended for the first time, the run is over: the task is completed, or runs on if one of its files has been retried meanwhile.
* ``cancel`` takes pending files out, and cancels a task that is a draft or runs; what is processed goes on.
* ``retry`` processes a failed or cancelled file again; the task's status stays.

``states`` evaluates a whole log by windows and aggregates; ``streaming.lifecycle`` keeps the same states row by row.
"""

from __future__ import annotations

from collections.abc import MutableMapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACTIONS = ("add", "start", "finish", "cancel", "retry")
LOG = "task_id long, seq long, action string, file_id long, outcome string"
STATES = "task_id long, file_id long, status string, retries long"


@dataclass
class Machine:
    """One task: ``waiting`` is how many started files have not ended yet, ``files`` has (status, retries, has ended once)."""

    files: MutableMapping[int, tuple[str, int, bool]]
    status: str = "draft"
    waiting: int = 0

    def apply(self, action: str, file_id: int | None = None, outcome: str | None = None) -> bool:
        """One event; False if the states as they are reject it."""
        state, retries, ended = (self.files.get(file_id) or (None, 0, False)) if file_id is not None else (None, 0, False)
        if action == "add" and file_id is not None and state is None and self.status == "draft":
            self.files[file_id] = ("pending", 0, False)
        elif action == "start" and self.status == "draft" and (pending := self._in("pending")):
            self.status, self.waiting = "running", len(pending)
            for f in pending:
                self.files[f] = ("processing", 0, False)
        elif action == "finish" and state == "processing" and outcome in ("success", "needs_review", "failed"):
            self.files[file_id] = (outcome, retries, True)
            if self.waiting and not ended:
                self.waiting -= 1
                if not self.waiting:
                    self.status = "running" if self._in("processing") else "completed"
        elif action == "cancel":
            for f in self._in("pending"):
                self.files[f] = ("cancelled", 0, True)
            if self.status in ("draft", "running"):
                self.status = "cancelled"
        elif action == "retry" and state in ("failed", "cancelled"):
            self.files[file_id] = ("processing", retries + 1, ended)
        else:
            return False
        return True

    def _in(self, status: str) -> list[int]:
        return [f for f, s in self.files.items() if s[0] == status]


def states(log: DataFrame) -> DataFrame:
    """(task_id, file_id, status, retries) after the whole log: a row a file, and one with null file_id a task that has any event.

    No task is folded in order. Until a task has started or been cancelled only ``add`` matters, so both moments are minima over
    the task. From then on its files are independent, and each goes to and fro: of a row of equal actions the first counts. Task and file
    facts are aggregated before they are shuffled; a task of whatever size is only ever grouped by file.
    """
    log = log.select("task_id", "seq", "action", "file_id", "outcome").where(F.col("action").isin(*ACTIONS))

    def first(action: str):
        return F.min(F.when(F.col("action") == action, F.col("seq")))

    marks = log.groupBy("task_id").agg(F.min(F.when((F.col("action") == "add") & F.col("file_id").isNotNull(), F.col("seq"))).alias("added"), first("cancel").alias("cancelled"))
    before = (F.col("seq") > F.col("added")) & (F.col("seq") < F.coalesce("cancelled", F.lit((1 << 63) - 1)))
    started = log.where("action = 'start'").join(marks, "task_id").where(before).groupBy("task_id").agg(F.min("seq").alias("started"))
    tasks = marks.join(started, "task_id", "left").withColumn("closed", F.coalesce("started", "cancelled"))

    filed = log.where("file_id is not null and action in ('add', 'finish', 'retry')").join(tasks, "task_id")
    open_ = F.coalesce("closed", F.lit((1 << 63) - 1))
    known = filed.where((F.col("action") == "add") & (F.col("seq") < open_)).groupBy("task_id", "file_id").agg(F.first("started").alias("started"), F.first("closed").alias("closed"))

    # what a file went through once its task was closed: first a finish if the task ran, a retry if it was cancelled
    by_file = Window.partitionBy("task_id", "file_id").orderBy("seq")
    fits = (F.col("action") == "retry") | F.col("outcome").isin("success", "needs_review", "failed")
    steps = filed.where((F.col("action") != "add") & (F.col("seq") > F.col("closed")) & fits).join(known.select("task_id", "file_id"), ["task_id", "file_id"], "left_semi")
    awaited = F.when(F.col("started").isNotNull(), "finish").otherwise("retry")
    steps = steps.withColumn("begun", F.max((F.col("action") == awaited).cast("int")).over(by_file)).where("begun = 1")
    turns = steps.withColumn("last", F.lag("action").over(by_file)).where("last is null or last <> action")
    good = F.max(F.when(F.col("outcome").isin("success", "needs_review") & (F.col("action") == "finish"), 1).otherwise(0))
    turns = turns.withColumn("over", good.over(by_file.rowsBetween(Window.unboundedPreceding, -1))).where("over is null or over = 0")
    ends = turns.groupBy("task_id", "file_id").agg(
        F.max_by(F.when(F.col("action") == "retry", "processing").otherwise(F.col("outcome")), "seq").alias("now"),
        F.count_if(F.col("action") == "retry").alias("retries"),
        F.min(F.when(F.col("action") == "finish", F.col("seq"))).alias("ended"),
    )
    asleep = F.when(F.col("started").isNotNull(), "processing").when(F.col("closed").isNotNull(), "cancelled").otherwise("pending")
    files = known.join(ends, ["task_id", "file_id"], "left").select("task_id", "file_id", F.coalesce("now", asleep).alias("status"), F.coalesce("retries", F.lit(0)).cast("long").alias("retries"), "ended")

    # the run's end, what was processed then, and cancels since
    runs = files.groupBy("task_id").agg(F.when(F.count_if(F.col("ended").isNull()) == 0, F.max("ended")).alias("run_end"))
    tasks = tasks.join(runs, "task_id", "left")
    at_end = turns.select("task_id", "file_id", "action", "seq").join(tasks.where("started is not null and run_end is not null").select("task_id", "run_end"), "task_id").where("seq <= run_end")
    busy = at_end.groupBy("task_id", "file_id").agg(F.max_by("action", "seq").alias("action")).groupBy("task_id").agg((F.count_if(F.col("action") == "retry") > 0).alias("busy"))
    cancels = log.where("action = 'cancel'").join(tasks.select("task_id", "run_end"), "task_id").groupBy("task_id").agg(
        F.max((F.col("seq") > F.col("run_end")).cast("int")).alias("since_end"))
    t = tasks.join(busy, "task_id", "left").join(cancels, "task_id", "left")
    over = F.when(~F.coalesce("busy", F.lit(False)), "completed").when(F.col("since_end") == 1, "cancelled").otherwise("running")
    status = (
        F.when(F.col("started").isNull(), F.when(F.col("cancelled").isNotNull(), "cancelled").otherwise("draft"))
        .when(F.col("run_end").isNotNull(), over)
        .when(F.col("cancelled").isNotNull(), "cancelled")
        .otherwise("running")
    )
    return files.drop("ended").unionByName(t.select("task_id", F.lit(None).cast("long").alias("file_id"), status.alias("status"), F.lit(0).cast("long").alias("retries")))
