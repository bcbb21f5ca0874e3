"""Lifecycles by windows, by stream, and by one machine a task in plain Python, over random logs."""

import random

import pytest

from folioloom.operators import lifecycle as L
from folioloom.streaming import lifecycle as S


def random_log(rng, tasks):
    rows = []
    for t in range(tasks):
        for s in range(rng.randrange(1, 26)):
            action = rng.choices(L.ACTIONS, [8, 1, 1, 0.2, 1] if s < 4 else [4, 1, 6, 0.4, 2])[0]
            rows.append((t, s, action, rng.choice([0, 1, 2, 2, None]), rng.choice(["success", "needs_review", "failed", "failed", "failed", None, "odd"])))
    return rows


def folded(rows):
    machines = {}
    for t, _, action, f, outcome in sorted(rows, key=lambda r: r[:2]):
        machines.setdefault(t, L.Machine({})).apply(action, f, outcome)
    return {(t, None, m.status, 0) for t, m in machines.items()} | {(t, f, s, r) for t, m in machines.items() for f, (s, r, _) in m.files.items()}


def test_windows_agree_with_the_fold(spark):
    rows = random_log(random.Random(3), 500)
    got = [tuple(r) for r in L.states(spark.createDataFrame(rows, L.LOG)).collect()]
    assert len(got) == len(set(got)) and set(got) == folded(rows)
    assert L.states(spark.createDataFrame([], L.LOG)).count() == 0


def test_rules():
    m = L.Machine({})
    assert not m.apply("start") and m.apply("add", 1) and not m.apply("add", 1) and m.apply("add", 2) and m.apply("start") and not m.apply("start") and not m.apply("add", 3)
    assert m.apply("finish", 1, "failed") and not m.apply("finish", 1, "success") and m.status == "running"
    assert m.apply("retry", 1) and not m.apply("retry", 2) and m.apply("finish", 2, "success") and m.status == "running"
    assert m.apply("finish", 1, "success") and m.status == "running"  # a retry doesn't refresh the task
    c = L.Machine({})
    assert c.apply("add", 1) and c.apply("cancel") and c.status == "cancelled" and c.files[1][0] == "cancelled" and not c.apply("start")
    assert c.apply("retry", 1) and c.apply("finish", 1, "needs_review") and c.status == "cancelled"


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_agrees_with_the_fold(spark, tmp_path, parts):
    rows = random_log(random.Random(parts), 40)
    log = spark.createDataFrame(rows, L.LOG)
    for k in range(parts):  # files in the order of seq, one a batch
        log.where(f"seq % 100 between {k * 26 // parts} and {(k + 1) * 26 // parts - 1}").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(L.LOG).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = S.start(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    assert query.exception() is None
    got = {tuple(r) for r in S.latest(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == folded(rows)
