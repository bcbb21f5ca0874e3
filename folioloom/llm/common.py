"""Helpers that the training-data operators share: durable tables, input columns, skew-safe lookups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with at least 1/HEAVY_SHARE of the rows is heavy; so there are at most HEAVY_SHARE heavy keys.
HEAVY_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder for durable intermediate tables: ``spark.checkpoint.dir``.

    Where the setting is absent (tests, one machine) a temporary folder takes its place; on a cluster that
    would be a folder that executors don't share, so there its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="folioloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage durably: the files outlive any executor, so what follows never recomputes what came before.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(settled: DataFrame) -> None:
    """Delete the files of a settled table that nothing will read again."""
    context = settled.sparkSession.sparkContext
    for file in settled.inputFiles()[:1]:
        folder = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), null text as the empty one: other columns, whatever their names, never get into a plan."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Left join of ``rows`` to ``table`` (one row a key) where a few keys may hold most of ``rows``.

    ``table[weight]`` is the number of ``rows`` with that key, ``total`` the number of all ``rows``. Keys with a
    HEAVY_SHARE-th of all rows number HEAVY_SHARE at most, so they are broadcast and their rows never shuffled; all
    other keys are shuffled, none of them large. ``rows`` is read twice and so should be a settled table.
    """
    heavy_from = max(2, total // HEAVY_SHARE)
    heavy = F.broadcast(table.where(F.col(weight) >= heavy_from))
    light = table.where(F.col(weight) < heavy_from)
    return rows.join(heavy, key).unionByName(
        rows.join(heavy.select(key), key, "left_anti").join(light, key, "left"), allowMissingColumns=True
    )


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function made once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return df.mapInArrow(run, schema)


def clip01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
