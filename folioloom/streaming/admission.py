"""Continuous admission of files: an extension beyond the reference, which polls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import extension
from ..operators.results import ACCEPTED

FILES = "filename string, size long, arrived timestamp"


def admitted(spark: SparkSession, folder: str, delay: str = "1 day") -> DataFrame:
    """Arrivals listed as JSON lines in ``folder``: accepted kinds, each (filename, size) once within ``delay``."""
    arrivals = spark.readStream.schema(FILES).json(folder)
    return arrivals.where(extension(F.col("filename")).isin(*ACCEPTED)).withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["filename", "size"])


def start(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append admitted files as Parquet until all that is there has been read."""
    return files.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
