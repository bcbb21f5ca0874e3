"""Office files as DataFrames: binary scans, parsed on the executors, a failure a file as a column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension
from . import ooxml

#: A page reader: file content -> texts of its pages. PDF and OCR readers are plugged in here.
Reader = Callable[[bytes], list[str]]
READERS: dict[str, Reader] = {".docx": ooxml.docx_pages, ".doc": ooxml.docx_pages, ".pptx": ooxml.pptx_slides}
#: What pandas reads as null in a sheet of text.
NA_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def scan(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, filename, extension, size, content) of the files in a folder, without lock files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    name = F.regexp_replace(F.col("path"), "^.*/", "")
    return files.select("path", name.alias("filename"), extension(name).alias("extension"), F.col("length").alias("size"), "content").where(~F.col("filename").startswith("~$"))


def pages(files: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """(filename, page_num, text, error_message): a row a page; a file that can't be read has one row with its error."""
    table = READERS | (readers or {})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for name, ext, content in zip(part["filename"], part["extension"], part["content"], strict=True):
                reader = table.get(ext)
                try:
                    if reader is None:
                        raise ValueError(f"no reader for {ext or 'files without an ending'}")
                    out += [(name, k, text, None) for k, text in enumerate(reader(bytes(content)), 1)]
                except Exception as e:  # noqa: BLE001  a file may be broken in any way
                    out.append((name, None, None, str(e)))
            yield pd.DataFrame(out, columns=["filename", "page_num", "text", "error_message"]).astype({"page_num": "Int32"})

    return files.select("filename", "extension", "content").mapInPandas(run, "filename string, page_num int, text string, error_message string")


def sheet_cells(files: DataFrame, sheet: str | None = None) -> DataFrame:
    """(filename, sheet, row, col, value) of the filled cells of all workbooks."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["filename"], part["content"], strict=True):
                rows = [(name, *cell) for cell in ooxml.xlsx_cells(bytes(content), sheet)]
                yield pd.DataFrame(rows, columns=["filename", "sheet", "row", "col", "value"])

    return files.select("filename", "content").mapInPandas(run, "filename string, sheet string, row int, col int, value string")


def sheet_table(cells: DataFrame, header_row: int = 1, na: bool = False) -> DataFrame:
    """One sheet's cells as a table of text columns and row numbers; the headers, a row of one sheet, go over the driver."""
    heads = sorted((r["col"], r["value"]) for r in cells.where(F.col("row") == header_row).select("col", "value").collect())
    seen: dict[str, int] = {}
    columns = []
    for c, v in heads:
        n = seen[v] = seen.get(v, 0) + 1
        columns.append((c, v if n == 1 else f"{v}.{n - 1}"))
    value = F.when(F.col("value").isin(*NA_TEXTS), None).otherwise(F.col("value")) if na else F.col("value")
    body = cells.where(F.col("row") > header_row).withColumn("value", value).where("value is not null")
    return body.groupBy("row").agg(*(F.max(F.when(F.col("col") == c, F.col("value"))).alias(n) for c, n in columns)).withColumnRenamed("row", "_row")
