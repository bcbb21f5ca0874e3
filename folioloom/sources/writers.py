"""Exports. Files a person opens are made on the driver from bounded results; data goes to Spark's own writers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import ooxml

#: Rows an office file may have; a sheet can't have more.
SHEET_ROWS = 1_048_575


def _rows(df: DataFrame) -> list[list]:
    rows = df.limit(SHEET_ROWS + 1).collect()
    if len(rows) > SHEET_ROWS:
        raise ValueError(f"more than {SHEET_ROWS} rows don't fit a sheet; write them with to_json or to_csv")
    return [list(r) for r in rows]


def results_xlsx(wide: DataFrame, log: DataFrame | None = None) -> bytes:
    """The results sheet and, if given, the log sheet."""
    sheets = {"results": [wide.columns, *_rows(wide)]}
    if log is not None:
        sheets["log"] = [log.columns, *_rows(log)]
    return ooxml.xlsx_bytes(sheets)


def results_docx(values: DataFrame, title: str = "results") -> bytes:
    """(filename, name, shown) in order: a heading a file, a line a field, （未找到） for nothing."""
    out, last = [("Heading1", title)], None
    for filename, name, shown in _rows(values.select("filename", "name", "shown")):
        if filename != last:
            out.append(("Heading2", filename))
            last = filename
        out.append(("", f"{name}: {shown or '（未找到）'}"))
    return ooxml.docx_bytes(out)


def markdown_xlsx(rows: DataFrame) -> bytes:
    """A sheet for each table of ``console.markdown_rows``."""
    sheets: dict[str, list] = {}
    for table, _, cells in _rows(rows.orderBy("table_no", "row_no").select("table_no", "row_no", "cells")):
        sheets.setdefault(f"table {table + 1}", []).append(cells)
    return ooxml.xlsx_bytes(sheets)


def renamed_zip(manifest: DataFrame, contents: dict[str, bytes], report: bytes, report_name: str = "匹配清单.xlsx") -> bytes:
    """(file_id, output_filename) of checked matches, with the bytes of their files, and the report."""
    return ooxml.zip_bytes([*((name, contents[fid]) for fid, name in _rows(manifest.select("file_id", "output_filename"))), (report_name, report)])


def to_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def to_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)
