"""Extraction runs: each file's text through prompt and model to typed fields, issues and a status.

What goes wrong with a file at any step (reading, an empty text, the model, its answer) is that file's error message; it
stops no other file and no task. The model is asked once a run: its answers are kept as a table, and results, fields and issues are
projections of it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import coerced
from ..functions.text import verify_snippet
from .backends import Backend, stub
from .durable import keep

# How much text a prompt takes, and what stands in a longer one.
MAX_PROMPT, CHUNK, OVERLAP, NARROWED, ATTEMPTS = 80_000, 12_000, 500, 6_000, 3
#: Files whose prompts a task holds as Python strings at a time.
AT_ONCE = 64
CHUNK_MARK, CUT_MARK = "[片段 %d]\n", "\n[… 文档过长，已截断，共 %s 字符 …]"
# Messages of results and issues.
NO_TEXT = "无法从文件中提取文本，请检查文件是否损坏或加密。"
GAVE_UP = "提取失败，已重试 %d 次。最后错误：%s"
NOT_FOUND, EMPTY = "必填字段「%s」未找到对应内容。", "必填字段 [%s] 未找到值"
# What a prompt says of each type.
TYPE_HINTS = {"text": "string", "long_text": "string（长文本）", "integer": "integer", "decimal": "number", "date": "YYYY-MM-DD string", "boolean": "true/false", "list": "array of strings"}

OPEN, CLOSE = "\n<<<document\n", "\ndocument>>>\n"


class Run(NamedTuple):
    results: DataFrame
    fields: DataFrame
    issues: DataFrame


def prompt_text(text: Column) -> Column:
    """The text itself up to MAX_PROMPT characters; of a longer one the whole chunks that fit, numbered, and a mark that it is cut.

    The chunk after those is longer than the room they leave, whatever the length, so their number is fixed.
    """
    many = MAX_PROMPT // CHUNK
    parts = [F.concat(F.lit(CHUNK_MARK % (i + 1)), F.substring(text, i * (CHUNK - OVERLAP) + 1, CHUNK)) for i in range(many)]
    mark = F.format_string(CUT_MARK, F.format_number(F.length(text), 0))
    return F.when(F.length(text) <= MAX_PROMPT, text).otherwise(F.concat_ws("\n\n", *parts, mark))


def prompt_head(template: DataFrame) -> DataFrame:
    """One row, ``head``: what to extract, a line a field in order; the fields are those of one template."""
    hint = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in TYPE_HINTS.items() for x in kv)), F.col("type")), F.lit("string"))
    extra = [F.concat(F.lit(f"; {label}: "), F.col(c)) for c, label in (("example", "example"), ("prompt_hint", "hint")) if c in template.columns]
    line = F.concat_ws("", F.lit('"'), "key", F.lit('" ('), "name", F.lit("): "), hint, F.when(F.col("required"), ", required").otherwise(", optional"), *extra)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"])
    intro = "Give one JSON object with these keys, each {\"value\": ..., \"source_snippet\": ...}; null where the document doesn't say.\n"
    return template.agg(F.concat(F.lit(intro), F.array_join(lines, "\n")).alias("head"))


class Unreadable(ValueError):
    """An answer that isn't JSON, not even with its fences, surroundings and quotes mended."""


def read_answer(answer: str) -> object:
    """The JSON value of an answer: of its fenced part or all of it, else its outermost object, else with Python's literals mended."""
    fenced = re.search(r"```(?:json)?\s*([\s\S]*?)```", answer or "", re.IGNORECASE)
    text = (fenced.group(1) if fenced else answer or "").strip()
    braces = re.search(r"\{[\s\S]*\}", text)
    mended = text.replace("'", '"').replace("None", "null").replace("True", "true").replace("False", "false")
    for candidate in (text, braces.group() if braces else None, mended):
        try:
            if candidate:
                return json.loads(candidate)
        except json.JSONDecodeError:
            continue
    raise Unreadable(f"not JSON: {(answer or '')[:300]!r}")


def _asked(backend: Backend, head: str, text: str, attempts: int) -> tuple[str | None, str | None, int]:
    """(answer as JSON, error, retries): before the last attempt, an unreadable answer narrows the text."""
    retries, last = 0, None
    for attempt in range(attempts):
        try:
            answer = read_answer(backend(head + OPEN + text + CLOSE))
        except Exception as e:  # noqa: BLE001  a backend may fail in any way
            last, retries = e, retries + 1
            if isinstance(e, Unreadable) and attempt == attempts - 2:
                text = text[:NARROWED]
            continue
        if isinstance(answer, dict):
            return json.dumps(answer, ensure_ascii=False), None, retries
        return None, GAVE_UP % (retries, f"no object: {json.dumps(answer, ensure_ascii=False)[:100]}"), 0
    return None, GAVE_UP % (retries, last), 0


def answered(files: DataFrame, template: DataFrame, backend: Backend = stub, attempts: int = ATTEMPTS) -> DataFrame:
    """(file_id, filename, text, error_message, retry_count, raw_json); the backend is asked only for files with a text.

    ``files``: file_id, filename, text; optional read_error (a reader's message) and earlier_retries (of the result that this
    run replaces, null without one). Repartition ``files`` to the parallelism the backend bears.
    """
    kind = files.schema["file_id"].dataType.simpleString()
    read_error = F.col("read_error") if "read_error" in files.columns else F.lit(None).cast("string")
    earlier = F.coalesce(F.col("earlier_retries") + 1, F.lit(0)) if "earlier_retries" in files.columns else F.lit(0)
    failed = F.coalesce(read_error, F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, NO_TEXT))
    rows = files.select("file_id", "filename", "text", failed.alias("error_message"), earlier.cast("int").alias("retry_count"), F.when(failed.isNull(), prompt_text(F.col("text"))).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(k, AT_ONCE) for b in batches for k in range(0, b.num_rows, AT_ONCE)):
            out = [
                (None, error, 0) if error is not None else _asked(backend, head, text, attempts)
                for head, text, error in zip(*(part[c].to_pylist() for c in ("head", "asked", "error_message")), strict=True)
            ]
            raw, errors, retries = zip(*out, strict=True)
            counts = [n + more for n, more in zip(part["retry_count"].to_pylist(), retries, strict=True)]
            made = [pa.array(errors, pa.string()), pa.array(counts, pa.int32()), pa.array(raw, pa.string())]
            yield pa.RecordBatch.from_arrays([part["file_id"], part["filename"], part["text"], *made], names=["file_id", "filename", "text", "error_message", "retry_count", "raw_json"])

    schema = f"file_id {kind}, filename string, text string, error_message string, retry_count int, raw_json string"
    return rows.crossJoin(F.broadcast(prompt_head(template))).mapInArrow(run, schema)


def run_extraction(files: DataFrame, template: DataFrame, backend: Backend = stub, attempts: int = ATTEMPTS, model: str = "stub") -> Run:
    """The results, fields and issues of all ``files`` (see ``answered``) under one ``template`` (key, name, type, required, ord).

    results: file_id, filename, status, error_message, retry_count, issue_count, model_used. A file with an error is failed and has no
    fields or issues; one with an issue needs_review; any other is a success. fields: one row a field of the template, with raw
    and typed values and the snippet, empty where the text doesn't have it. issues: type_invalid where a value
    doesn't fit, required_missing where a required field has none, or an empty text or list; in the fields' order.

    No step shuffles a text: a file's fields are made where its answer is. The template, small by nature, is broadcast.
    """
    asked = answered(files, template, backend, attempts)
    known = F.broadcast(template.select("key", "name", "type", "required", "ord"))
    entry = F.try_element_at(F.from_json("raw_json", "map<string,string>"), F.col("key"))
    cells = asked.join(known, F.col("error_message").isNull(), "left").withColumn("entry", entry)
    nested = F.when(F.col("entry").startswith("{"), F.from_json("entry", "struct<value:string,source_snippet:string>"))
    cells = cells.withColumn("nested", nested)
    raw = F.when(F.col("nested").isNotNull(), F.col("nested.value")).otherwise(F.col("entry"))
    snippet = F.left(F.coalesce("nested.source_snippet", F.lit("")), F.lit(150))
    cells = cells.select(
        "file_id", "filename", "error_message", "retry_count", "key", "name", "type", "required", "ord",
        raw.alias("raw_value"), verify_snippet(snippet, F.col("text")).alias("source_snippet"),
    )
    cells = keep(cells.withColumns(coerced(F.col("raw_value"), F.col("type"))), "extraction")
    fields = cells.where("key is not null").drop("filename", "error_message", "retry_count")
    issues = issues_of(fields)
    counted = cells.groupBy("file_id", "filename", "error_message", "retry_count").agg(F.coalesce(F.sum(_many()), F.lit(0)).alias("issue_count"))
    status = F.when(F.col("error_message").isNotNull(), "failed").when(F.col("issue_count") > 0, "needs_review").otherwise("success")
    results = counted.select("file_id", "filename", status.alias("status"), "error_message", "retry_count", "issue_count", F.lit(model).alias("model_used"))
    return Run(results, fields, issues)


def _nothing() -> Column:
    return F.coalesce("v_text", F.col("v_int").cast("string"), F.col("v_dec").cast("string"), "v_date", F.col("v_bool").cast("string"), F.array_join("v_list", "")).isNull()


def _blank() -> Column:
    return F.coalesce(F.col("v_text") == "", F.lit(False)) | F.coalesce(F.size("v_list") == 0, F.lit(False))


def _many() -> Column:
    return F.when(F.col("key").isNull(), 0).otherwise(F.col("type_invalid").cast("int") + (F.col("required") & (_nothing() | _blank())).cast("int"))


def issues_of(fields: DataFrame) -> DataFrame:
    """(file_id, key, name, issue_type, message, raw_value, ord) of fields as ``run_extraction`` gives them."""
    bad = F.when(F.col("type_invalid"), F.struct(F.lit("type_invalid").alias("issue_type"), F.concat("name", F.lit(": "), "raw_value", F.lit(" → "), "type").alias("message"), "raw_value"))
    absent = F.when(_nothing(), F.format_string(NOT_FOUND, "name")).when(_blank(), F.format_string(EMPTY, "name"))
    missing = F.when(F.col("required") & absent.isNotNull(), F.struct(F.lit("required_missing").alias("issue_type"), absent.alias("message"), F.when(_nothing(), F.col("raw_value")).alias("raw_value")))
    found = fields.withColumn("issue", F.explode(F.array_compact(F.array(bad, missing))))
    return found.select("file_id", "key", "name", "issue.issue_type", "issue.message", "issue.raw_value", "ord")
