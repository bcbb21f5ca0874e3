"""Results: admission, statuses, filters, pages, edits, upserts, export shapes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import edit_valid
from ..functions.text import extension

TERMINAL = ("success", "needs_review", "failed", "cancelled")
STATUSES = ("pending", "processing", "success", "needs_review", "failed", "cancelled")
ACCEPTED = (".pdf", ".docx")
#: 是 and 否, as exports show truth.
YES, NO = "是", "否"


def admit_files(files: DataFrame, accepted: tuple[str, ...] = ACCEPTED) -> DataFrame:
    """(filename, size, pos) -> with reason: null for admitted files, else unsupported or duplicate.

    The kind is checked first; of files equal in name and size the first by ``pos`` counts.
    """
    known = extension(F.col("filename")).isin(*accepted)
    w = Window.partitionBy("filename", "size").orderBy("pos")
    return files.withColumn("reason", F.when(~known, "unsupported").when(F.row_number().over(w) > 1, "duplicate"))


def status_counts(files: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return files.groupBy(*by).agg(F.count("*").alias("total"), *counts)


def run_figures(files: DataFrame, values: DataFrame) -> DataFrame:
    """One row: total, success, needs_review, failed, and edited, the files of which any value was edited by hand."""
    counts = status_counts(files).select("total", "success", "needs_review", "failed")
    edited = values.where("manually_edited").agg(F.count_distinct("file_id").alias("edited"))
    return counts.crossJoin(F.broadcast(edited))  # one row each


def admission_tally(judged: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Of files as ``admit_files`` judges them: accepted, and rejected in all and by reason."""
    reason = F.col("reason")
    return judged.groupBy(*by).agg(
        F.count_if(reason.isNull()).alias("accepted"), F.count_if(reason.isNotNull()).alias("rejected"),
        F.count_if(reason == "unsupported").alias("unsupported"), F.count_if(reason == "duplicate").alias("duplicate"),
    )


def progress(files: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of files in an end state, in per cent with one decimal; 0 without files."""
    done = F.count_if(F.col("status").isin(*TERMINAL))
    share = F.round(F.lit(100.0) * done / F.nullif(F.count("*"), F.lit(0)), 1)
    return files.groupBy(*by).agg(F.coalesce(share, F.lit(0.0)).alias("progress"))


def task_status(files: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """completed if all files have ended, running if any is pending or processing."""
    ended = F.bool_and(F.col("status").isin(*TERMINAL))
    return files.groupBy(*by).agg(F.when(ended, "completed").otherwise("running").alias("task_status"))


def required_missing(files: DataFrame, template: DataFrame, values: DataFrame) -> DataFrame:
    """(file_id, key) of required fields without a value: null, empty text and empty list are none."""
    wanted = files.select("file_id").crossJoin(F.broadcast(template.where("required").select("key")))
    there = values.where("raw_value is not null and raw_value not in ('', '[]')").select("file_id", "key")
    return wanted.join(there, ["file_id", "key"], "left_anti")


def file_status(files: DataFrame, issues: DataFrame) -> DataFrame:
    """failed with an error message, needs_review with an issue, else success."""
    n = issues.groupBy("file_id").agg(F.count("*").alias("issue_count"))
    j = files.join(n, "file_id", "left").withColumn("issue_count", F.coalesce("issue_count", F.lit(0)))
    failed = F.col("error_message").isNotNull()
    return j.withColumn("status", F.when(failed, "failed").when(F.col("issue_count") > 0, "needs_review").otherwise("success"))


def filter_results(results: DataFrame, status: str | None = None, keyword: str | None = None, has_issues: bool | None = None) -> DataFrame:
    """Status equality; a literal keyword in the file name in either case; with or without issues."""
    if status is not None:
        results = results.where(F.col("status") == status)
    if keyword:
        results = results.where(F.contains(F.lower("filename"), F.lit(keyword.lower())))
    if has_issues is not None:
        results = results.where((F.col("issue_count") > 0) == has_issues)
    return results


def page(results: DataFrame, order: list[str], number: int = 1, size: int = 50) -> DataFrame:
    """One page with the total before paging; sorted by top-k, so no full sort and no single-task window."""
    if number < 1 or not 1 <= size <= 200:
        raise ValueError("page starts at 1, size is 1 to 200")
    total = results.agg(F.count("*").alias("total"))
    return results.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))


def export_scope(results: DataFrame, scope: str, ids: list | None = None) -> DataFrame:
    """selected with ids: those; all: all; anything else: success and needs_review."""
    if scope == "selected" and ids:
        return results.where(F.col("file_id").isin(*ids))
    return results if scope == "all" else results.where(F.col("status").isin("success", "needs_review"))


def apply_edits(values: DataFrame, edits: DataFrame, template: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(values, rejected). Latest valid edit of each (file, key) wins; a file with any bad edit keeps none of its edits.

    ``edits``: file_id, key, new_value, seq. Bad: a key outside the template, or a value that doesn't fit its type. An
    edit of a field that has no value row yet adds one; its other columns are null.
    """
    typed = edits.join(F.broadcast(template.select("key", "type")), "key", "left")
    bad = F.col("type").isNull() | ~edit_valid(F.col("new_value"), F.col("type"))
    judged = typed.withColumn("bad", bad).withColumn("file_bad", F.max("bad").over(Window.partitionBy("file_id")))
    last = Window.partitionBy("file_id", "key").orderBy(F.desc("seq"))
    good = judged.where("not file_bad").withColumn("k", F.row_number().over(last)).where("k = 1").select("file_id", "key", "new_value", F.lit(True).alias("edited"))
    merged = values.join(good, ["file_id", "key"], "full")
    edited = F.coalesce("edited", F.lit(False))
    out = merged.withColumns({"raw_value": F.when(edited, F.col("new_value")).otherwise(F.col("raw_value")), "manually_edited": edited | F.coalesce("manually_edited", F.lit(False))})
    return out.drop("new_value", "edited"), judged.where("bad").select("file_id", "key", "new_value")


def recalculate_status(values: DataFrame, issues: DataFrame, template: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, issues) after edits: the issues of missing required fields are drawn up anew, and the status follows.

    ``values``: file_id, key, raw_value; ``issues``: file_id, key, issue_type, message; ``template``: key, name,
    required. A required field without a row, or whose value is null or empty, is missing. A file with a missing field
    or a ``type_invalid`` issue is ``needs_review``, every other one that has a value or issue ``success``.
    """
    required = F.broadcast(template.where("required").select("key", "name"))  # a template is what a person wrote
    files = values.select("file_id").union(issues.select("file_id")).distinct()
    filled = values.where("raw_value is not null and raw_value <> ''").select("file_id", "key")
    missing = files.crossJoin(required).join(filled, ["file_id", "key"], "left_anti")
    message = F.concat(F.lit("必填字段 ["), "name", F.lit("] 未找到值"))
    anew = missing.select("file_id", "key", F.lit("required_missing").alias("issue_type"), message.alias("message"))
    left = issues.where("issue_type <> 'required_missing'").select("file_id", "key", "issue_type", "message").union(anew)
    bad = left.where("issue_type in ('required_missing', 'type_invalid')").select("file_id").distinct().withColumn("bad", F.lit(True))
    status = F.when(F.col("bad"), "needs_review").otherwise("success")
    return files.join(bad, "file_id", "left").select("file_id", status.alias("status")), left


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Upsert: of each key the last row in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def retry_ordinal(attempts: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return attempts.withColumn("retry_count", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def rendered(one: Column, flag: Column, many: Column) -> Column:
    """Export text of a value: a list by commas, truth as 是 or 否, null as empty."""
    return F.coalesce(F.array_join(many, ", "), F.when(flag, YES).when(~flag, NO), one, F.lit(""))


def export_wide(files: DataFrame, template: list[tuple[str, str]], values: DataFrame) -> DataFrame:
    """A row a file and a column a template field, in template order: one aggregation with the keys given.

    ``template``: (key, column name). ``values``: file_id, key, shown.
    """
    cells = [F.max(F.when(F.col("key") == k, F.col("shown"))).alias(n) for k, n in template]
    wide = values.groupBy("file_id").agg(*cells)
    joined = files.join(wide, "file_id", "left")
    return joined.select(*files.columns, *(F.coalesce(n, F.lit("")).alias(n) for _, n in template))


def issue_log(issues: DataFrame) -> DataFrame:
    """(file_id, log): [name] message a line, in order."""
    listed = issues.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.concat(F.lit("["), "field_name", F.lit("] "), "message").alias("t")))).alias("l"))
    return listed.select("file_id", F.array_join(F.col("l.t"), "\n").alias("log"))


def doc_stats(pages: DataFrame) -> DataFrame:
    """Per file: pages, OCR pages, characters, words, mean OCR confidence over its OCR pages (0 without)."""
    from ..functions.text import char_count, word_count

    return pages.groupBy("file_id").agg(
        F.count("*").alias("page_count"),
        F.count_if(F.col("used_ocr")).alias("ocr_pages"),
        F.sum(char_count(F.col("text"))).alias("total_chars"),
        F.sum(word_count(F.col("text"))).alias("total_words"),
        F.coalesce(F.avg(F.when(F.col("used_ocr"), F.col("ocr_confidence"))), F.lit(0.0)).alias("avg_ocr_confidence"),
    )


def doc_text(pages: DataFrame, numbered: bool = False) -> DataFrame:
    """Pages of five characters or more in order, joined by a blank line; with ``numbered`` under a page heading."""
    from ..functions.text import char_count

    body = F.concat(F.lit("--- Page "), F.col("page_num").cast("string"), F.lit(" ---\n"), "text") if numbered else F.col("text")
    kept = pages.where(char_count(F.col("text")) >= 5).groupBy("file_id")
    listed = kept.agg(F.sort_array(F.collect_list(F.struct("page_num", body.alias("t")))).alias("l"))
    return listed.select("file_id", F.array_join(F.col("l.t"), "\n\n").alias("full_text"))


def choose_text(native: Column, ocr: Column, strip: Callable[[Column], Column] = F.trim) -> Column:
    """OCR text only where the native one has under 50 characters and OCR has over 1.2 times as many."""
    n, o = F.length(strip(native)), F.length(strip(ocr))
    return F.when((n < 50) & (o > n * F.lit(1.2)), ocr).otherwise(native)


def best_ocr(reads: DataFrame) -> DataFrame:
    """(file_id, page_num, psm_pos, text) -> the longest stripped text of each page; the first wins a tie."""
    return reads.groupBy("file_id", "page_num").agg(F.max_by("text", F.struct(F.length(F.trim("text")), -F.col("psm_pos"))).alias("text"))


def column_widths(rows: DataFrame, columns: list[str], cap: int = 50) -> DataFrame:
    w = [F.least(F.greatest(F.lit(len(c)), F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0))) + 2, F.lit(cap)).alias(c) for c in columns]
    return rows.agg(*w)
