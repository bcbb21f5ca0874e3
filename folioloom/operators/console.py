"""Conversations, prompts, Markdown answers and chunking."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T

BUDGET, SIZE, OVERLAP = 80_000, 12_000, 500


def last_messages(turns: DataFrame, most: int = 6) -> DataFrame:
    """(conv_id, history): the last messages in order, the user's as User, all others as Assistant."""
    recent = turns.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("k") <= most)
    line = F.concat(F.when(F.col("role") == "user", "User").otherwise("Assistant"), F.lit(": "), F.coalesce("text", F.lit("")))
    listed = recent.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("t")))).alias("l"))
    return listed.select("conv_id", F.array_join(F.col("l.t"), "\n").alias("history"))


def latest_by_role(turns: DataFrame, role: str) -> DataFrame:
    return turns.where(F.col("role") == role).groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


def transcript(turns: DataFrame) -> DataFrame:
    """(conv_id, transcript): [ROLE], then the text, messages apart by a blank line."""
    line = F.concat(F.lit("["), F.upper("role"), F.lit("]\n"), F.coalesce("text", F.lit("")))
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("t")))).alias("l"))
    return listed.select("conv_id", F.array_join(F.col("l.t"), "\n\n").alias("transcript"))


def chunk_rows(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_no, chunk): windows of ``size`` that overlap."""
    return docs.select("doc_id", F.posexplode(T.chunks(F.col("text"), size, overlap)).alias("chunk_no", "chunk"))


def within_budget(chunks: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Chunks of each document while their lengths add up to ``budget`` at most; truncated marks that some are left out."""
    w = Window.partitionBy("doc_id").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, 0)
    summed = chunks.withColumn("used", F.sum(F.length("chunk")).over(w))
    cut = F.max("used").over(Window.partitionBy("doc_id")) > budget
    return summed.withColumn("truncated", cut).where(F.col("used") <= budget)


@F.pandas_udf(ArrayType(StringType()))
def pack_paragraphs(text: pd.Series) -> pd.Series:
    """Paragraphs in order, packed into parts of at most 900 characters without line breaks; a longer paragraph is a part of its own.

    A text without a paragraph is one part, as it is; null stays null.
    """

    def pack(value: str | None) -> list[str] | None:
        if value is None:
            return None
        parts, room = [], 0
        for p in (p.strip() for p in value.split("\n") if p.strip()):
            if parts and len(p) <= room:
                parts[-1].append(p)
                room -= len(p)
            else:
                parts.append([p])
                room = 900 - len(p)
        return ["\n".join(p) for p in parts] or [value]

    return text.map(pack)


def chunk_list(items: Column, size: int) -> Column:
    """Slices of ``size``; an empty list gives one empty slice."""
    count = F.greatest(F.ceil(F.size(items) / size).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(items, i * size + 1, F.lit(size)))


def markdown_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, table_no, row_no, cells) of Markdown tables: runs of |...| lines with two rows or more besides the rule.

    Lines are numbered, runs of table lines are islands between gaps, the rule row goes and bold marks with it.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    rows = lines.where(F.col("line").startswith("|") & F.col("line").endswith("|") & (F.length("line") > 1))
    w = Window.partitionBy("doc_id").orderBy("n")
    rows = rows.withColumn("island", F.col("n") - F.row_number().over(w)).where(~F.col("line").rlike(r"^\|[\s:|-]+\|$"))
    inner = F.substring("line", F.lit(2), F.length("line") - 2)
    cells = F.transform(F.split(inner, r"\|"), lambda c: F.trim(F.regexp_replace(c, r"\*\*", "")))
    by = Window.partitionBy("doc_id", "island")
    numbered = rows.withColumns({"cells": cells, "row_no": F.row_number().over(by.orderBy("n")) - 1, "size": F.count("*").over(by)}).where("size >= 2")
    numbered = numbered.withColumn("width", F.first(F.size("cells")).over(by.orderBy("n")))
    table = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("island")) - 1
    return numbered.select("doc_id", table.alias("table_no"), "row_no", F.slice("cells", F.lit(1), F.col("width")).alias("cells"))


def kwic(pages: DataFrame, keyword: str, most: int = 3, around: int = 120) -> DataFrame:
    """(file_id, page_num, hit_no, excerpt): up to ``most`` occurrences a page with ``around`` characters at each side."""
    hits = pages.select("file_id", "page_num", "text", F.posexplode(T.keyword_starts(F.col("text"), keyword, most)).alias("hit_no", "at"))
    start = F.greatest(F.col("at") - around, F.lit(1))
    return hits.select("file_id", "page_num", "hit_no", F.substring("text", start, F.col("at") + len(keyword) + around - start).alias("excerpt"))


def field_lines(template: DataFrame) -> DataFrame:
    """(template_id, lines): a prompt line a field in order."""
    line = F.concat(F.lit("- "), "key", F.lit(" ("), "name", F.lit("): "), "type", F.when(F.col("required"), F.lit(", required")).otherwise(F.lit("")))
    listed = template.groupBy("template_id").agg(F.sort_array(F.collect_list(F.struct("ord", line.alias("t")))).alias("l"))
    return listed.select("template_id", F.array_join(F.col("l.t"), "\n").alias("lines"))


LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def outline(answer: Column) -> Column:
    """An answer's points, as (key, value) in order: its bullets and numbered lines, each split at its first colon or else numbered; without any, its sentences."""
    item = lambda line: F.coalesce(*(F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in (r"^[-*•]\s+(.+)$", r"^\d+[.)]\s+(.+)$")))
    items = F.array_compact(F.transform(F.split(answer, LINE_ENDS), lambda line: item(T.strip(line))))
    sentences = F.filter(F.split(answer, r"[。！？.!?]\s*"), lambda s: s != "")

    def point(text: Column, i: Column) -> Column:
        parts = F.split(text, r"[：:]\s*", 2)
        number = (i + 1).cast("string")
        whole = F.size(parts) < 2
        return F.struct(F.when(whole, number).otherwise(T.strip(parts[0])).alias("key"), F.when(whole, text).otherwise(T.strip(parts[1])).alias("value"))

    numbered = lambda s, i: F.struct((i + 1).cast("string").alias("key"), T.strip(s).alias("value"))
    return F.when(F.size(items) > 0, F.transform(items, point)).otherwise(F.transform(sentences, numbered))
