"""Two-pass scans: native page texts, and recognised words only where those have next to nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, strip

# Page modes by preset, in order; presets that turn recognition off; the bounds of both passes.
MODES = {"scanner": (6, 3), "photo": (11, 6), "mixed": (3, 6), "default": (6,)}
OFF = ("off", "关闭", "none", "disabled")
NOT_BLANK = r"[^\p{IsWhite_Space}\x1c-\x1f]"
LEAST_CONFIDENCE, NATIVE_ENOUGH, MERGE_RATIO = 30, 50, 1.2


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once a row, however often later columns use it: no projection merges across explode."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def confidence(raw: Column) -> Column:
    """A whole number, with or without minus signs before it; anything else is -1."""
    text = raw.cast("string")
    return F.when(text.rlike(r"^-*\d+$"), text.try_cast("int")).otherwise(F.lit(-1))


def word_reads(words: DataFrame, least: int = LEAST_CONFIDENCE) -> DataFrame:
    """(file_id, page_num, mode, seq, word, conf) -> (file_id, page_num, mode, text, confidence, words): one read a page and mode.

    Words of less confidence, and blank ones, are left out; the others are joined by spaces in order, their confidence averaged.
    A page is what one task holds of a group; pages are small whatever the number of files.
    """
    sure = words.withColumn("c", confidence(F.col("conf"))).where((F.col("c") >= least) & (strip(F.coalesce("word", F.lit(""))) != ""))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "word"))), lambda x: x["word"]), " ")
    return sure.groupBy("file_id", "page_num", "mode").agg(joined.alias("text"), F.avg("c").alias("confidence"), F.count("*").alias("words"))


def page_read(reads: Column, modes: tuple[int, ...], least: int = LEAST_CONFIDENCE) -> Column:
    """``best_reads`` of ``word_reads`` within a page: of (mode, words: (word, conf)) to (text, confidence, mode), null if none has a word."""

    def bound(value: Column, use: Callable[[Column], Column]) -> Column:
        return F.transform(F.array(value), use)[0]

    def scored(words: Column, text: Column, mode: Column) -> Column:
        mean = F.when(F.size(words) > 0, F.aggregate(words, F.lit(0).cast("long"), lambda n, x: n + x["c"]) / F.size(words))
        return F.struct(F.length(strip(text)).alias("n"), (-place(mode)).alias("place"), text.alias("text"), mean.alias("confidence"), mode.alias("mode"))

    def read(r: Column) -> Column:
        known = F.transform(r["words"], lambda x: F.struct(x["word"].alias("word"), confidence(x["conf"]).alias("c")))
        sure = F.filter(known, lambda x: (x["c"] >= least) & F.coalesce(x["word"].rlike(NOT_BLANK), F.lit(False)))
        return bound(sure, lambda w: bound(F.array_join(w["word"], " "), lambda text: scored(w, text, r["mode"])))

    def place(mode: Column) -> Column:
        return F.array_position(F.array(*(F.lit(m) for m in modes)), mode)

    return F.array_max(F.filter(F.transform(F.filter(reads, lambda r: place(r["mode"]) > 0), read), lambda r: r["confidence"].isNotNull()))


def best_reads(reads: DataFrame, modes: tuple[int, ...]) -> DataFrame:
    """The read of each page with the longest stripped text; of equals the one whose mode comes first."""
    place = F.array_position(F.array(*(F.lit(m) for m in modes)), F.col("mode"))
    rank = F.struct(F.length(strip(F.col("text"))), -place)
    best = reads.where(place > 0).groupBy("file_id", "page_num").agg(F.max_by(F.struct("text", "confidence", "mode"), rank).alias("r"))
    return best.select("file_id", "page_num", "r.*")


def two_pass(
    pages: DataFrame, words: DataFrame | None = None, preset: str = "default", errors: DataFrame | None = None, enabled: bool = True, max_pages: int | None = None,
    clean: Callable[[Column, Column], Column] = clean_text,
) -> DataFrame:
    """(file_id, page_num, text, used_ocr, ocr_confidence, ocr_mode, ocr_error) of all pages (file_id, page_num, native).

    A page with NATIVE_ENOUGH characters keeps its native text. Of any other the best read counts, if it has more than MERGE_RATIO
    times as many; ``errors`` (file_id, page_num, error) are pages that couldn't be read, which keep the native text too.
    Words of pages that don't need them are dropped before anything is grouped. ``clean`` has the text and whether it was recognised.

    Without a table of ``words`` the pages bring them, as ``reads`` (see ``page_read``) and, if need be, ``error``. Then nothing is joined or
    shuffled: each page is dealt with where it is.
    """
    if max_pages:
        pages = pages.where(F.col("page_num") <= max_pages)
    off = not enabled or preset in OFF
    carried = [] if words is not None else [c for c in ("reads", "error") if c in pages.columns]
    native = pages.select("file_id", "page_num", *carried, clean(F.coalesce("native", F.lit("")), F.lit(False)).alias("cleaned"))
    native = _once(native, "native", F.col("cleaned")).drop("cleaned")
    native = native.withColumn("chars", F.length(strip(F.col("native"))))
    modes = MODES.get(preset, MODES["default"])
    if words is None:
        needed = F.lit(not off) & (F.col("chars") < NATIVE_ENOUGH)
        j = _once(native, "read", F.when(needed, page_read(F.col("reads"), modes)))
        j = j.withColumns({"ocr": clean(F.col("read.text"), F.lit(True)), "confidence": F.col("read.confidence"), "mode": F.col("read.mode")})
        return _chosen(j.withColumn("ocr", F.when(F.col("read").isNotNull(), F.col("ocr"))), F.when(needed, F.col("error")) if "error" in carried else F.lit(None).cast("string"))
    if off:
        words = words.limit(0)
    poor = native.where(F.col("chars") < NATIVE_ENOUGH).select("file_id", "page_num")
    reads = best_reads(word_reads(words.where(F.col("mode").isin(*modes)).join(poor, ["file_id", "page_num"], "left_semi")), modes)
    reads = reads.withColumn("ocr", clean(F.col("text"), F.lit(True))).select("file_id", "page_num", "ocr", "confidence", "mode")
    j = native.join(reads, ["file_id", "page_num"], "left")
    failed = F.lit(None).cast("string")
    if errors is not None and not off:
        j, failed = j.join(errors.select("file_id", "page_num", "error"), ["file_id", "page_num"], "left"), F.when(F.col("chars") < NATIVE_ENOUGH, F.col("error"))
    return _chosen(j, failed)


def _chosen(j: DataFrame, failed: Column) -> DataFrame:
    """What ``two_pass`` gives for pages beside their best reads."""
    better = F.coalesce(failed.isNull() & (F.length(strip(F.col("ocr"))) > F.col("chars") * F.lit(MERGE_RATIO)), F.lit(False))
    return j.select(
        "file_id", "page_num", F.when(better, F.col("ocr")).otherwise(F.col("native")).alias("text"), better.alias("used_ocr"),
        F.when(better, F.col("confidence")).alias("ocr_confidence"), F.when(better, F.col("mode")).alias("ocr_mode"), failed.alias("ocr_error"),
    )


def scanned_files(pages: DataFrame) -> DataFrame:
    """(file_id, pages, ocr_pages, total_chars, mean_confidence, ocr_errors) of scanned pages; the mean is over recognised pages."""
    error = F.when(F.col("ocr_error").isNotNull(), F.struct("page_num", F.concat(F.lit("page "), F.col("page_num").cast("string"), F.lit(": "), "ocr_error").alias("t")))
    return pages.groupBy("file_id").agg(
        F.count("*").alias("pages"), F.count_if("used_ocr").alias("ocr_pages"), F.sum(F.length("text")).alias("total_chars"), F.avg("ocr_confidence").alias("mean_confidence"),
        F.transform(F.array_sort(F.collect_list(error)), lambda e: e["t"]).alias("ocr_errors"),
    )
