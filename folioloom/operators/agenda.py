"""Agenda sheets: column roles, header rows, and row validation."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .durable import keep

# Header texts of the agenda roles, in the order in which exact matches are preferred.
ALIASES = {
    "order_no": ("顺序号", "顺序", "序号", "发言顺序", "排序", "order"),
    "time_range": ("时间", "发言时间", "汇报时间", "报告时间"),
    "title": ("标题", "发言标题", "材料名称", "议题名称", "主题", "研发载体名称", "载体名称", "单位名称", "发言单位", "机构名称"),
    "region": ("所在地", "地区", "省市", "省份", "地域"),
    "code": ("编号", "材料编号", "议题编号", "文号", "文件编号"),
}
#: The aliases that contain no other alias: a header with any alias has one of these.
SHORTEST = sorted({w for words in ALIASES.values() for w in words if not any(o != w and o in w for others in ALIASES.values() for o in others)})
WEIGHTS = {"order_no": 3, "title": 3, "time_range": 1, "region": 1, "code": 1}


def alias_rank(header: Column, role: str) -> Column:
    """Place of an exact alias, or 1000 where the header only contains one, or null."""
    low = F.lower(strip(header))
    words = ALIASES[role]
    out = F.when(F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(low, w)), F.lit(1000))
    for k, w in reversed(list(enumerate(words))):
        out = F.when(low == w, F.lit(k)).otherwise(out)
    return F.when(low != "", out)


def detect_mapping(headers: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(col, header) -> (role, header): an exact alias first, in alias order, else the first header that contains one."""
    low = F.lower("header")
    might = reduce(or_, (F.contains(low, F.lit(w)) for w in SHORTEST))  # few cells of a sheet, and the rest isn't multiplied by the roles
    ranks = headers.where(might).select(*by, "col", "header", F.explode(F.array(*(F.struct(F.lit(r).alias("role"), alias_rank(F.col("header"), r).alias("rank")) for r in ALIASES))).alias("a"))
    hit = ranks.where("a.rank is not null").select(*by, "a.role", "header", F.struct("a.rank", "col").alias("at"))
    return hit.groupBy(*by, "role").agg(F.min_by("header", "at").alias("header"))


def find_header_rows(cells: DataFrame, scan: int = 30) -> DataFrame:
    """(sheet, row, col, value) -> (sheet, header_row): the earliest best-scoring row of the first ``scan``, if it has 6."""
    roles = detect_mapping(cells.where(F.col("row") <= scan).withColumnRenamed("value", "header"), ("sheet", "row"))
    weight = F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))
    scored = roles.groupBy("sheet", "row").agg(F.sum(F.try_element_at(weight, F.col("role"))).alias("score"))
    best = scored.groupBy("sheet").agg(F.max_by("row", F.struct("score", -F.col("row"))).alias("header_row"), F.max("score").alias("score"))
    return best.where("score >= 6").select("sheet", "header_row")


def headerless(cells: DataFrame) -> DataFrame:
    """(sheet, headerless): every filled row of the first five has a number first and a text third."""
    row = cells.where("row <= 5 and value is not null and value <> ''").groupBy("sheet", "row").agg(
        F.max(F.when(F.col("col") == 1, F.col("value"))).alias("a"), F.max(F.when(F.col("col") == 3, F.col("value"))).alias("c")
    )
    fits = parse_order_no(F.col("a")).isNotNull() & (F.coalesce(strip(F.col("c")), F.lit("")) != "")
    return row.groupBy("sheet").agg(F.bool_and(fits).alias("headerless"))


def parse_order_no(raw: Column) -> Column:
    """Whole part of a number, or null: also for infinite and undefined ones."""
    n = strip(raw).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < 9e18), n.cast("bigint"))


def clean_cell(raw: Column) -> Column:
    """Stripped text, empty for null; a whole float without its point."""
    s = strip(F.coalesce(raw, F.lit("")))
    return F.regexp_replace(s, r"^(-?\d+)\.0+$", "$1")


def validate_rows(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(source_row, order_raw, title, code, ...) -> with order_no, status and first_row.

    status: skipped (no number), missing_identity (neither title nor code), duplicate (of the row first_row), item.
    ``by`` names the agenda's key where rows hold many agendas.
    """
    read = rows.withColumns({"order_no": parse_order_no(F.col("order_raw")), "title": clean_cell(F.col("title")), "code": clean_cell(F.col("code"))})
    named = F.col("order_no").isNotNull() & ((F.col("title") != "") | (F.col("code") != ""))
    w = Window.partitionBy(*by, "order_no").orderBy("source_row").rowsBetween(Window.unboundedPreceding, -1)
    first = F.first(F.when(named, F.col("source_row")), ignorenulls=True).over(w)
    status = F.when(F.col("order_no").isNull(), "skipped").when(~named, "missing_identity").when(first.isNotNull(), "duplicate").otherwise("item")
    return read.select("*", status.alias("status"), F.when(named, first).alias("first_row"))


def headline_row(cells: DataFrame, scan: int = 5) -> DataFrame:
    """Header row (from 0) of a sheet to merge: row 2 under a text and a number row, else the first mostly-text row, else 0."""
    there = cells.where("value is not null")
    digits = F.col("value").rlike(r"^\s*\p{Nd}+\s*$")
    words = (strip(F.col("value")) != "") & ~digits
    row = there.groupBy("sheet", "row").agg(F.count("*").alias("n"), F.count_if(digits).alias("d"), F.count_if(words).alias("t"))
    text = F.col("t") >= F.greatest(F.lit(1.0), F.col("n") * F.lit(0.6))
    row = row.withColumns({"is_text": text, "is_number": (F.col("n") >= 2) & (F.col("d") == F.col("n"))})
    at = lambda k, c: F.max(F.when(F.col("row") == k, F.col(c)))
    pattern = F.coalesce(at(0, "is_text") & at(1, "is_number") & at(2, "is_text"), F.lit(False))
    wide = F.min(F.when((F.col("row") < scan) & (F.col("n") >= 3) & (F.col("t") >= F.col("n") * F.lit(0.6)), F.col("row")))
    return row.groupBy("sheet").agg(F.when(pattern, F.lit(2)).otherwise(F.coalesce(wide, F.lit(0))).alias("header_row"))


# What is said of sheets and rows that can't be read, and the columns of a sheet without a header.
NO_ORDER = "未识别顺序号列，请手动指定。"
NO_IDENTITY = "标题和编号不能同时为空"
TWICE = "顺序号重复，首次出现于第 %s 行"
PLACES = ("order_no", "time_range", "title", "region")


def read_sheets(cells: DataFrame, header_row: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rows, sheets) of many agenda sheets at once, from (sheet, row, col, value); rows and columns from 1.

    rows: sheet, source_row, order_no, time_range, title, region, code, status (item, duplicate, missing_identity, skipped), error; the
    items of a sheet are those with that status. sheets: sheet, header_row, headerless, skipped, error. The header is found by
    ``find_header_rows``, else it is in ``header_row``; a sheet whose header names no order column may be one without a
    header. Columns are resolved in the data: one row a sheet says which column has which role. The cells are kept as a table, since they are
    read several times, and what is made of them is shuffled once, by sheet.
    """
    filled = keep(cells.where("value is not null and value <> ''").select("sheet", "row", "col", "value"), "agenda-cells")
    found = filled.select("sheet").distinct().join(find_header_rows(filled), "sheet", "left").withColumn("header_row", F.coalesce("header_row", F.lit(header_row)))
    heads = filled.join(found, "sheet").where("row = header_row").select("sheet", "col", strip(F.col("value")).alias("header"))
    roles = detect_mapping(heads, ("sheet",))
    last = heads.groupBy("sheet", "header").agg(F.max("col").alias("col"))
    by_header = roles.join(last, ["sheet", "header"]).select("sheet", "role", "col")
    ordered = by_header.where("role = 'order_no'").select("sheet", F.lit(True).alias("ordered"))
    bare = found.join(ordered, "sheet", "left").join(headerless(filled), "sheet", "left").withColumn("headerless", F.col("ordered").isNull() & F.coalesce("headerless", F.lit(False)))
    by_place = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(k).alias("col")) for k, r in enumerate(PLACES, 1)))
    placed = bare.where("headerless").select("sheet", F.inline(by_place))
    named = by_header.join(bare.where("headerless").select("sheet"), "sheet", "left_anti")
    columns = named.unionByName(placed.select("sheet", "role", F.col("col").cast("int").alias("col")))
    at = columns.groupBy("sheet").agg(*(F.max(F.when(F.col("role") == r, F.col("col"))).alias(f"at_{r}") for r in ALIASES))
    body = filled.join(bare.select("sheet", "header_row", "headerless").join(at, "sheet", "left"), "sheet").where(F.col("headerless") | (F.col("row") > F.col("header_row")))
    told = body.groupBy("sheet", F.col("row").alias("source_row"))
    value = {r: F.max(F.when(F.col("col") == F.col(f"at_{r}"), F.col("value"))) for r in ALIASES}
    rows = told.agg(*(value[r].alias("order_raw" if r == "order_no" else r) for r in ALIASES))
    judged = validate_rows(rows, ("sheet",)).withColumns({c: F.nullif(clean_cell(F.col(c)), F.lit("")) for c in ("time_range", "region", "title", "code")})
    error = F.when(F.col("status") == "missing_identity", NO_IDENTITY).when(F.col("status") == "duplicate", F.format_string(TWICE, F.col("first_row").cast("string")))
    rows = judged.select("sheet", "source_row", "order_no", "time_range", "title", "region", "code", "status", error.alias("error"))
    skipped = rows.groupBy("sheet").agg(F.count_if(F.col("status") == "skipped").alias("skipped"))
    sheets = bare.join(skipped, "sheet", "left").select(
        "sheet", "header_row", "headerless", F.coalesce("skipped", F.lit(0)).alias("skipped"), F.when(F.col("ordered").isNull() & ~F.col("headerless"), NO_ORDER).alias("error")
    )
    return rows, sheets
