"""Merging look-alike tables: header similarity, canonical headers, mapping, union, numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, normalise_header, strip

# Headers that mean the same; the first of each group is the unified one.
GROUPS = (
    ("姓名", "有效证件姓名", "申请人姓名", "客户姓名", "人员姓名", "用户姓名"),
    ("联系电话", "联系电话号码", "手机", "手机号", "手机号码", "电话", "电话号码"),
    ("出生日期", "出生年月", "生日", "出生时间", "出生日期年月"),
    ("身份证号", "身份证号码", "证件号", "证件号码", "有效证件号码"),
    ("地址", "联系地址", "家庭住址", "居住地址", "开户地址"),
    ("公司名称", "单位名称", "企业名称", "机构名称", "所属公司"),
    ("电子邮箱", "邮箱", "email", "e mail"),
)
CANONICAL_FROM, MAP_FROM = 0.75, 0.6
SOURCE, NUMBER = "来源文件", "序号"


def normalise_mapping(mapping: dict[str, str], canonical: list[str]) -> dict[str, str]:
    return {c: t if t in canonical else c for c, t in mapping.items()}


def align(df: DataFrame, mapping: dict[str, str], canonical: list[str]) -> DataFrame:
    """The canonical columns as text; of several sources of one target the first with a value counts; absent: empty."""
    by: dict[str, list[str]] = {}
    for source, target in mapping.items():
        by.setdefault(target, []).append(source)
    text = lambda c: F.nullif(strip(F.col(f"`{c}`").cast("string")), F.lit(""))
    return df.select(*(F.coalesce(*(text(s) for s in by.get(t, [])), F.lit("")).alias(t) for t in canonical))


def union_exact(tables: list[DataFrame]) -> DataFrame:
    """Union by exact name; columns in order of first sight, absent ones empty."""
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.na.fill("")


def keep_first(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Distinct rows over ``columns``; the first in ``order`` stays."""
    w = Window.partitionBy(*columns).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def number_rows(rows: DataFrame, parts: str, order: list[str], name: str = "rn") -> DataFrame:
    """1..n over (``parts``, ``order``) without one task seeing all rows: each part is numbered alone and offset.

    Part sizes are one small aggregate; their running sum is a window over as many rows as there are parts.
    """
    sizes = rows.groupBy(parts).agg(F.count("*").alias("_n"))
    ahead = Window.orderBy(parts).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(parts, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy(parts).orderBy(*order))
    return rows.withColumn("_local", local).join(offsets, parts).withColumn(name, F.col("_local") + F.col("_off")).drop("_local", "_off")


def clean_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """Stripped cells; a first row (by ``order``) that repeats the header goes, as do rows without any value.

    Unnamed and number columns go too. ``order`` are columns of ``df`` that number its rows; they aren't data and stay
    as they are. The first row is found by a minimum, so no task sees all rows; rows that tie for it are all first.
    """
    data = [c for c in df.columns if c not in order]
    text = {c: strip(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in data}
    first = df.agg(F.min(F.struct(*order)).alias("_first"))
    echo, blank = F.struct(*order).eqNullSafe(F.col("_first")), F.lit(True)
    for c in data:
        echo = echo & (text[c] == c.strip())
        blank = blank & (text[c] == "")
    kept = [c for c in data if c and not c.lower().startswith("unnamed") and c != NUMBER]
    return df.crossJoin(F.broadcast(first)).where(~blank & ~echo).select(*order, *(text[c].alias(c) for c in kept))  # first is one row


def header_jaccard(headers: DataFrame) -> DataFrame:
    """(file_id, headers array) -> score: mean Jaccard similarity of normalised headers over all pairs; 1 under two files.

    The files are those of one merge, so pairs are few.
    """
    keyed = headers.select("file_id", F.array_distinct(F.filter(F.transform("headers", normalise_header), lambda h: h != "")).alias("h"))
    other = keyed.select(F.col("file_id").alias("other_id"), F.col("h").alias("o"))
    pairs = keyed.join(other, F.col("file_id") < F.col("other_id"))
    return pairs.agg(F.coalesce(F.avg(jaccard(F.col("h"), F.col("o"))), F.lit(1.0)).alias("score"))


def headers_equal(headers: DataFrame) -> DataFrame:
    keyed = headers.select(F.sort_array(F.array_distinct(F.transform("headers", normalise_header))).alias("h"))
    return keyed.agg((F.count_distinct("h") <= 1).alias("exact"))
