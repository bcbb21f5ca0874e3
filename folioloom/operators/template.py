"""Templates: header roles, field rows, and fields from headers alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug, squeeze, strip

# Header texts by the role they stand for.
ROLES = {
    "name": ("字段名称", "字段名", "名称", "field name", "field", "name", "column name", "列名"),
    "description": ("字段说明", "说明", "描述", "备注", "description", "desc", "field description", "备注说明"),
    "type": ("数据类型", "类型", "字段类型", "data type", "type", "dtype", "field type"),
    "required": ("是否必填", "必填", "required", "is required", "mandatory", "必须"),
    "example": ("示例值", "示例", "example", "sample", "样例", "例子", "example value"),
    "prompt_hint": ("提取提示", "提示", "提取说明", "同义词", "extraction hint", "hint", "prompt", "备注提示"),
}
# Names of the field types.
TYPE_NAMES = {
    "text": ("text", "文本", "字符串", "string", "str"),
    "long_text": ("long_text", "长文本", "多行文本", "textarea"),
    "integer": ("integer", "整数", "int", "number"),
    "decimal": ("decimal", "小数", "float", "numeric", "数字"),
    "date": ("date", "日期", "datetime", "时间", "日期时间"),
    "boolean": ("boolean", "布尔值", "bool", "是否", "yes/no"),
    "list": ("list", "列表", "array", "多值", "multi"),
}
# Texts that mean a field is required.
REQUIRED = ("是", "yes", "true", "1", "y", "必填", "required", "√", "✓")


def _lookup(table: dict[str, tuple[str, ...]]) -> Column:
    return F.create_map(*(F.lit(x) for meaning, words in table.items() for w in words for x in (w, meaning)))


def normalise(text: Column) -> Column:
    return squeeze(F.lower(text))


def parse_type(raw: Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup(TYPE_NAMES), normalise(raw)), F.lit("text"))


def parse_required(raw: Column) -> Column:
    return F.coalesce(normalise(raw).isin(*REQUIRED), F.lit(False))


def map_columns(headers: DataFrame) -> DataFrame:
    """(pos, header) -> with role: the first header of each role has it, all others null."""
    role = F.try_element_at(_lookup(ROLES), normalise(F.col("header")))
    w = Window.partitionBy("wanted").orderBy("pos")
    first = F.row_number().over(w) == 1
    return headers.withColumn("wanted", role).withColumn("role", F.when(F.col("wanted").isNotNull() & first, F.col("wanted"))).drop("wanted")


def unnamed(header: Column) -> Column:
    n = normalise(header)
    return header.isNull() | (n == "") | n.startswith("unnamed") | n.isin("nan", "none")


def fields_from_headers(headers: DataFrame) -> DataFrame:
    """An optional text field for each named header, in order. The headers are those of one sheet."""
    named = headers.where(~unnamed(F.col("header"))).withColumn("name", strip(F.col("header")))
    order = (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("pos")) - 1).alias("ord")
    return named.select(slug(F.col("name")).alias("key"), "name", F.lit("text").alias("type"), F.lit(False).alias("required"), order)


def build_fields(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(template_id, row, name, description, type, required, example, prompt_hint) -> (fields, errors).

    Blank names are skipped; of equal names in a template the first counts and the others are errors with their row.
    """
    named = rows.withColumn("name", strip(F.coalesce("name", F.lit("")))).where("name <> ''")
    seen = named.withColumn("k", F.row_number().over(Window.partitionBy("template_id", "name").orderBy("row")))
    order = F.row_number().over(Window.partitionBy("template_id").orderBy("row")) - 1
    text = lambda c: F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit(""))
    fields = seen.where("k = 1").select(
        "template_id", slug(F.col("name")).alias("key"), "name", text("description").alias("description"), parse_type(F.coalesce("type", F.lit(""))).alias("type"),
        parse_required(F.coalesce("required", F.lit(""))).alias("required"), text("example").alias("example"), text("prompt_hint").alias("prompt_hint"), order.alias("ord"),
    )
    errors = seen.where("k > 1").select("template_id", (F.col("row") + 2).alias("row_number"), F.col("name"), F.lit("duplicate name").alias("error"))
    return fields, errors
