"""Model answers as JSON: repair, and explosion into one row a template field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .coerce import coerced


def _try(text: Column) -> Column:
    return F.when(F.try_parse_json(text).isNotNull(), text)


def repaired_json(answer: Column) -> Column:
    """JSON text of an answer, or null: its fenced part, else the outermost object, else with quotes and literals mended."""
    fenced = F.regexp_extract(answer, r"```(?:json)?\s*([\s\S]*?)```", 1)
    text = F.trim(F.when(fenced != "", fenced).otherwise(answer))
    object_ = F.regexp_extract(text, r"\{[\s\S]*\}", 0)
    mended = F.regexp_replace(text, "'", '"')
    for old, new in (("None", "null"), ("True", "true"), ("False", "false")):
        mended = F.replace(mended, F.lit(old), F.lit(new))
    return F.coalesce(_try(text), _try(F.nullif(object_, F.lit(""))), _try(mended))


def fields_from_json(answers: DataFrame, template: DataFrame) -> DataFrame:
    """(file_id, raw_json) x (key, name, type, required, ord) -> one row a file and field with raw, typed values and snippet.

    An entry is {"value": ..., "source_snippet": ...} or the value itself; keys outside the template are ignored, and
    fields the answer lacks give nulls. The template is small by nature (columns of one sheet) and is cross-joined.
    """
    entries = answers.withColumn("m", F.from_json(repaired_json(F.col("raw_json")), "map<string,string>"))
    one = entries.crossJoin(F.broadcast(template)).withColumn("entry", F.try_element_at("m", F.col("key")))
    nested = F.when(F.col("entry").startswith("{"), F.from_json("entry", "struct<value:string,source_snippet:string>"))
    one = one.withColumn("nested", nested).select(
        "file_id", "key", "name", "type", "required", "ord",
        F.when(F.col("nested").isNotNull(), F.col("nested.value")).otherwise(F.col("entry")).alias("raw_value"),
        F.left(F.coalesce("nested.source_snippet", F.lit("")), F.lit(150)).alias("source_snippet"),
    )
    return one.withColumns(coerced(F.col("raw_value"), F.col("type")))
