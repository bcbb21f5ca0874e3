"""Registered queries: agenda workbooks to items, and merging a folder of look-alike workbooks; both over cells made of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import agenda as A
from ..operators import folder_merge as M
from .registry import Registry, registrar, table

QUERIES: Registry = {}
query = registrar(QUERIES)


def _cells(rows: DataFrame, keys: list[str], cells: dict[int, Column]) -> DataFrame:
    """(keys, col, value) of each row's cells; null cells aren't there."""
    found = F.inline(F.array(*(F.struct(F.lit(c).alias("col"), v.cast("string").alias("value")) for c, v in cells.items())))
    return rows.select(*keys, found).where("value is not null")


def _agendas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet a customer: a header above, or below a title and a gap, or none, or one that says nothing; a row an order."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    mode = F.col("o_custkey") % 4
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    number = F.when(mode == 2, (k % 7).cast("string")).when(k % 10 == 0, "x").when(k % 10 == 1, "").otherwise(F.concat((k % 7).cast("string"), F.lit(".0")))
    title = F.when((mode != 2) & (k % 11 == 0), "").otherwise(F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" ")))
    body = o.select(F.col("o_custkey").alias("sheet"), mode.alias("mode"), (rank + F.when(mode == 1, 3).when(mode == 2, 0).otherwise(1)).alias("row"), number.alias("number"), title.alias("title"), F.col("o_orderdate").cast("date").cast("string").alias("clerk"))
    body = _cells(body, ["sheet", "row"], {1: F.col("number"), 3: F.when(F.col("mode") != 1, F.col("title")), 2: F.when(F.col("mode") == 1, F.col("title")).otherwise(F.col("clerk")), 4: F.when(F.col("mode") == 1, F.col("clerk"))})
    sheets = o.select(F.col("o_custkey").alias("sheet"), mode.alias("mode")).distinct()
    heads = sheets.where("mode <> 2").select(
        "sheet", F.when(F.col("mode") == 1, 3).otherwise(1).alias("row"),
        F.inline(F.when(F.col("mode") == 0, _row("序号", "时间", "标题", "地区")).when(F.col("mode") == 1, _row("发言顺序", "材料名称", "备注", "文号")).otherwise(_row("甲", "乙", "丙", "丁"))),
    )
    titles = sheets.where("mode = 1").select("sheet", F.lit(1).alias("row"), F.lit(1).alias("col"), F.lit("议程").alias("value"))
    return body.unionByName(heads).unionByName(titles)


def _row(*values: str) -> Column:
    return F.array(*(F.struct(F.lit(c).alias("col"), F.lit(v).alias("value")) for c, v in enumerate(values, 1)))


_AGENDA_SQL = """
WITH r AS (
  SELECT o_custkey AS sheet, o_custkey % 4 AS mode, o_orderkey AS k, trim(o_orderpriority) AS t, o_orderdate::DATE::VARCHAR AS clerk,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + CASE o_custkey % 4 WHEN 1 THEN 3 WHEN 2 THEN 0 ELSE 1 END AS source_row
  FROM orders),
p AS (
  SELECT *, CASE WHEN mode = 3 OR (mode <> 2 AND k % 10 IN (0, 1)) THEN NULL ELSE k % 7 END AS order_no, CASE WHEN mode = 3 OR (mode <> 2 AND k % 11 = 0) THEN NULL ELSE t END AS title,
         CASE WHEN mode = 1 THEN clerk END AS code, CASE WHEN mode IN (0, 2) THEN clerk END AS time_range FROM r),
f AS (
  SELECT *, min(CASE WHEN order_no IS NOT NULL AND (title IS NOT NULL OR code IS NOT NULL) THEN source_row END) OVER (PARTITION BY sheet, order_no ORDER BY source_row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS first_row
  FROM p),
s AS (
  SELECT *, CASE WHEN order_no IS NULL THEN 'skipped' WHEN title IS NULL AND code IS NULL THEN 'missing_identity' WHEN first_row IS NOT NULL THEN 'duplicate' ELSE 'item' END AS status FROM f)
"""


@query(
    "agenda_rows",
    _AGENDA_SQL
    + """SELECT sheet, source_row, order_no, title, code, time_range, status,
       CASE status WHEN 'missing_identity' THEN '标题和编号不能同时为空' WHEN 'duplicate' THEN '顺序号重复，首次出现于第 ' || first_row || ' 行' END AS error
FROM s""",
)
def agenda_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = A.read_sheets(_agendas(spark, sf_dir))
    return rows.select("sheet", "source_row", "order_no", "title", "code", "time_range", "status", "error")


@query(
    "agenda_sheets",
    _AGENDA_SQL
    + """SELECT sheet, CASE WHEN mode = 1 THEN 3 ELSE 1 END::INTEGER AS header_row, mode = 2 AS headerless, count(*) FILTER (status = 'skipped') AS skipped,
       CASE WHEN mode = 3 THEN '未识别顺序号列，请手动指定。' END AS error
FROM s GROUP BY sheet, mode""",
)
def agenda_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, sheets = A.read_sheets(_agendas(spark, sf_dir))
    return sheets.select("sheet", F.col("header_row").cast("int").alias("header_row"), "headerless", "skipped", "error")


def _folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook a nation: some under a title and a number row, some with their header twice, a nameless column, two columns of one name."""
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    sheet = F.concat(F.lit("n"), F.lpad(n.cast("string"), 2, "0"), F.lit(".xlsx"))
    top = F.when(n % 3 == 0, 2).otherwise(0)
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    there, phone = k % 17 != 0, F.concat(F.lit("+"), k.cast("string"))
    body = table(spark, sf_dir, "customer").select(
        sheet.alias("sheet"), (rank + top + F.when(n % 4 == 1, 1).otherwise(0)).alias("row"), F.when(k % 13 != 0, rank).alias("no"), F.when(there & (k % 19 != 0), F.col("c_name")).alias("name"),
        F.when(there, phone).alias("phone"), F.when(there, F.when(k % 7 == 0, "NA").otherwise(F.col("c_mktsegment"))).alias("segment"), F.when(there & (n % 5 == 0), F.concat(F.lit(" "), "c_name", F.lit(" "))).alias("again"),
    )
    body = _cells(body, ["sheet", "row"], {0: F.col("no"), 1: F.col("name"), 2: F.col("phone"), 3: F.col("segment"), 4: F.lit("junk"), 5: F.col("again")})
    sheets = table(spark, sf_dir, "customer").select(n, sheet.alias("sheet"), top.alias("top")).distinct()
    words = {0: F.lit("序号"), 1: F.lit("name"), 2: F.when(n % 2 == 0, "phone").otherwise("mobile"), 3: F.lit("segment"), 5: F.when(n % 5 == 0, "name")}
    heads = _cells(sheets.withColumn("row", F.col("top")), ["sheet", "row"], words)
    echo = _cells(sheets.where(n % 4 == 1).withColumn("row", F.col("top") + 1), ["sheet", "row"], words | {5: F.when(n % 5 == 0, "name.1")})
    title = _cells(sheets.where("top = 2").withColumn("row", F.lit(0)), ["sheet", "row"], {0: F.lit("list")})
    digits = _cells(sheets.where("top = 2").withColumn("row", F.lit(1)), ["sheet", "row"], {c: F.lit(c + 1) for c in range(3)})
    return body.unionByName(heads).unionByName(echo).unionByName(title).unionByName(digits)


_FOLDER_SQL = """
WITH c AS (
  SELECT *, c_nationkey AS n, 'n' || lpad(c_nationkey::VARCHAR, 2, '0') || '.xlsx' AS sheet,
         row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + CASE WHEN c_nationkey % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN c_nationkey % 4 = 1 THEN 1 ELSE 0 END AS row
  FROM customer),
k AS (SELECT *, row_number() OVER (ORDER BY sheet, row) AS number FROM c WHERE c_custkey % 13 <> 0 AND c_custkey % 17 <> 0)
"""


@query(
    "folder_merge",
    _FOLDER_SQL
    + """SELECT number, sheet, 'name' AS name, c_name AS value FROM k WHERE c_custkey % 19 <> 0
UNION ALL SELECT number, sheet, CASE WHEN n % 2 = 0 THEN 'phone' ELSE 'mobile' END, '+' || c_custkey FROM k
UNION ALL SELECT number, sheet, 'segment', c_mktsegment FROM k WHERE c_custkey % 7 <> 0
UNION ALL SELECT number, sheet, 'name.1', c_name FROM k WHERE n % 5 = 0""",
)
def folder_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, _ = M.merge_folder(_folder(spark, sf_dir))
    return cells.select("number", "sheet", "name", "value")


@query(
    "folder_merge_wide",
    _FOLDER_SQL
    + """SELECT number AS "序号", CASE WHEN c_custkey % 19 <> 0 THEN c_name ELSE '' END AS name, CASE WHEN n % 2 = 0 THEN '+' || c_custkey ELSE '' END AS phone, CASE WHEN n % 2 = 1 THEN '+' || c_custkey ELSE '' END AS mobile,
       CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment ELSE '' END AS segment, CASE WHEN n % 5 = 0 THEN c_name ELSE '' END AS name_1 FROM k""",
)
def folder_merge_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.wide(*M.merge_folder(_folder(spark, sf_dir))).withColumnRenamed("name.1", "name_1")


@query(
    "folder_merge_alike",
    _FOLDER_SQL
    + """SELECT number, sheet, 'name' AS name, c_name AS value FROM k WHERE c_custkey % 19 <> 0 OR n % 5 = 0
UNION ALL SELECT number, sheet, CASE WHEN n % 2 = 0 THEN 'phone' ELSE 'mobile' END, '+' || c_custkey FROM k
UNION ALL SELECT number, sheet, 'segment', c_mktsegment FROM k WHERE c_custkey % 7 <> 0""",
)
def folder_merge_alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, _ = M.merge_alike(_folder(spark, sf_dir))
    return cells.select("number", "sheet", "name", "value")


@query(
    "folder_headers",
    """WITH n AS (SELECT DISTINCT c_nationkey AS n, 'n' || lpad(c_nationkey::VARCHAR, 2, '0') || '.xlsx' AS sheet FROM customer)
SELECT sheet, 'name' AS header, 'name' AS target FROM n UNION ALL SELECT sheet, 'segment', 'segment' FROM n UNION ALL SELECT sheet, 'name.1', 'name' FROM n WHERE n % 5 = 0
UNION ALL SELECT sheet, CASE WHEN n % 2 = 0 THEN 'phone' ELSE 'mobile' END, CASE WHEN n % 2 = 0 THEN 'phone' ELSE 'mobile' END FROM n""",
)
def folder_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a merge of the folder would make of each header."""
    columns, _ = M.tidy_cells(_folder(spark, sf_dir))
    heads = columns.select("sheet", "col", F.col("name").alias("header"))
    return M.mapping(heads, M.leaders(heads)).select("sheet", "header", "target")


@query("word_headers")
def word_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unified headers of a folder with a workbook a document, whose headers are the document's first five words."""
    words = F.slice(F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), " "), 1, 5)
    heads = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sheet"), F.posexplode(words).alias("col", "header"))
    return M.leaders(heads).select("key", "name", F.col("at.sheet").alias("sheet"), F.col("at.col").alias("col"))
