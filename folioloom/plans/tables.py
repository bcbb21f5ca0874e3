"""Queries on templates, agenda sheets and table merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import agenda as A
from ..operators import folder_merge as M
from ..operators import merge as G
from ..operators import results as R
from ..operators import template as P
from .registry import Registry, registrar, table

QUERIES: Registry = {}
query = registrar(QUERIES)


@query(
    "agenda_validate",
    """WITH r AS (SELECT o_custkey, o_orderkey AS source_row, CASE o_orderkey % 10 WHEN 0 THEN 'x' WHEN 1 THEN '' ELSE (o_orderkey % 7)::VARCHAR || '.0' END AS raw, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority END AS title FROM orders),
p AS (SELECT *, TRY_CAST(raw AS DOUBLE)::BIGINT AS order_no FROM r),
n AS (SELECT *, order_no IS NOT NULL AND title <> '' AS named FROM p),
f AS (SELECT *, min(CASE WHEN named THEN source_row END) OVER (PARTITION BY o_custkey, order_no ORDER BY source_row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS first_row FROM n)
SELECT o_custkey, source_row, order_no, CASE WHEN order_no IS NULL THEN 'skipped' WHEN NOT named THEN 'missing_identity' WHEN first_row IS NOT NULL THEN 'duplicate' ELSE 'item' END AS status,
       CASE WHEN named THEN first_row END AS first_row FROM f""",
)
def agenda_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    raw = F.when(k % 10 == 0, "x").when(k % 10 == 1, "").otherwise(F.concat((k % 7).cast("string"), F.lit(".0")))
    title = F.when(k % 11 == 0, "").otherwise(F.col("o_orderpriority"))
    rows = o.select("o_custkey", k.alias("source_row"), raw.alias("order_raw"), title.alias("title"), F.lit("").alias("code"))
    return A.validate_rows(rows, ("o_custkey",)).select("o_custkey", "source_row", "order_no", "status", "first_row")


def _agenda_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet a region: a title row, a header row, then its nations; the last region has no header."""
    n = table(spark, sf_dir, "nation")
    head = spark.createDataFrame([(1, 1, "agenda"), (2, 1, "序号"), (2, 2, "时间"), (2, 3, "研发载体名称"), (2, 4, "所在地")], "row int, col int, value string")
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("sheet"))
    body = n.select(
        F.col("n_regionkey").alias("sheet"), (F.col("n_nationkey") + 3).alias("row"),
        F.explode(F.array(F.struct(F.lit(1).alias("col"), F.col("n_nationkey").cast("string").alias("value")), F.struct(F.lit(3).alias("col"), F.col("n_name").alias("value")))).alias("c"),
    ).select("sheet", "row", "c.col", "c.value")
    return r.where("sheet < 4").crossJoin(head).select("sheet", "row", "col", "value").unionByName(body)


@query("header_row_detect", "SELECT r_regionkey AS sheet, 2 AS header_row FROM region WHERE r_regionkey < 4")
def header_row_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.find_header_rows(_agenda_cells(spark, sf_dir))


@query("agenda_mapping", """SELECT r_regionkey AS sheet, v.role, v.header FROM region CROSS JOIN (VALUES ('order_no', '序号'), ('time_range', '时间'), ('title', '研发载体名称'), ('region', '所在地')) v(role, header) WHERE r_regionkey < 4""")
def agenda_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = _agenda_cells(spark, sf_dir).where("row = 2").select("sheet", "col", F.col("value").alias("header"))
    return A.detect_mapping(heads, ("sheet",))


@query("agenda_headerless", "SELECT DISTINCT n_regionkey AS sheet, n_regionkey = 4 AS headerless FROM nation")
def agenda_headerless(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _agenda_cells(spark, sf_dir)
    first = cells.groupBy("sheet").agg(F.min("row").alias("least"))
    return A.headerless(cells.join(first, "sheet").withColumn("row", F.when(F.col("sheet") == 4, F.col("row") - F.col("least") + 1).otherwise(F.col("row"))))


@query("merge_header_row", "SELECT r_regionkey AS sheet, CASE WHEN r_regionkey % 2 = 0 THEN 2 ELSE 1 END AS header_row FROM region")
def merge_header_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("sheet"))
    even = [(0, 0, "a title"), (1, 0, "1"), (1, 1, "2"), (1, 2, "3"), (2, 0, "name"), (2, 1, "phone"), (2, 2, "city")]
    odd = [(0, 0, "a title"), (1, 0, "name"), (1, 1, "phone"), (1, 2, "city"), (2, 0, "7"), (2, 1, "8"), (2, 2, "9")]
    schema = "row int, col int, value string"
    cells = r.where("sheet % 2 = 0").crossJoin(spark.createDataFrame(even, schema)).union(r.where("sheet % 2 = 1").crossJoin(spark.createDataFrame(odd, schema)))
    return A.headline_row(cells)


@query(
    "template_map",
    """WITH h AS (SELECT p_partkey AS pos, ['字段名称', 'Data  Type', '名称', '是否必填', '其他', 'hint'][p_partkey % 6 + 1] AS header, ['name', 'type', 'name', 'required', NULL, 'prompt_hint'][p_partkey % 6 + 1] AS role FROM part)
SELECT pos, header, CASE WHEN pos = min(pos) OVER (PARTITION BY role) THEN role END AS role FROM h""",
)
def template_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*(F.lit(w) for w in ("字段名称", "Data  Type", "名称", "是否必填", "其他", "hint")))
    k = F.col("p_partkey")
    return P.map_columns(table(spark, sf_dir, "part").select(k.alias("pos"), F.get(words, (k % 6).cast("int")).alias("header")))


@query(
    "template_fields",
    """SELECT c_nationkey AS template_id, trim(regexp_replace(lower(c_mktsegment), '[^\\p{L}\\p{N}]+', '_', 'g'), '_') AS key, c_mktsegment AS name,
row_number() OVER (PARTITION BY c_nationkey ORDER BY row) - 1 AS ord, 'decimal' AS type, true AS required
FROM (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS row FROM customer GROUP BY 1, 2)""",
)
def template_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    none = F.lit(None).cast("string")
    rows = c.select(
        F.col("c_nationkey").alias("template_id"), F.col("c_custkey").alias("row"), F.concat(F.lit(" "), "c_mktsegment").alias("name"), none.alias("description"),
        F.lit(" 小数 ").alias("type"), F.lit("YES").alias("required"), none.alias("example"), none.alias("prompt_hint"),
    )
    return P.build_fields(rows)[0].select("template_id", "key", "name", F.col("ord").cast("long").alias("ord"), "type", "required")


@query(
    "template_from_headers",
    """SELECT CASE n_nationkey % 5 WHEN 2 THEN 'field' ELSE trim(regexp_replace(lower(n_name), '[^\\p{L}\\p{N}]+', '_', 'g'), '_') END AS key, CASE n_nationkey % 5 WHEN 2 THEN '!!' ELSE n_name END AS name,
row_number() OVER (ORDER BY n_nationkey) - 1 AS ord FROM nation WHERE n_nationkey % 5 IN (0, 2)""",
)
def template_from_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    header = F.when(k % 5 == 0, F.concat(F.lit(" "), "n_name", F.lit(" "))).when(k % 5 == 1, F.concat(F.lit("Unnamed: "), k.cast("string"))).when(k % 5 == 2, "!!").when(k % 5 == 3, "nan")
    return P.fields_from_headers(n.select(k.alias("pos"), header.alias("header"))).select("key", "name", F.col("ord").cast("long").alias("ord"))


@query(
    "merge_union",
    """SELECT c_name AS name, c_mktsegment AS segment, '' AS balance, 'c' AS source_file FROM customer UNION ALL SELECT s_name, '', CAST(round(s_acctbal) AS BIGINT)::VARCHAR, 's' FROM supplier""",
)
def merge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("Name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name "), F.round("s_acctbal").cast("long").alias("balance"))
    out = M.merge_tables([("c", c), ("s", s)])
    return out.toDF("name", "segment", "balance", "source_file")


@query("merge_exact", "SELECT c_name AS name, c_mktsegment AS segment, '' AS nation FROM customer UNION ALL SELECT s_name, '', s_nationkey::VARCHAR FROM supplier")
def merge_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("nation"))
    return G.union_exact([c, s])


@query("merge_distinct", "SELECT c_mktsegment, c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY 1, 2")
def merge_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.keep_first(table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey", "c_custkey"), ["c_mktsegment", "c_nationkey"], ["c_custkey"])


@query("merge_rownum", "SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey, c_custkey) AS rn FROM customer")
def merge_rownum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.number_rows(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", ["c_custkey"]).select("c_custkey", "rn")


@query("merge_preview")
def merge_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of the headers of a folder with a workbook a document, headed by its first five words: sequence similarity has no SQL form."""
    words = F.slice(F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), " "), 1, 5)
    heads = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sheet"), F.posexplode(words).alias("col", "header"))
    return M.mapping(heads, M.leaders(heads)).select(F.col("sheet").alias("file"), F.col("header").alias("source_col"), F.col("target").alias("target_col"))


@query(
    "header_jaccard",
    """WITH k AS (SELECT s_nationkey AS f, list_distinct(list(lower(s_name[1:9]) || (s_suppkey % 7))) AS h FROM supplier GROUP BY 1)
SELECT coalesce(avg(len(list_intersect(a.h, b.h))::DOUBLE / len(list_distinct(a.h || b.h))), 1.0::DOUBLE) AS score FROM k a JOIN k b ON a.f < b.f""",
)
def header_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    name = F.concat(F.left("s_name", F.lit(9)), (F.col("s_suppkey") % 7).cast("string"))
    h = s.groupBy(F.col("s_nationkey").alias("file_id")).agg(F.collect_list(F.regexp_replace(name, "[#]", "")).alias("headers"))
    return G.header_jaccard(h)


@query(
    "headers_exact",
    """WITH h AS (SELECT c_nationkey AS n, list_sort(list_distinct(list(lower(c_mktsegment)))) AS h, list_sort(list_distinct(list(lower(c_mktsegment) || CASE WHEN c_custkey % 100 = 7 THEN ' b' ELSE '' END))) AS g FROM customer GROUP BY 1)
SELECT 1 AS k, count(DISTINCT h) <= 1 AS exact FROM h UNION ALL SELECT 2, count(DISTINCT g) <= 1 FROM h""",
)
def headers_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, segment = table(spark, sf_dir, "customer"), F.col("c_mktsegment")
    spelt = F.when(F.col("c_custkey") % 2 == 0, F.lower(segment)).otherwise(F.concat(F.lit(" "), segment, F.lit("-")))
    other = F.when(F.col("c_custkey") % 100 == 7, F.concat(segment, F.lit("_b"))).otherwise(segment)
    files = [c.groupBy(F.col("c_nationkey").alias("file_id")).agg(F.collect_set(h).alias("headers")) for h in (spelt, other)]
    out = [G.headers_equal(f).select(F.lit(k).alias("k"), "exact") for k, f in enumerate(files, 1)]
    return out[0].union(out[1])


@query("column_widths", "SELECT least(greatest(6, max(length(c_name))) + 2, 50) AS c_name, least(greatest(12, max(length(c_mktsegment))) + 2, 50) AS c_mktsegment FROM customer")
def column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.column_widths(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"])


@query(
    "normalised_names",
    r"""SELECT p_partkey, regexp_replace(upper(p_brand || '-' || p_size || ' 号'), '[^\p{L}\p{N}]', '', 'g') AS code, regexp_replace(p_name, '\s+', '', 'g') AS title,
trim(regexp_replace(lower('《' || p_type || '》'), '[^\p{L}\p{N}_ ]+', '', 'g')) AS header, trim(regexp_replace(lower(p_type), '[^\p{L}\p{N}_]+', '_', 'g'), '_') AS key FROM part""",
)
def normalised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    code = F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string"), F.lit(" 号"))
    return p.select(
        "p_partkey", T.normalise_code(code).alias("code"), T.normalise_title(F.concat(F.lit("《"), "p_name", F.lit("》发言稿.PDF"))).alias("title"),
        T.normalise_header(F.concat(F.lit("《"), "p_type", F.lit("》"))).alias("header"), T.slug(F.col("p_type")).alias("key"),
    )
