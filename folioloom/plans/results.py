"""Queries on extraction results: files, fields, issues, edits, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce as K
from ..functions.json_fields import fields_from_json as explode_fields
from ..functions.json_fields import repaired_json
from ..operators import results as R
from .registry import Registry, registrar, table

QUERIES: Registry = {}
query = registrar(QUERIES)

FILES_SQL = """WITH f AS (
  SELECT d.doc_id AS file_id, d.source AS task_id, d.source || '/File' || d.doc_id || '.pdf' AS filename,
         CASE WHEN quality IS NULL THEN 'pending' WHEN quality = 1 THEN 'success' ELSE 'needs_review' END AS status,
         CASE WHEN quality = 0 THEN 1 ELSE 0 END AS issue_count
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    q = F.col("quality")
    return d.join(l, "doc_id", "left").select(
        F.col("doc_id").alias("file_id"), F.col("source").alias("task_id"),
        F.concat("source", F.lit("/File"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"),
        F.when(q.isNull(), "pending").when(q == 1, "success").otherwise("needs_review").alias("status"),
        F.when(q == 0, 1).otherwise(0).alias("issue_count"),
    )


@query(
    "admit_files",
    """WITH f AS (SELECT doc_id, source || CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' ELSE '.txt' END AS filename, n_chars // 100 AS size FROM documents)
SELECT doc_id, filename, size, CASE WHEN lower(right(filename, 4)) = '.txt' THEN 'unsupported'
  WHEN row_number() OVER (PARTITION BY filename, size ORDER BY doc_id) > 1 THEN 'duplicate' END AS reason FROM f""",
)
def admit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    end = F.when(F.col("doc_id") % 3 == 0, ".pdf").when(F.col("doc_id") % 3 == 1, ".DOCX").otherwise(".txt")
    files = d.select("doc_id", F.concat("source", end).alias("filename"), F.expr("n_chars div 100").alias("size"), F.col("doc_id").alias("pos"))
    return R.admit_files(files).drop("pos")


@query(
    "admission_tally",
    """WITH f AS (SELECT doc_id, lang, source || CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' ELSE '.txt' END AS filename, n_chars // 100 AS size FROM documents),
g AS (SELECT lang, lower(right(filename, 4)) = '.txt' AS wrong, row_number() OVER (PARTITION BY filename, size ORDER BY doc_id) > 1 AS again FROM f)
SELECT lang, count(*) FILTER (NOT wrong AND NOT again) AS accepted, count(*) FILTER (wrong OR again) AS rejected, count(*) FILTER (wrong) AS unsupported, count(*) FILTER (again AND NOT wrong) AS duplicate FROM g GROUP BY lang""",
)
def admission_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return R.admission_tally(admit_files(spark, sf_dir).join(langs, "doc_id"), ("lang",))


@query("task_counts", FILES_SQL + "SELECT task_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in R.STATUSES) + " FROM f GROUP BY task_id")
def task_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.status_counts(_files(spark, sf_dir), ("task_id",))


@query("task_progress", FILES_SQL + "SELECT task_id, round(100.0::DOUBLE * count(*) FILTER (status IN ('success', 'needs_review', 'failed', 'cancelled')) / count(*), 1) AS progress FROM f GROUP BY task_id")
def task_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.progress(_files(spark, sf_dir), ("task_id",))


@query("task_status", FILES_SQL + "SELECT task_id, CASE WHEN bool_and(status IN ('success', 'needs_review', 'failed', 'cancelled')) THEN 'completed' ELSE 'running' END AS task_status FROM f GROUP BY task_id")
def task_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.task_status(_files(spark, sf_dir), ("task_id",))


@query(
    "required_missing",
    """SELECT d.doc_id AS file_id, k.key FROM documents d CROSS JOIN (VALUES ('quality'), ('toxic')) k(key)
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
)
def required_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"))
    template = spark.createDataFrame([("quality", True), ("toxic", True), ("note", False)], "key string, required boolean")
    labels = table(spark, sf_dir, "labels")
    values = labels.select(F.col("doc_id").alias("file_id"), F.expr("stack(2, 'quality', cast(quality as string), 'toxic', cast(toxic as string)) as (key, raw_value)"))
    return R.required_missing(files, template, values)


@query(
    "file_status",
    """SELECT d.doc_id AS file_id, CASE WHEN d.doc_id % 50 = 0 THEN 'failed' WHEN l.doc_id IS NULL THEN 'needs_review' ELSE 'success' END AS status,
CASE WHEN l.doc_id IS NULL THEN 2 ELSE 0 END AS issue_count FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.col("doc_id").alias("file_id"), F.when(F.col("doc_id") % 50 == 0, "broken").alias("error_message"))
    return R.file_status(files, required_missing(spark, sf_dir)).select("file_id", "status", F.col("issue_count").cast("long").alias("issue_count"))


@query(
    "results_filter_page",
    FILES_SQL
    + """SELECT file_id, filename, status, total FROM (SELECT *, count(*) OVER () AS total FROM f WHERE status = 'needs_review' AND contains(lower(filename), 'src1') AND issue_count > 0)
ORDER BY file_id LIMIT 50""",
)
def results_filter_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.filter_results(_files(spark, sf_dir), "needs_review", "SRC1", True)
    return R.page(found, ["file_id"], 1, 50).select("file_id", "filename", "status", "total")


@query("export_scope", FILES_SQL + "SELECT 'default' AS scope, count(*) AS n FROM f WHERE status IN ('success', 'needs_review') UNION ALL SELECT 'all', count(*) FROM f UNION ALL SELECT 'selected', count(*) FROM f WHERE file_id IN (1, 2, 3)")
def export_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    parts = [("default", R.export_scope(f, "success_only")), ("all", R.export_scope(f, "all")), ("selected", R.export_scope(f, "selected", [1, 2, 3]))]
    out = [p.agg(F.count("*").alias("n")).select(F.lit(s).alias("scope"), "n") for s, p in parts]
    return out[0].union(out[1]).union(out[2])


def _edited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Values after edits: a fitting, an unfitting and an empty balance, and a segment where no value row was."""
    c = table(spark, sf_dir, "customer")
    values = c.select(F.col("c_custkey").alias("file_id"), F.expr("stack(2, 'balance', cast(cast(round(c_acctbal) as bigint) as string), 'name', c_name) as (key, raw_value)"), F.lit(False).alias("manually_edited"))
    m = F.col("c_custkey") % 5
    key = F.when(m == 3, "segment").otherwise("balance")
    edits = c.where(m < 4).select(F.col("c_custkey").alias("file_id"), key.alias("key"), F.when(m == 0, "12,5").when(m == 1, "abc").when(m == 3, F.col("c_mktsegment")).otherwise("").alias("new_value"), F.lit(1).alias("seq"))
    template = spark.createDataFrame([("balance", "Balance", "decimal", True), ("name", "Name", "text", True), ("segment", "Segment", "text", False)], "key string, name string, type string, required boolean")
    return R.apply_edits(values, edits, template)[0], template


@query(
    "patch_recalc",
    """WITH e AS (SELECT c_custkey AS file_id, CASE c_custkey % 5 WHEN 0 THEN '12,5' WHEN 1 THEN 'abc' WHEN 2 THEN '' END AS v, c_custkey % 5 AS m FROM customer)
SELECT file_id, k.key, CASE WHEN k.key = 'balance' AND m IN (0, 2) THEN v WHEN k.key = 'name' THEN c_name ELSE round(c_acctbal)::BIGINT::VARCHAR END AS raw_value,
       k.key = 'balance' AND m IN (0, 2) AS manually_edited
FROM e JOIN customer ON c_custkey = file_id CROSS JOIN (VALUES ('balance'), ('name')) k(key)
UNION ALL SELECT c_custkey, 'segment', c_mktsegment, true FROM customer WHERE c_custkey % 5 = 3""",
)
def patch_recalc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir)[0].select("file_id", "key", "raw_value", "manually_edited")


@query(
    "run_figures",
    """SELECT count(*) AS total, count(*) FILTER (c_custkey % 5 <> 2 AND c_custkey % 7 <> 0) AS success, count(*) FILTER (c_custkey % 5 = 2 OR c_custkey % 7 = 0) AS needs_review, 0::BIGINT AS failed,
       count(*) FILTER (c_custkey % 5 IN (0, 2, 3)) AS edited FROM customer""",
)
def run_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.run_figures(status_after_edit(spark, sf_dir), _edited(spark, sf_dir)[0])


@query(
    "status_after_edit",
    """SELECT c_custkey AS file_id, CASE WHEN c_custkey % 5 = 2 OR c_custkey % 7 = 0 THEN 'needs_review' ELSE 'success' END AS status,
       (c_custkey % 5 = 2)::BIGINT + (c_custkey % 7 = 0)::BIGINT + (c_custkey % 3 = 0)::BIGINT AS n_issues FROM customer""",
)
def status_after_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before the edits every third file missed its balance (or so it was noted), every seventh had a type issue, and some a warning."""
    values, template = _edited(spark, sf_dir)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"))
    noted = [(3, "required_missing"), (7, "type_invalid"), (3, "low_confidence")]
    issues = [c.where(F.col("file_id") % n == 0).select("file_id", F.lit("balance").alias("key"), F.lit(kind).alias("issue_type"), F.lit("").alias("message")) for n, kind in noted]
    files, left = R.recalculate_status(values, issues[0].union(issues[1]).union(issues[2]), template)
    counts = left.groupBy("file_id").agg(F.count("*").alias("n_issues"))
    return files.join(counts, "file_id", "left").select("file_id", "status", F.coalesce("n_issues", F.lit(0)).cast("long").alias("n_issues"))


@query(
    "export_wide",
    """SELECT c_custkey AS file_id, c_name AS "Name", coalesce(nullif(c_mktsegment, 'BUILDING'), '') AS "Segment", CASE WHEN c_acctbal > 0 THEN '是' ELSE '否' END AS "Solvent" FROM customer""",
)
def export_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "file_id")
    none = F.lit(None)
    shown = F.array(
        F.struct(F.lit("name").alias("key"), R.rendered(F.col("c_name"), none.cast("boolean"), none.cast("array<string>")).alias("shown")),
        F.struct(F.lit("segment").alias("key"), R.rendered(F.nullif("c_mktsegment", F.lit("BUILDING")), none.cast("boolean"), none.cast("array<string>")).alias("shown")),
        F.struct(F.lit("solvent").alias("key"), R.rendered(none.cast("string"), F.col("c_acctbal") > 0, none.cast("array<string>")).alias("shown")),
    )
    values = c.select("file_id", F.explode(shown).alias("v")).select("file_id", "v.key", "v.shown")
    return R.export_wide(c.select("file_id"), [("name", "Name"), ("segment", "Segment"), ("solvent", "Solvent")], values)


@query("issue_log", """SELECT user_id AS file_id, string_agg('[' || event_type || '] ' || event_id, chr(10) ORDER BY event_id) AS log FROM events GROUP BY user_id""")
def issue_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return R.issue_log(e.select(F.col("user_id").alias("file_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("field_name"), F.col("event_id").cast("string").alias("message")))


@query("latest_attempt_upsert", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_attempt_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return R.latest(e, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("retry_ordinal", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS retry_count FROM events")
def retry_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return R.retry_ordinal(e, ["user_id"], [F.col("ts"), F.col("event_id")]).select("event_id", F.col("retry_count").cast("long").alias("retry_count"))


@query("newest_tasks", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 100")
def newest_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "ts")


@query(
    "fields_from_json",
    """SELECT event_id AS file_id, 'k' AS key, json_extract_string(props, '$.k') AS raw_value, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS v_int, false AS type_invalid FROM events
UNION ALL SELECT event_id, 'z', NULL, NULL, false FROM events""",
)
def fields_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("file_id"), F.col("props").alias("raw_json"))
    template = spark.createDataFrame([("k", "K", "integer", True, 0), ("z", "Z", "integer", False, 1)], "key string, name string, type string, required boolean, ord int")
    return explode_fields(e, template).select("file_id", "key", "raw_value", "v_int", "type_invalid")


@query(
    "json_repair",
    """SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events""",
)
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("event_id") % 4
    answer = (
        F.when(m == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```")))
        .when(m == 1, F.concat(F.lit("Sure, "), "props", F.lit(" - done")))
        .when(m == 2, F.replace("props", F.lit('"'), F.lit("'")))
        .otherwise(F.lit("no json {"))
    )
    e = table(spark, sf_dir, "events").select("event_id", repaired_json(answer).alias("j"))
    return e.select("event_id", F.get_json_object("j", "$.k").alias("k"))


@query(
    "coerce_int",
    r"""SELECT c_custkey, TRY_CAST(nullif(regexp_extract(regexp_replace(r, '[,， ]', '', 'g'), '[-+]?\d+'), '') AS BIGINT) AS v
FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '1,234,' || c_custkey WHEN 1 THEN '约' || c_custkey || '份' WHEN 2 THEN '-12.7' WHEN 3 THEN c_mktsegment ELSE '99999999999999999999' END AS r FROM customer)""",
)
def coerce_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, m, k = table(spark, sf_dir, "customer"), F.col("c_custkey") % 5, F.col("c_custkey").cast("string")
    raw = F.when(m == 0, F.concat(F.lit("1,234,"), k)).when(m == 1, F.concat(F.lit("约"), k, F.lit("份"))).when(m == 2, "-12.7").when(m == 3, F.col("c_mktsegment")).otherwise("99999999999999999999")
    return c.select("c_custkey", K.to_int(raw).alias("v"))


@query(
    "coerce_float",
    r"""SELECT c_custkey, TRY_CAST(nullif(regexp_extract(regexp_replace(r, '[,， ¥￥$€£₹元亿]|万元', '', 'g'), '[-+]?\d+\.?\d*'), '') AS DOUBLE) AS v
FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '¥' || c_acctbal || '元' WHEN 1 THEN '1.2万元' WHEN 2 THEN '$1,000.50' ELSE c_name END AS r FROM customer)""",
)
def coerce_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, m = table(spark, sf_dir, "customer"), F.col("c_custkey") % 4
    raw = F.when(m == 0, F.concat(F.lit("¥"), F.col("c_acctbal").cast("string"), F.lit("元"))).when(m == 1, "1.2万元").when(m == 2, "$1,000.50").otherwise(F.col("c_name"))
    return c.select("c_custkey", K.to_float(raw).alias("v"))


@query(
    "coerce_date",
    r"""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d')
WHEN 3 THEN year(o_orderdate) || '-' || month(o_orderdate) || '-' || day(o_orderdate) WHEN 4 THEN '2024-02-30' END AS v FROM orders""",
)
def coerce_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, m, d = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 6, F.col("o_orderdate")
    raw = (
        F.when(m == 0, F.date_format(d, "yyyy-MM-dd")).when(m == 1, F.date_format(d, "yyyy年M月d日")).when(m == 2, F.date_format(d, "M/d/yyyy"))
        .when(m == 3, F.date_format(d, "yyyyMMdd")).when(m == 4, "2024-02-30").otherwise("2024年13月40日")
    )
    return o.select("o_orderkey", K.to_date(raw).alias("v"))


@query("coerce_written_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 < 8 THEN strftime(o_orderdate, '%Y-%m-%d') END AS v FROM orders")
def coerce_written_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in eight written forms, and some without a day."""
    forms = ("d MMMM yyyy", "MMM d, yyyy", "EEEE, dd MMM yyyy", "dd-MMM-yyyy HH:mm", "yyyy MMMM d", "MMMM d yyyy 'at' hh:mm", "ddMMMyyyy")
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 9
    ordinal = F.concat(F.date_format(d, "MMMM d"), F.lit("th of "), F.date_format(d, "yyyy"))
    raw = F.when(k == 7, ordinal).when(k == 8, F.date_format(d, "MMMM yyyy"))
    for i, form in enumerate(forms):
        raw = raw.when(k == i, F.date_format(d, form))
    return table(spark, sf_dir, "orders").select("o_orderkey", K.to_date(raw).alias("v"))


@query("coerce_bool", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS v FROM orders")
def coerce_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select("o_orderkey", K.to_bool(F.when(s == "F", " 同意 ").when(s == "O", "No").otherwise("maybe")).alias("v"))


@query(
    "coerce_list",
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN ['a', 'b,c', c_mktsegment] WHEN 1 THEN ['x', c_mktsegment] ELSE [c_name] END AS v FROM customer""",
)
def coerce_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("c_custkey") % 3
    raw = F.when(m == 0, F.concat(F.lit("a； b,c；；"), "c_mktsegment")).when(m == 1, F.concat(F.lit('["x", " '), "c_mktsegment", F.lit(' "]'))).otherwise(F.concat(F.lit(" "), "c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", K.to_list(raw).alias("v"))


@query(
    "edit_coercion",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) || '-' || lpad(day(o_orderdate)::VARCHAR, 2, '0') || '-' || lpad(month(o_orderdate)::VARCHAR, 2, '0') ELSE 'soon' END AS d,
o_orderstatus = 'F' AS valid FROM orders""",
)
def edit_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, d = table(spark, sf_dir, "orders"), F.col("o_orderdate")
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(d, "d/M/yyyy")).otherwise(" soon ")
    value = F.when(F.col("o_orderstatus") == "F", "1,5").otherwise("12 pcs")
    return o.select("o_orderkey", K.edit_date(raw).alias("d"), K.edit_valid(value, F.lit("decimal")).alias("valid"))
