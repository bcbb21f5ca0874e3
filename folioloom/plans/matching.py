"""Queries on agenda matching: ``benchmark`` as the agenda, ``documents`` as the candidates."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import matching as M
from .registry import Registry, registrar, spread, table

QUERIES: Registry = {}
query = registrar(QUERIES)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.col("item_id").alias("order_no"), F.col("text").alias("title"), F.lit(None).cast("string").alias("code"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return d.select(F.col("doc_id").alias("file_id"), F.col("doc_id").alias("pos"), name.alias("filename"), F.col("text").alias("extracted_title"), F.lit(None).cast("string").alias("extracted_code"))


def _scores(items: DataFrame, docs: DataFrame, whole: bool) -> DataFrame:
    """The rungs that SQL can express, or the whole ladder, with NFKC, similarity and keywords as in the reference."""
    return M.match_scores(items, docs, similarity=whole, native=not whole)


def _assigned(spark: SparkSession, sf_dir: str, whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    items, docs = _items(spark, sf_dir), _docs(spark, sf_dir)
    return items, docs, M.assign(items, docs, _scores(items, docs, whole))


def nt(x: str) -> str:
    """DuckDB form of ``normalise_title_native``."""
    t = f"regexp_replace({x}, '(?i)\\.(pdf|docx?|xlsx)$', '')"
    t = f"regexp_replace({t}, '[《》<>“”\"''‘’（）()\\[\\]【】]', '', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '[\\s\\x{{85}}\\x{{a0}}\\x{{3000}}]+', '', 'g'), '^[ .。]+|[ .。]+$', '', 'g')"
    for ending in T.WEAK_ENDINGS:
        t = f"regexp_replace({t}, '{ending}$', '')"
    return t


BASE = f"""
WITH i AS (SELECT item_id, item_id AS order_no, text AS title, {nt("text")} AS it FROM benchmark),
d AS (SELECT doc_id AS file_id, doc_id AS pos, text AS dtitle, {nt("text")} AS dt FROM documents),
s AS (
  SELECT item_id, file_id, pos, CASE WHEN title = dtitle THEN 0.95::DOUBLE ELSE 0.90::DOUBLE END AS score,
         CASE WHEN title = dtitle THEN 'title_exact' ELSE 'title_contains' END AS method
  FROM i JOIN d ON title = dtitle OR (it <> '' AND dt <> '' AND (contains(dt, it) OR contains(it, dt)))),
r AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, pos) AS rnk,
         lead(score, 1, 0.0::DOUBLE) OVER (PARTITION BY item_id ORDER BY score DESC, pos) AS next_score
  FROM s),
t AS (
  SELECT i.order_no, r.*, score >= 0.85::DOUBLE AND score - next_score >= 0.10::DOUBLE AS ready
  FROM r JOIN i USING (item_id) WHERE rnk = 1),
o AS (
  SELECT *, coalesce(bool_or(ready) OVER (PARTITION BY file_id ORDER BY order_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS occupied
  FROM t),
a AS (
  SELECT i.item_id, i.order_no, CASE WHEN ready AND NOT occupied THEN file_id END AS selected_file_id, coalesce(score, 0.0::DOUBLE) AS score,
         CASE WHEN o.item_id IS NULL THEN 'unmatched' WHEN ready AND NOT occupied THEN 'matched' ELSE 'needs_review' END AS status,
         coalesce(method, 'none') AS match_method
  FROM i LEFT JOIN o USING (item_id))
"""
COLUMNS = ["item_id", "order_no", "selected_file_id", "score", "status", "match_method"]


@query("match_assign", BASE + "SELECT * FROM a")
def match_assign(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    return _assigned(spark, sf_dir, whole)[2].select(COLUMNS)


@query("match_candidates_top5", BASE + "SELECT item_id, rnk, file_id, score, method FROM r WHERE rnk <= 5")
def match_candidates_top5(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    items, docs = _items(spark, sf_dir), _docs(spark, sf_dir)
    best = M.ranked(_scores(items, docs, whole), docs, 5)
    return best.select("item_id", "rnk", "file_id", "score", "method")


@query(
    "match_code_ladder",
    r"""
WITH i AS (SELECT p_partkey AS item_id, p_brand || '-' || p_partkey AS code FROM part),
d AS (SELECT p_partkey + 1000000 AS file_id, CASE p_partkey % 3 WHEN 0 THEN p_brand || '-' || p_partkey WHEN 1 THEN lower(p_brand) || ' ' || p_partkey ELSE 'none' || p_partkey END AS dcode FROM part),
n AS (SELECT *, regexp_replace(upper(code), '[^\p{L}\p{N}]', '', 'g') AS nc FROM i),
m AS (SELECT *, regexp_replace(upper(dcode), '[^\p{L}\p{N}]', '', 'g') AS dnc FROM d)
SELECT item_id, file_id, CASE WHEN code = dcode THEN 1.0::DOUBLE ELSE 0.98::DOUBLE END AS score,
       CASE WHEN code = dcode THEN 'code_exact' ELSE 'code_normalised' END AS method
FROM n JOIN m ON nc = dnc
""",
)
def match_code_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    code = F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string"))
    other = F.when(F.col("p_partkey") % 3 == 0, code).when(F.col("p_partkey") % 3 == 1, F.concat(F.lower("p_brand"), F.lit(" "), F.col("p_partkey").cast("string")))
    items = p.select(F.col("p_partkey").alias("item_id"), code.alias("code"), F.lit("").alias("title"))
    docs = p.select((F.col("p_partkey") + 1000000).alias("file_id"), other.alias("c"), F.lit("").alias("doc_title"), F.col("p_partkey").cast("string").alias("k"))
    docs = docs.select("file_id", F.coalesce("c", F.concat(F.lit("none"), "k")).alias("extracted_code"), "doc_title")
    return M.code_pairs(M.prepared(items, "title", "code", True), M.prepared(docs, "doc_title", "extracted_code", True))


@query(
    "match_keyword_score",
    r"""
WITH t AS (SELECT p_partkey, p_name AS r, list_filter(regexp_split_to_array(p_name || ' ' || p_type, '[，,。；;：:\s]+'), lambda x: length(x) >= 2) AS ts FROM part)
SELECT p_partkey, CASE WHEN len(ts) > 0 THEN 0.6::DOUBLE * len(list_filter(ts, lambda x: contains(r, x))) / len(ts) ELSE 0.0::DOUBLE END AS score FROM t
""",
)
def match_keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", T.keyword_score(F.concat_ws(" ", "p_name", "p_type"), F.col("p_name")).alias("score"))


@query("match_similarity")
def match_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, file_id, score, method) by the whole ladder, for every pair of benchmark and documents with a score."""
    return _scores(_items(spark, sf_dir), _docs(spark, sf_dir), True).select("item_id", "file_id", "score", "method")


@query("match_unused_docs", BASE + "SELECT file_id FROM d WHERE file_id NOT IN (SELECT selected_file_id FROM a WHERE selected_file_id IS NOT NULL)")
def match_unused_docs(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    _, docs, matches = _assigned(spark, sf_dir, whole)
    return M.unused_documents(docs, matches).select("file_id")


@query(
    "match_kpis",
    BASE
    + """SELECT (SELECT count(*) FROM a) AS items, (SELECT count(*) FROM d) AS docs, count(*) FILTER (status IN ('matched', 'confirmed')) AS done,
count(*) FILTER (status = 'needs_review') AS needs_review, count(*) FILTER (status = 'unmatched') AS unmatched,
(SELECT count(*) FROM d WHERE file_id NOT IN (SELECT selected_file_id FROM a WHERE selected_file_id IS NOT NULL)) AS unused FROM a""",
)
def match_kpis(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    return M.kpis(*_assigned(spark, sf_dir, whole))


@query(
    "match_report",
    BASE
    + """SELECT a.order_no, a.status, a.match_method, a.score, md5(title) AS title_md5, coalesce('doc' || selected_file_id || '.pdf', '') AS filename
FROM a JOIN i USING (item_id)""",
)
def match_report(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    items, docs, matches = _assigned(spark, sf_dir, whole)
    r = M.report(matches, items, docs).orderBy("order_key")
    return r.select("order_no", "status", "match_method", "score", F.md5("title").alias("title_md5"), "filename")


DECIDED = (
    BASE
    + """, c AS (
  SELECT item_id, order_no, CASE item_id % 3 WHEN 0 THEN NULL WHEN 1 THEN item_id % 5 ELSE selected_file_id END AS selected_file_id,
         CASE WHEN item_id % 3 = 1 THEN greatest(score, 1.0::DOUBLE) ELSE score END AS score,
         CASE item_id % 3 WHEN 0 THEN 'skipped' WHEN 1 THEN 'confirmed' ELSE status END AS status,
         CASE WHEN item_id % 3 = 1 THEN 'manual' ELSE match_method END AS match_method, item_id % 3 < 2 AS manually_confirmed
  FROM a)
"""
)


def _decided(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """Every third row skipped, the next of each three confirmed with one of the first five documents."""
    items, _, matches = _assigned(spark, sf_dir, whole)
    k = F.col("item_id") % 3
    d = items.where(k < 2).select("item_id", F.when(k == 1, F.col("item_id") % 5).alias("file_id"), (k == 0).alias("skip"))
    return M.confirm(matches, d)


@query("match_confirm_skip", DECIDED + "SELECT * FROM c")
def match_confirm_skip(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    return _decided(spark, sf_dir, whole).select(*COLUMNS, "manually_confirmed")


@query(
    "match_validate",
    DECIDED
    + """SELECT item_id, 'unresolved:' || status AS error FROM c WHERE status IN ('needs_review', 'unmatched', 'failed') UNION ALL
SELECT item_id, 'duplicate:' || selected_file_id FROM (SELECT *, row_number() OVER (PARTITION BY selected_file_id ORDER BY order_no) AS k FROM c WHERE selected_file_id IS NOT NULL) WHERE k > 1""",
)
def match_validate(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    return M.validation_errors(_decided(spark, sf_dir, whole))


@query(
    "match_occupancy",
    BASE
    + """SELECT r.item_id, r.file_id, h.held_by FROM r LEFT JOIN
(SELECT selected_file_id, min(order_no) AS held_by FROM a WHERE selected_file_id IS NOT NULL GROUP BY 1) h ON h.selected_file_id = r.file_id WHERE rnk <= 5""",
)
def match_occupancy(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    items, docs = _items(spark, sf_dir), _docs(spark, sf_dir)
    scores = _scores(items, docs, whole)
    return M.occupancy(M.top_candidates(scores, docs), M.assign(items, docs, scores))


def _whole(name: str) -> None:
    """Register ``name``_whole: the query over the whole ladder. The sequence ratio has no SQL form."""
    f = QUERIES[name][0]

    @query(f"{name}_whole")
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(spark, sf_dir, whole=True)


for _name in ("match_assign", "match_candidates_top5", "match_unused_docs", "match_kpis", "match_report", "match_confirm_skip", "match_validate", "match_occupancy"):
    _whole(_name)


@query(
    "output_filenames",
    r"""
WITH b AS (SELECT p_partkey, printf('%03d', p_size) || '_' || regexp_replace(p_brand, '[\\/:*?"<>|]', '_', 'g') AS base FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS k FROM b)
SELECT p_partkey, base || CASE WHEN k > 1 THEN '_' || k ELSE '' END || '.pdf' AS output_filename FROM k
""",
)
def output_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("order_no"), F.col("p_brand").alias("title"), F.lit("").alias("code"), F.lit("pdf").alias("extension"))
    return M.output_names(p, "p_partkey").select("p_partkey", "output_filename")


@query(
    "filename_identity",
    r"""
WITH n AS (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/?$', 1) AS b FROM pages),
s AS (SELECT page_id, CASE WHEN regexp_matches(b, '[^.]\.[^.]*$') THEN regexp_replace(b, '\.[^.]*$', '') ELSE b END AS stem, lower(regexp_extract(b, '[^.](\.[^.]*)$', 1)) AS ext FROM n)
SELECT page_id, ext, trim(regexp_replace(stem, '^[\d一二三四五六七八九十]+[、._\-\s]+', '')) AS title,
       nullif(regexp_extract(stem, '([A-Za-z]{0,6}\d[\p{L}\p{N}_\-〔〕\[\]（）()号第]*)', 1), '') AS code FROM s
""",
)
def filename_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), r"([^/]*)/?$", 1)
    p = table(spark, sf_dir, "pages").select("page_id", base.alias("b"))
    return p.select("page_id", T.extension(F.col("b")).alias("ext"), T.title_from_filename(F.col("b")).alias("title"), T.code_from_filename(F.col("b")).alias("code"))
