"""Queries on texts, pages, prompts and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import console as C
from ..operators import results as R
from .registry import Registry, registrar, spread, table

QUERIES: Registry = {}
query = registrar(QUERIES)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query(
    "doc_chunks",
    """SELECT doc_id, k AS chunk_no, md5(substr(text, k * 11500 + 1, 12000)) AS chunk_md5
FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 11500 + 1)) AS k FROM documents WHERE length(text) > 0)""",
)
def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_rows(_docs(spark, sf_dir)).select("doc_id", "chunk_no", F.md5("chunk").alias("chunk_md5"))


@query(
    "chunk_budget",
    """WITH c AS (SELECT doc_id, k, length(substr(text, k * 900 + 1, 1000)) AS n FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 900 + 1)) AS k FROM documents WHERE length(text) > 0)),
s AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS used, sum(n) OVER (PARTITION BY doc_id) AS total FROM c)
SELECT doc_id, k AS chunk_no, used::BIGINT AS used, total > 8000 AS truncated FROM s WHERE used <= 8000""",
)
def chunk_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.within_budget(C.chunk_rows(_docs(spark, sf_dir), 1000, 100), 8000).select("doc_id", "chunk_no", "used", "truncated")


@query(
    "doc_stats",
    r"""SELECT conv_id, count(*) AS page_count, count(*) FILTER (role = 'assistant') AS ocr_pages,
sum(length(regexp_replace(text, '^\s+|\s+$', '', 'g')))::BIGINT AS total_chars,
sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')))::BIGINT AS total_words,
coalesce(avg(turn::DOUBLE) FILTER (role = 'assistant'), 0.0::DOUBLE) AS avg_ocr_confidence FROM conversations GROUP BY conv_id""",
)
def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    pages = c.select(F.col("conv_id").alias("file_id"), "text", (F.col("role") == "assistant").alias("used_ocr"), F.col("turn").cast("double").alias("ocr_confidence"))
    return R.doc_stats(pages).withColumnRenamed("file_id", "conv_id")


@query(
    "doc_concat",
    r"""SELECT conv_id, md5(string_agg('--- Page ' || turn || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS text_md5
FROM conversations WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 5 GROUP BY conv_id""",
)
def doc_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("page_num"), "text")
    return R.doc_text(pages, numbered=True).select(F.col("file_id").alias("conv_id"), F.md5("full_text").alias("text_md5"))


@query(
    "kwic_search",
    """WITH h AS (SELECT doc_id, text, lower(text) AS low FROM documents WHERE contains(lower(text), 'the')),
p AS (SELECT doc_id, text, unnest(list_filter(range(1, length(low) - 1), lambda i: substr(low, i, 3) = 'the')[1:3]) AS hit FROM h),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hit) - 1 AS hit_no FROM p)
SELECT doc_id, hit_no, substr(text, greatest(hit - 120, 1), hit + 3 + 120 - greatest(hit - 120, 1)) AS excerpt FROM n""",
)
def kwic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(_docs(spark, sf_dir)).select(F.col("doc_id").alias("file_id"), F.lit(1).alias("page_num"), "text")
    return C.kwic(pages, "the").select(F.col("file_id").alias("doc_id"), "hit_no", "excerpt")


@query(
    "text_around",
    """SELECT doc_id, CASE WHEN hit > 0 THEN substr(text, greatest(hit - 300, 1), hit + 7 + 300 - greatest(hit - 300, 1)) ELSE '' END AS excerpt
FROM (SELECT doc_id, text, strpos(lower(text), 'license') AS hit FROM documents)""",
)
def text_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.text_around(F.col("text"), "license").alias("excerpt"))


@query(
    "snippet_verify",
    r"""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN substr(text, 11, 60) ELSE 'zzzz' || substr(text, 11, 60) || 'zzzz' END AS sn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
c AS (SELECT *, trim(regexp_replace(sn, '\s+', ' ', 'g')) AS q FROM s),
m AS (SELECT *, substr(q, length(q) // 4 + 1, length(q) * 3 // 4 - length(q) // 4) AS core FROM c),
a AS (SELECT *, strpos(t, core) AS hit FROM m)
SELECT doc_id, CASE WHEN length(sn) <= 20 THEN sn WHEN contains(t, q) THEN sn WHEN core <> '' AND hit > 0
  THEN substr(t, greatest(hit - 60, 1), hit + length(core) + 60 - greatest(hit - 60, 1)) ELSE '' END AS verified FROM a""",
)
def snippet_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.substring("text", 11, 60)
    sn = F.when(F.col("doc_id") % 2 == 0, part).otherwise(F.concat(F.lit("zzzz"), part, F.lit("zzzz")))
    return spread(_docs(spark, sf_dir)).select("doc_id", T.verify_snippet(sn, F.col("text")).alias("verified"))


@query(
    "clean_text",
    r"""WITH a AS (SELECT doc_id, regexp_replace(replace(replace(replace(replace(replace(text, '’', ''''), '‘', ''''), '“', '"'), '”', '"'), '–', '-'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(t, '([\p{L}\p{N}_]+)-\n([\p{L}\p{N}_]+)', '\1\2', 'g') AS t FROM a)
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '\n$', ''), '[ \t\r]+(\n|$)', '\1', 'g')) AS text_md5 FROM b""",
)
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_docs(spark, sf_dir)).select("doc_id", F.md5(T.clean_text_native(F.col("text"))).alias("text_md5"))


@query("clean_text_unicode")
def clean_text_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cleaning steps, with NFC, CJK rejoining and OCR fixes: the last two have no SQL form."""
    return spread(_docs(spark, sf_dir)).select("doc_id", F.md5(T.clean_text(F.col("text"), F.col("doc_id") % 2 == 0)).alias("text_md5"))


@query(
    "chat_last6",
    """SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS history
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 6 GROUP BY conv_id""",
)
def chat_last6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.last_messages(table(spark, sf_dir, "conversations"))


@query("chat_latest_assistant", "SELECT conv_id, max_by(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def chat_latest_assistant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.latest_by_role(table(spark, sf_dir, "conversations"), "assistant")


@query("transcript", "SELECT conv_id, string_agg('[' || upper(role) || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.transcript(table(spark, sf_dir, "conversations"))


@query(
    "md_tables",
    r"""WITH d AS (SELECT n_nationkey AS doc_id, 'Intro' || chr(10) || '| key | **name** |' || chr(10) || '|---|:--|' || chr(10) || '| ' || n_nationkey || ' | ' || n_name || ' | extra |' || chr(10) || 'x' || chr(10) || '| alone |' AS text FROM nation)
SELECT doc_id, 0 AS table_no, 0 AS row_no, ['key', 'name'] AS cells FROM d UNION ALL SELECT n_nationkey, 0, 1, [n_nationkey::VARCHAR, n_name] FROM nation""",
)
def md_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    row = F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), "n_name", F.lit(" | extra |"))
    return C.markdown_rows(n.select(F.col("n_nationkey").alias("doc_id"), F.concat_ws("\n", F.lit("Intro"), F.lit("| key | **name** |"), F.lit("|---|:--|"), row, F.lit("x"), F.lit("| alone |")).alias("text")))


@query("paragraph_packing")
def paragraph_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy packing of paragraphs to 900 characters: a fold, which SQL doesn't have."""
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(C.pack_paragraphs("text")).alias("part_no", "part"))


@query("slide_chunks", "SELECT conv_id, k AS slide_no, l[k * 7 + 1:k * 7 + 7] AS bullets FROM (SELECT conv_id, l, unnest(range(0, greatest((len(l) + 6) // 7, 1))) AS k FROM (SELECT conv_id, list(turn ORDER BY turn) AS l FROM conversations GROUP BY conv_id))")
def slide_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("l"))
    return lists.select("conv_id", F.posexplode(C.chunk_list(F.col("l"), 7)).alias("slide_no", "bullets"))


@query(
    "strip_markdown",
    r"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\*\*(.+?)\*\*', '\1', 'g'), '__(.+?)__', '\1', 'g'), '\*(.+?)\*', '\1', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '_(.+?)_', '\1', 'g'), '`(.+?)`', '\1', 'g'), '~~(.+?)~~', '\1', 'g') AS t FROM b),
d AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?m)^#{1,6}\s+', '', 'g'), '(?m)^[-–—]{3,}$', '', 'g') AS t FROM c),
e AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?m)^[*+-]\s+', '', 'g'), '(?m)^\d+[.)]\s+', '', 'g') AS t FROM d),
f AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS t FROM e)
SELECT doc_id, md5(trim(t, ' ' || chr(9) || chr(10) || chr(13) || chr(133) || chr(160) || chr(8232) || chr(8233) || chr(12288))) AS plain_md5 FROM f""",
)
def strip_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_docs(spark, sf_dir)).select("doc_id", F.md5(T.strip_markdown(F.col("text"))).alias("plain_md5"))


@query(
    "intent_flags",
    r"""SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: starts_with(trim(x, ' '), '|') AND ends_with(trim(x, ' '), '|'))) >= 3 AS has_table,
contains(lower(text), 'table') OR contains(lower(text), 'excel') AS wants_table FROM documents""",
)
def intent_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.has_table(F.col("text")).alias("has_table"), T.any_keyword(F.col("text"), ["table", "Excel"]).alias("wants_table"))


@query(
    "page_text_choice",
    r"""WITH d AS (SELECT d.doc_id, coalesce(d.text, '') AS t, coalesce(o.text, '') AS o FROM documents d LEFT JOIN documents o ON o.doc_id = d.doc_id + 1),
n AS (SELECT *, length(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS nt, length(regexp_replace(o, '^\s+|\s+$', '', 'g')) AS no FROM d)
SELECT doc_id, CASE WHEN nt < 50 AND no > nt * 1.2::DOUBLE THEN o ELSE t END AS chosen FROM n""",
)
def page_text_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as both readings: a document's own is the native one, that of the next id the OCR one."""
    d = _docs(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    other = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("ocr"))
    chosen = R.choose_text(F.col("text"), F.coalesce("ocr", F.lit("")), T.strip)
    return d.join(other, "doc_id", "left").select("doc_id", chosen.alias("chosen"))


@query("best_ocr", "SELECT conv_id AS file_id, 1 AS page_num, arg_max(text, (length(trim(text, ' ')), -turn)) AS text FROM conversations GROUP BY conv_id")
def best_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), F.lit(1).alias("page_num"), F.col("turn").alias("psm_pos"), "text")
    return R.best_ocr(reads)
