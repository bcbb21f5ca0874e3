"""Registered queries over the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import annulus, exact_dedup, html_text, line_dedup, ngram_join, packing, rank_bpe, spotsigs, suffix_dedup, token_count, turn_repair, url_filter
from . import toxicity as toxic


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_report(_documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir))


def op3_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return rank_bpe.bpe_round_trip(_documents(spark, sf_dir), vocabulary, public_tokenizers.PATTERN)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_pages(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxic.toxicity(docs, toxic.train(docs, labels))


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(_documents(spark, sf_dir))


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(_pages(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_documents(spark, sf_dir))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_documents(spark, sf_dir)).drop("spans", "kept")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annulus.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("centroid")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_line_dedup, op2_exact_dedup, op3_rank_bpe, op4_html_text, op5_toxicity, op6_spotsigs, op7_token_count, op8_url_filter, op9_packing, op10_ngram_join,
        op11_suffix_dedup, op12_centroid_clusters, op13_turn_repair,
    )
    return {f.__name__: f for f in found}


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g
  FROM w),
h AS (SELECT doc_id, hash(g) AS g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM h a JOIN h b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE c >= 0.8::DOUBLE * (na.n + nb.n - c) - 1e-9),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.y FROM r JOIN l ON l.x = r.seen),
c AS (SELECT node, min(seen) AS class_id FROM r GROUP BY node)
SELECT d.doc_id, c.class_id, (SELECT count(*) FROM l WHERE l.x = d.doc_id) AS n_links, coalesce(n.n, 0) AS n_shingles
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n, sha256(coalesce(text, '')) AS k FROM documents),
u AS (SELECT k, any_value(h) AS h, any_value(n) AS n, min(doc_id) AS doc_id FROM d GROUP BY k),
w AS (SELECT k, doc_id, i, hash(h[2 * i + 1:2 * i + 200]) AS x, md5_number_lower(h[2 * i + 1:2 * i + 200]) AS y FROM u, range(n - 99) t(i)),
r AS (SELECT k, i FROM w QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY doc_id, i) > 1),
s AS (SELECT k, i, i - lag(i) OVER (PARTITION BY k ORDER BY i) AS gap FROM r),
g AS (SELECT k, i, sum(CASE WHEN gap <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS span FROM s),
b AS (SELECT k, span, min(i) AS a, max(i) + 100 AS z FROM g GROUP BY k, span),
c AS (SELECT k, count(*) AS n_spans, sum(z - a) AS n_removed, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM b GROUP BY k),
t AS (
  SELECT u.k, u.doc_id, u.h, u.n, coalesce(n_spans, 0) AS n_spans, coalesce(n_removed, 0) AS n_removed,
         array_to_string(list_transform(list_zip(list_prepend(0, coalesce(z, [])), list_append(coalesce(a, []), u.n)), lambda p: h[2 * p[1] + 1:2 * p[2]]), '') AS kept
  FROM u LEFT JOIN c USING (k)),
o AS (
  SELECT d.doc_id, d.n, CASE WHEN d.doc_id = t.doc_id OR d.n < 100 THEN t.n_removed ELSE d.n END AS n_removed,
         CASE WHEN d.doc_id = t.doc_id OR d.n < 100 THEN t.n_spans ELSE 1 END AS n_spans, CASE WHEN d.doc_id = t.doc_id OR d.n < 100 THEN t.kept ELSE '' END AS kept
  FROM d JOIN t USING (k))
SELECT doc_id, n::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM o
"""

OP12_HEAD = r"""
WITH k AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS (SELECT row_number() OVER () AS r, vec_id, q FROM k),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), q) - 1 AS c, q FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), q) <= 16)"""

#: One round: vectors to nearest centroids, then the floors of the means; {i} is the round and {n} the next.
OP12_ROUND = r""",
a{i} AS (
  SELECT v.r, arg_min(c.c, (list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.c)) AS c,
         min(list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d
  FROM v, c{i} c GROUP BY v.r),
s{i} AS (
  SELECT c, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n
  FROM (SELECT a.c, unnest(v.q) AS x, generate_subscripts(v.q, 1) AS i FROM a{i} a JOIN v USING (r)) GROUP BY c, i),
m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS q FROM s{i} GROUP BY c),
c{n} AS (SELECT c.c, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m USING (c))"""

OP12_SQL = OP12_HEAD + "".join(OP12_ROUND.format(i=i, n=i + 1) for i in range(4)) + r"""
SELECT v.vec_id, a.c::INTEGER AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c3.q, ',')) AS centroid_sha256
FROM v JOIN a3 a USING (r) JOIN c3 ON c3.c = a.c
"""


def _step(cost: str, edit: str, *states: str) -> str:
    """The least of ``states`` with one more edit; a state is nine digits of cost, then the audit."""
    return f"list_min(list_transform([{', '.join(states)}], lambda x: lpad((left(x, 9)::INT + {cost})::VARCHAR, 9, '0') || x[10:] || '{edit}'))"


def _inserted(z: str, s: str, u: str, a: str) -> str:
    """States as (z: nothing yet, s, u, a), u and a also reached by inserts."""
    u1 = f"least({u}, {_step('3', 'I', z, s, a)})"
    a1 = f"least({a}, {_step('3', 'I', u1)})"
    return f"[{z}, {s}, least({u1}, {_step('3', 'I', a1)}), {a1}]"


_NONE = "NULL::VARCHAR"
_KEEP = "CASE WHEN NOT must_go AND i = '{}' THEN {} END"
_GIVE = "CASE WHEN NOT must_go THEN {} END"

OP13_SQL = r"""
WITH RECURSIVE r0 AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS k
  FROM conversations),
r1 AS (
  SELECT * EXCLUDE k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(k)), lambda j: ('0x' || hex(k)[2 * j + 1:2 * j + 2])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS f
  FROM r0),
d AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
         CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM r1, range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
o AS (
  SELECT *, left(role, 1) AS i, row_number() OVER w AS n,
         regexp_replace(text, '[ 	-
]+$', '') AS bare, lag(left(role, 1)) OVER w AS before
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
o1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS seen FROM o),
q AS (
  SELECT *, bare = '' AS is_blank, bare <> '' AND seen AS is_copy, bare <> '' AND NOT seen AND right(bare, 1) NOT IN ('.', '!', '?') AS is_cut,
         bare = '' OR seen AS must_go, CASE WHEN bare <> '' AND NOT seen AND right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS t,
         before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au') AS is_illegal
  FROM o1),
p AS (
  SELECT conv_id, 0::BIGINT AS n, """ + _inserted("'000000000'", _NONE, _NONE, _NONE) + r""" AS v FROM (SELECT DISTINCT conv_id FROM q)
  UNION ALL
  SELECT conv_id, n, """ + _inserted("m[1]", "m[2]", "m[3]", "m[4]") + r""" AS v FROM (
    SELECT q.conv_id, q.n, [
      """ + _step("4", "D", "v[1]") + r""",
      least(""" + _step("4", "D", "v[2]") + ", " + _KEEP.format("s", _step("t", "K", "v[1]")) + r"""),
      least(""" + _step("4", "D", "v[3]") + ", " + _KEEP.format("u", _step("t", "K", "v[1]", "v[2]", "v[4]")) + ", " + _GIVE.format(_step("3 + t", "R", "v[1]", "v[2]", "v[4]")) + r"""),
      least(""" + _step("4", "D", "v[4]") + ", " + _KEEP.format("a", _step("t", "K", "v[3]")) + ", " + _GIVE.format(_step("3 + t", "R", "v[3]")) + r""")] AS m
    FROM p JOIN q ON q.conv_id IS NOT DISTINCT FROM p.conv_id AND q.n = p.n + 1)),
e AS (SELECT conv_id, least(v[1], v[4]) AS best FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
x AS (
  SELECT conv_id, best[10:] AS audit, len(replace(best[10:], 'D', '')) % 2 AS odd, unnest(range(1, len(best) - 8)) AS j FROM e),
y AS (
  SELECT conv_id, j, audit[j] AS edit, len(replace(audit[1:j], 'I', '')) AS n, len(replace(audit[1:j], 'D', '')) - odd AS place FROM x WHERE audit[j] <> 'D'),
z AS (
  SELECT y.conv_id, string_agg(CASE WHEN edit = 'K' THEN q.role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE q.text END, chr(10) ORDER BY j) AS repaired
  FROM y LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM y.conv_id AND q.n = y.n AND edit <> 'I' GROUP BY y.conv_id),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank, count(*) FILTER (is_copy) AS duplicate,
         count(*) FILTER (is_cut) AS truncated, count(*) FILTER (is_illegal) AS illegal
  FROM q GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(left(best, 9)::BIGINT, 0) AS cost, coalesce(best[10:], '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op10_ngram_join": OP10_SQL, "op11_suffix_dedup": OP11_SQL, "op12_centroid_clusters": OP12_SQL, "op13_turn_repair": OP13_SQL}
