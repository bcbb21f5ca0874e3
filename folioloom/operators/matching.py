"""Agenda items to documents: score ladder, ranking, one-to-one assignment, review, reports."""

from __future__ import annotations

from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .durable import keep
from .ladder import GRAM, rungs
from .similar import similar_pairs

#: Every task holds the items up to this many characters in all; beyond it, candidates come from joins.
BROADCAST_CHARS = 16_000_000
SIMILAR_FROM = 0.8
AUTO_SCORE, AUTO_MARGIN = 0.85, 0.10
SCORES = {"code_exact": 1.0, "code_normalised": 0.98, "title_exact": 0.95, "title_contains": 0.90}
METHOD_ORDER = ("code_exact", "code_normalised", "title_exact", "title_contains", "title_similarity", "keyword")
UNRESOLVED = ("needs_review", "unmatched", "failed")
REASONS = {
    "code_exact": "编号完全一致",
    "code_normalised": "编号标准化后一致",
    "title_exact": "标题完全一致",
    "title_contains": "标题包含匹配",
    "keyword": "少量关键词命中",
}
OCCUPIED, NO_CANDIDATE = "最高候选已被其他顺序项占用", "没有候选文件"


def prepared(df: DataFrame, title: str, code: str, native: bool = False) -> DataFrame:
    """Add nt and nc, the normalised title and code. ``native`` skips NFKC, for text that is in it already."""
    nt, nc = (T.normalise_title_native, T.normalise_code_native) if native else (T.normalise_title, T.normalise_code)
    return df.withColumns({"nt": nt(F.col(title)), "nc": nc(F.col(code))})


def _grams(text: Column, n: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n)))


def _contained(short: DataFrame, long: DataFrame, short_key: str, long_key: str) -> DataFrame:
    """(short_key, long_key) where ``s`` of ``short`` is in ``l`` of ``long``, as an equi-join on n-grams with verification.

    The first GRAM characters of the shorter text (all of it, if it is shorter) must be among the n-grams of that length of the longer one.
    """
    n = F.least(F.length("s"), F.lit(GRAM))
    heads = short.select(short_key, "s", n.alias("n"), F.left("s", n).alias("g"))
    sizes = F.array(*(F.lit(r["n"]) for r in heads.select("n").distinct().orderBy("n").collect()))  # at most GRAM numbers
    spread = long.select(long_key, "l", F.explode(sizes.cast("array<int>")).alias("n")).where(F.length("l") >= F.col("n"))
    grams = spread.select(long_key, "l", "n", F.explode(_grams(F.col("l"), F.col("n"))).alias("g"))
    return heads.join(grams, ["n", "g"]).where(F.contains("l", "s")).select(short_key, long_key)


def _fits(items: DataFrame) -> bool:
    """Whether the items' titles are few enough to be held by every task."""
    return (items.agg(F.sum(F.length("nt")).alias("n")).first()["n"] or 0) <= BROADCAST_CHARS


def _streamed(items: DataFrame, docs: DataFrame, least: float | None, item_key: str = "item_id", doc_key: str = "file_id", fold: bool = True, highest: bool = False) -> DataFrame:
    """(item_id, file_id, score, method) of the rungs of ``ladder.rungs``; the documents stream past the items, with ``pos`` if they have one and ``highest`` is set.

    Documents without ``nt`` have their ``doc_title`` compared with the items' ``title`` as it is, and then normalised on the way, as
    ``fold`` of ``plain_title`` says.
    """
    as_written = F.lit(None).cast("string") if "nt" in docs.columns else F.col("title")
    rows = items.select(item_key, "nt", T.keyword_tokens(F.col("nt")), as_written).collect()  # BROADCAST_CHARS at most
    agenda = [tuple(r)[:3] for r in rows if r["nt"]]
    written = [(r[3], r[0]) for r in rows if r[3]]
    kinds = {"item_id": items.schema[item_key].dataType, "file_id": docs.schema[doc_key].dataType}
    schema = ", ".join(f"{k} {v.simpleString()}" for k, v in kinds.items()) + ", score double, method string"
    title, normalise = ("nt", None) if "nt" in docs.columns else ("doc_title", partial(T.plain_title, fold=fold))
    along = ["pos"] if highest and "pos" in docs.columns else []
    schema += "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in along)
    return docs.select(F.col(doc_key).alias("file_id"), F.col(title).alias("dt"), *along).mapInPandas(rungs(agenda, least, normalise, written, highest), schema)


def containment_pairs(items: DataFrame, docs: DataFrame, item_key: str = "item_id", doc_key: str = "file_id") -> DataFrame:
    """(item_id, file_id) where one normalised title contains the other; both sides have ``nt``.

    While the items' titles together are at most BROADCAST_CHARS long, documents stream past them. Beyond, it is an
    equi-join on n-grams either way.
    """
    if _fits(items):
        return _streamed(items, docs, None, item_key, doc_key).select(F.col("item_id").alias(item_key), F.col("file_id").alias(doc_key))
    i, d = items.where("nt <> ''").select(item_key, F.col("nt").alias("s")), docs.where("nt <> ''").select(doc_key, F.col("nt").alias("s"))
    a = _contained(i, d.withColumnRenamed("s", "l"), item_key, doc_key)
    b = _contained(d, i.withColumnRenamed("s", "l"), doc_key, item_key).select(item_key, doc_key)
    return a.union(b).distinct()


def code_pairs(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, file_id, score, method): equal codes, as written or normalised, by hash joins."""
    i, d = items.select("item_id", "code", "nc"), docs.select("file_id", F.col("extracted_code").alias("dcode"), F.col("nc").alias("dnc"))
    met = i.where("code <> ''").join(d.where("dcode <> ''"), (F.col("nc") == F.col("dnc")) & ((F.col("nc") != "") | (F.col("code") == F.col("dcode"))))
    exact = F.col("code") == F.col("dcode")
    return met.select("item_id", "file_id", F.when(exact, F.lit(1.0)).otherwise(F.lit(0.98)).alias("score"), F.when(exact, "code_exact").otherwise("code_normalised").alias("method"))


def title_pairs(items: DataFrame, docs: DataFrame, similarity: bool = False, native: bool = False) -> DataFrame:
    """Equal titles, containment by ``containment_pairs``; with ``similarity`` also the two rungs below.

    A pair may be there by several rungs. Documents may come without ``nt``, as ``prepared`` makes it with or without ``native``: then each is
    read once for all rungs, unless the items are many. Otherwise equal titles are found by a hash join.
    """
    if _fits(items) and "nt" not in docs.columns:
        return _streamed(items, docs, SIMILAR_FROM if similarity else None, fold=not native)
    i, d = items.where("title <> ''").select("item_id", "title"), docs.where("doc_title <> ''").select("file_id", F.col("doc_title").alias("dtitle"))
    exact = i.join(d, F.col("title") == F.col("dtitle")).select("item_id", "file_id", F.lit(0.95).alias("score"), F.lit("title_exact").alias("method"))
    if _fits(items):
        return exact.unionByName(_streamed(items, docs, SIMILAR_FROM if similarity else None, fold=not native))
    if "nt" not in docs.columns:
        docs = docs.withColumn("nt", (T.normalise_title_native if native else T.normalise_title)(F.col("doc_title")))
    within = containment_pairs(items, docs).select("item_id", "file_id", F.lit(0.90).alias("score"), F.lit("title_contains").alias("method"))
    return exact.unionByName(within).unionByName(residual_pairs(items, docs)) if similarity else exact.unionByName(within)


def residual_pairs(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Similarity and keyword rungs by joins, for items that no task can hold."""
    i = items.where("nt <> ''").select("item_id", F.col("nt").alias("a"))
    d = docs.where("nt <> ''").select("file_id", F.col("nt").alias("b"))
    close = i.join(similar_pairs(i, d, SIMILAR_FROM), "a").join(d, "b")
    alike = close.select("item_id", "file_id", F.when(F.col("ratio") >= 0.9, F.lit(0.88)).otherwise(F.lit(0.75)).alias("score"), F.lit("title_similarity").alias("method"))
    tokens = i.select("item_id", T.keyword_tokens(F.col("a")).alias("t")).select("item_id", F.size("t").alias("of"), F.explode("t").alias("s"))
    tokens = tokens.groupBy("item_id", "of", "s").agg(F.count("*").alias("times"))
    met = tokens.join(_contained(tokens.select("s").distinct().withColumn("token", F.col("s")), d.withColumnRenamed("b", "l"), "token", "file_id").distinct(), F.col("s") == F.col("token"))
    words = met.groupBy("item_id", "file_id").agg(F.least(F.lit(0.60) * F.sum("times") / F.first("of"), F.lit(0.6)).alias("score"))
    return alike.unionByName(words.select("item_id", "file_id", "score", F.lit("keyword").alias("method")))


def best_rung(pairs: DataFrame) -> DataFrame:
    """One row a pair: its highest rung."""
    return pairs.groupBy("item_id", "file_id").agg(F.max(F.struct("score", "method")).alias("s")).select("item_id", "file_id", "s.score", "s.method")


def _repeats(docs: DataFrame) -> bool:
    """Whether two documents have one file_id."""
    return not docs.groupBy("file_id").count().where("count > 1").isEmpty()


def match_scores(items: DataFrame, docs: DataFrame, similarity: bool = True, native: bool = False) -> DataFrame:
    """(item_id, file_id, score, method) of every pair with a score above 0, and the documents' ``pos`` where no pair had to be brought together.

    ``items``: item_id, title, code. ``docs``: file_id, filename, extracted_title, extracted_code. Rungs are strictly
    ordered, so a pair's highest score is the first rung it reaches. The scores are kept as a table: what follows reads them more than once.
    Without codes and repeated file_ids all rungs of a pair are seen with the one document, and no pair is shuffled.
    """
    docs = docs.withColumn("doc_title", F.coalesce(F.nullif("extracted_title", F.lit("")), T.strip_extension(F.col("filename"))))
    i, d = prepared(items, "title", "code", native), prepared(docs, "doc_title", "extracted_code", native).drop("nt")
    codes = code_pairs(i, d)
    if _fits(i) and codes.isEmpty() and not _repeats(docs):
        return keep(_streamed(i, d, SIMILAR_FROM if similarity else None, fold=not native, highest=True), "match-scores")
    return keep(best_rung(codes.unionByName(title_pairs(i, d, similarity, native))), "match-scores")


def ranked(scores: DataFrame, docs: DataFrame, most: int) -> DataFrame:
    """The ``most`` best candidates by rank, ties in order of the documents' ``pos``, which scores may bring along; with the score of the next one, 0 if there is none.

    All others but one an item go before the shuffle: a limit on the rank alone is one that Spark applies to each partition first.
    """
    w = Window.partitionBy("item_id")
    placed = (scores if "pos" in scores.columns else scores.join(docs.select("file_id", "pos"), "file_id")).withColumn("rnk", F.row_number().over(w.orderBy(F.desc("score"), "pos")))
    best = placed.where(F.col("rnk") <= most + 1)
    return best.withColumn("next_score", F.lead("score", 1, 0.0).over(w.orderBy("rnk"))).where(F.col("rnk") <= most)


def top_candidates(scores: DataFrame, docs: DataFrame, most: int = 5) -> DataFrame:
    """(item_id, candidate_file_ids): up to ``most`` in order of rank."""
    best = ranked(scores, docs, most)
    listed = best.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("rnk", "file_id"))).alias("c"))
    return listed.select("item_id", F.col("c.file_id").alias("candidate_file_ids"))


def assign(items: DataFrame, docs: DataFrame, scores: DataFrame) -> DataFrame:
    """Greedy one-to-one assignment in order of order_no, as windows.

    An item only ever tries its best candidate, and only an item whose best has 0.85 and leads by 0.10 can take it. So
    a document goes to the first such item, and is occupied for those behind it.
    """
    best = ranked(scores, docs, 1)
    ready = (F.col("score") >= F.lit(AUTO_SCORE)) & (F.col("score") - F.col("next_score") >= F.lit(AUTO_MARGIN))
    ahead = Window.partitionBy("file_id").orderBy("order_no", "item_id").rowsBetween(Window.unboundedPreceding, -1)
    tried = best.join(items.select("item_id", "order_no"), "item_id").withColumn("ready", ready)
    tried = tried.withColumn("occupied", F.coalesce(F.max("ready").over(ahead), F.lit(False)))
    taken = F.col("ready") & ~F.col("occupied")
    found = tried.select(
        "item_id", F.when(taken, F.col("file_id")).alias("selected_file_id"), "score", "method", "occupied", F.when(taken, "matched").otherwise("needs_review").alias("status")
    )
    return items.select("item_id", "order_no").join(found, "item_id", "left").select(
        "item_id", "order_no", "selected_file_id", F.bround(F.coalesce("score", F.lit(0.0)), 2).alias("score"),
        F.coalesce("status", F.lit("unmatched")).alias("status"), F.coalesce("method", F.lit("none")).alias("match_method"),
        F.when(F.col("status").isNull(), NO_CANDIDATE).when(F.col("occupied"), OCCUPIED).otherwise(reason(F.col("method"), F.col("score"))).alias("match_reason"),
    )


def reason(method: Column, score: Column) -> Column:
    out = F.when(method == "title_similarity", F.concat(F.lit("标题相似度 "), F.format_string("%.2f", score)))
    for m, text in REASONS.items():
        out = out.when(method == m, text)
    return out


def confirm(matches: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply (item_id, file_id, skip): a skip clears the selection, a choice confirms it; the rest stays."""
    d = decisions.select("item_id", F.col("file_id").alias("chosen"), "skip")
    j = matches.join(d, "item_id", "left")
    skip, pick = F.coalesce("skip", F.lit(False)), F.col("chosen").isNotNull() & ~F.coalesce("skip", F.lit(False))
    return j.withColumns(
        {
            "selected_file_id": F.when(skip, None).when(pick, F.col("chosen")).otherwise(F.col("selected_file_id")),
            "status": F.when(skip, "skipped").when(pick, "confirmed").otherwise(F.col("status")),
            "score": F.when(pick, F.greatest("score", F.lit(1.0))).otherwise(F.col("score")),
            "match_method": F.when(pick, "manual").otherwise(F.col("match_method")),
            "match_reason": F.when(skip, "人工跳过").when(pick, "人工确认").otherwise(F.col("match_reason")),
            "manually_confirmed": skip | pick,
        }
    ).drop("chosen", "skip")


def validation_errors(matches: DataFrame) -> DataFrame:
    """(item_id, error): unresolved rows, and each further use of a document."""
    open_ = matches.where(F.col("status").isin(*UNRESOLVED)).select("item_id", F.concat(F.lit("unresolved:"), "status").alias("error"))
    w = Window.partitionBy("selected_file_id").orderBy("order_no", "item_id")
    again = matches.where("selected_file_id is not null").withColumn("k", F.row_number().over(w)).where("k > 1")
    return open_.unionByName(again.select("item_id", F.concat(F.lit("duplicate:"), F.col("selected_file_id").cast("string")).alias("error")))


def unused_documents(docs: DataFrame, matches: DataFrame) -> DataFrame:
    used = matches.where("selected_file_id is not null").select(F.col("selected_file_id").alias("file_id"))
    return docs.join(used, "file_id", "left_anti")


def occupancy(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """For each listed candidate, the order_no that holds the file (the least), or null."""
    held = matches.where("selected_file_id is not null").groupBy(F.col("selected_file_id").alias("file_id")).agg(F.min("order_no").alias("held_by"))
    return candidates.select("item_id", F.explode("candidate_file_ids").alias("file_id")).join(held, "file_id", "left")


def kpis(items: DataFrame, docs: DataFrame, matches: DataFrame) -> DataFrame:
    m = matches.agg(
        F.count("*").alias("items"),
        F.count_if(F.col("status").isin("matched", "confirmed")).alias("done"),
        F.count_if(F.col("status") == "needs_review").alias("needs_review"),
        F.count_if(F.col("status") == "unmatched").alias("unmatched"),
    )
    d = docs.agg(F.count("*").alias("docs"))
    u = unused_documents(docs, matches).agg(F.count("*").alias("unused"))
    return m.crossJoin(d).crossJoin(u)  # one row each


def output_names(rows: DataFrame, order: str = "order_no") -> DataFrame:
    """Add output_filename from order_no, title, code and extension.

    In order of ``order``, a name already given gets _2, _3 ... behind its base, the first that is still free. Where no
    base ends like such a number, that is the row's number among its equals. Only bases that differ by such endings
    alone can take each other's names: those families, each an agenda's few items with one order_no, are dealt with
    together.
    """
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif("code", F.lit("")), F.concat(F.lit("材料"), F.col("order_no").cast("string")))
    ext = F.when(F.col("extension").startswith("."), F.col("extension")).otherwise(F.concat(F.lit("."), "extension"))
    base = F.concat(F.format_string("%03d", "order_no"), F.lit("_"), T.sanitize_filename_native(title))
    named = rows.withColumns({"_base": base, "_ext": ext}).withColumn("_family", F.regexp_replace("_base", r"(_\d+)+$", ""))
    family = Window.partitionBy("_family", "_ext")
    k = F.row_number().over(Window.partitionBy("_family", "_base", "_ext").orderBy(order))
    mixed = F.min("_base").over(family) != F.max("_base").over(family)
    judged = named.withColumns({"_k": k, "_mixed": mixed})
    plain = judged.where("not _mixed").withColumn("_name", F.concat("_base", F.when(F.col("_k") > 1, F.concat(F.lit("_"), F.col("_k").cast("string"))).otherwise(F.lit("")), "_ext"))

    def name(group: pd.DataFrame) -> pd.DataFrame:
        used, names = set(), []
        group = group.sort_values(order, kind="stable")
        for stem, end in zip(group["_base"], group["_ext"], strict=True):
            shown, n = stem + end, 2
            while shown in used:
                shown, n = f"{stem}_{n}{end}", n + 1
            used.add(shown)
            names.append(shown)
        return group.assign(_name=names)

    shared = judged.where("_mixed")
    shared = shared.groupBy("_family", "_ext").applyInPandas(name, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in shared.schema)}, _name string")
    return plain.unionByName(shared).select(*rows.columns, F.col("_name").alias("output_filename"))


def report(matches: DataFrame, items: DataFrame, docs: DataFrame) -> DataFrame:
    """The match list: matches with their item and document, in order of order_no, missing items last."""
    i = items.select("item_id", "title", "code")
    d = docs.select(F.col("file_id").alias("selected_file_id"), "filename", "extracted_title", "extracted_code")
    matches = keep(matches, "matches")  # read twice; few beside the documents, which are then not shuffled
    chosen = d.join(matches.select("selected_file_id").distinct(), "selected_file_id")
    j = matches.join(i, "item_id", "left").join(chosen, "selected_file_id", "left")
    text = [c for c in ("title", "code", "filename", "extracted_title", "extracted_code")]
    return j.withColumns({c: F.coalesce(c, F.lit("")) for c in text}).withColumn("order_key", F.coalesce("order_no", F.lit(999999)))
