"""The reference's own cases of agenda matching, as data."""

import io
import random
import re
import zipfile
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from folioloom.functions import text as T
from folioloom.operators import agenda as A
from folioloom.operators import matching as M
from folioloom.sources import ooxml, writers

ITEM = "item_id string, order_no int, title string, code string"
DOC = "file_id string, pos int, filename string, extension string, extracted_title string, extracted_code string"


def items(spark, *rows):
    return spark.createDataFrame(list(rows), ITEM)


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), DOC)


def test_code_and_title_normal_forms(spark):
    r = spark.range(1).select(
        T.normalise_code(F.lit("ａ-００１ 号")).alias("c"), T.normalise_title(F.lit("《关于年度预算执行情况的报告材料》.pdf")).alias("t"), T.normalise_title(F.lit(None).cast("string")).alias("n")
    ).first()
    assert (r["c"], r["t"], r["n"]) == ("A001号", "关于年度预算执行情况的报告", "")


def test_ladder(spark):
    i = items(spark, ("i1", 1, "标题", "A-001"), ("i2", 2, "人工智能产业", None), ("i3", 3, "abcdefghij", None), ("i4", 4, "年度，预算方案", None))
    d = docs(
        spark, ("d1", 0, "x.pdf", ".pdf", "其他", "a 001"), ("d2", 1, "y.pdf", ".pdf", "人工智能产业", None), ("d3", 2, "人工智能产业补充说明.pdf", ".pdf", None, None),
        ("d4", 3, "z.pdf", ".pdf", "abcdefghiX", None), ("d5", 4, "w.pdf", ".pdf", "某某预算方案汇编及其说明文件", None), ("d6", 5, "v.pdf", ".pdf", "q", "A-001"),
    )
    got = {(r["item_id"], r["file_id"]): (r["score"], r["method"]) for r in M.match_scores(i, d).collect()}
    assert got == {
        ("i1", "d1"): (0.98, "code_normalised"), ("i1", "d6"): (1.0, "code_exact"), ("i2", "d2"): (0.95, "title_exact"), ("i2", "d3"): (0.90, "title_contains"),
        ("i3", "d4"): (0.88, "title_similarity"), ("i4", "d5"): (0.30, "keyword"),
    }


def test_containment_paths_agree(spark, monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(60)]
    i = spark.createDataFrame([(k, w) for k, w in enumerate(words[:25])], "item_id int, nt string")
    d = spark.createDataFrame([(k, w) for k, w in enumerate(words[25:] + ["", *words[:3]])], "file_id int, nt string")
    one = sorted(map(tuple, M.containment_pairs(i, d).collect()))
    monkeypatch.setattr(M, "BROADCAST_CHARS", -1)
    assert sorted(map(tuple, M.containment_pairs(i, d).collect())) == one and one


def greedy(scores, order, pos):
    used, out = set(), {}
    for item in order:
        ranked = sorted(((s, -pos[f], f) for (i, f), s in scores.items() if i == item), reverse=True)
        if not ranked:
            out[item] = (None, "unmatched")
            continue
        top, second = ranked[0][0], ranked[1][0] if len(ranked) > 1 else 0.0
        f = ranked[0][2]
        if top >= 0.85 and top - second >= 0.10 and f not in used:
            used.add(f)
            out[item] = (f, "matched")
        else:
            out[item] = (None, "needs_review")
    return out


def test_assignment_equals_sequential_model(spark):
    rng = random.Random(7)
    rows_i, rows_d, rows_s, want = [], [], [], {}
    for case in range(150):
        n, m = rng.randint(1, 5), rng.randint(1, 4)
        scores = {(f"{case}i{a}", f"{case}d{b}"): rng.choice([1.0, 0.98, 0.95, 0.9, 0.88, 0.75, 0.3]) for a in range(n) for b in range(m) if rng.random() < 0.6}
        want |= greedy(scores, [f"{case}i{a}" for a in range(n)], {f"{case}d{b}": b for b in range(m)})
        rows_i += [(f"{case}i{a}", a, "t", None) for a in range(n)]
        rows_d += [(f"{case}d{b}", b, "x", ".pdf", None, None) for b in range(m)]
        rows_s += [(i, f, s, "m") for (i, f), s in scores.items()]
    s = spark.createDataFrame(rows_s, "item_id string, file_id string, score double, method string")
    got = {r["item_id"]: (r["selected_file_id"], r["status"]) for r in M.assign(items(spark, *rows_i), docs(spark, *rows_d), s).collect()}
    assert got == want


def test_confirm_and_validate(spark):
    i, d = items(spark, ("i1", 1, "标题", None), ("i2", 2, "标题", None)), docs(spark, ("f1", 0, "a.pdf", ".pdf", "标题", None))
    matches = M.assign(i, d, M.match_scores(i, d, similarity=False))
    assert {r["item_id"]: r["status"] for r in matches.collect()} == {"i1": "matched", "i2": "needs_review"}
    done = M.confirm(matches, spark.createDataFrame([("i2", "f1", False)], "item_id string, file_id string, skip boolean"))
    r = done.where("item_id = 'i2'").first()
    assert (r["status"], r["manually_confirmed"], r["score"], r["match_method"]) == ("confirmed", True, 1.0, "manual")
    assert [r["error"] for r in M.validation_errors(done).collect()] == ["duplicate:f1"]


def test_output_names_and_zip(spark):
    odd = '标题 /:*?"<>|'
    rows = spark.createDataFrame([(1, odd, None, ".pdf", 1), (1, odd, None, "pdf", 2), (2, None, None, ".docx", 3)], "order_no int, title string, code string, extension string, k int")
    got = [r["output_filename"] for r in M.output_names(rows, "k").orderBy("k").collect()]
    assert got == ["001_标题 ________.pdf", "001_标题 _________2.pdf", "002_材料2.docx"]
    # a name that a numbered one has taken is passed over, in the order of the rows
    taken = spark.createDataFrame([(1, t, None, "pdf", k) for k, t in enumerate(["a", "a", "a_2", "a", "b_2", "b", "b", "c_7"])], "order_no int, title string, code string, extension string, k int")
    got = [r["output_filename"] for r in M.output_names(taken, "k").orderBy("k").collect()]
    assert got == ["001_a.pdf", "001_a_2.pdf", "001_a_2_2.pdf", "001_a_3.pdf", "001_b_2.pdf", "001_b.pdf", "001_b_3.pdf", "001_c_7.pdf"]
    report = ooxml.xlsx_bytes({"清单": [["顺序号", "原文件名"], [1, "原文件.pdf"]]})
    manifest = spark.createDataFrame([("f", "001_关于预算的报告.pdf")], "file_id string, output_filename string")
    z = zipfile.ZipFile(io.BytesIO(writers.renamed_zip(manifest, {"f": b"abc"}, report)))
    assert z.namelist() == ["001_关于预算的报告.pdf", "匹配清单.xlsx"] and z.read(z.namelist()[0]) == b"abc"
    assert list(ooxml.xlsx_cells(report)) == [("清单", 1, 1, "顺序号"), ("清单", 1, 2, "原文件名"), ("清单", 2, 1, "1"), ("清单", 2, 2, "原文件.pdf")]


def test_filename_identity(spark):
    r = spark.range(1).select(T.title_from_filename(F.lit("001_低碳技术创新功能型平台.ppt")).alias("t"), T.extension(F.lit("x/001.PPT")).alias("e")).first()
    assert (r["t"], r["e"]) == ("低碳技术创新功能型平台", ".ppt")


CELLS = "sheet string, row int, col int, value string"


def cells(spark, *rows):
    return spark.createDataFrame([("s", r, c, v) for r, row in rows for c, v in enumerate(row, 1) if v is not None], CELLS)


def test_agenda_header_rows(spark):
    intro = cells(spark, (1, ["标题页"]), (2, ["说明"]), (4, ["序号", "时间", "研发载体名称", "所在地"]), (5, ["1", "9:00", "平台", "上海"]))
    assert A.find_header_rows(intro).first()["header_row"] == 4
    bare = cells(spark, (1, ["1", "9:00-9:08", "低碳技术创新功能型平台", "上海"]), (2, ["2", "9:08-9:16", "平台", "上海"]))
    assert A.find_header_rows(bare).count() == 0 and A.headerless(bare).first()["headerless"]
    m = {r["role"]: r["header"] for r in A.detect_mapping(cells(spark, (1, ["发言顺序", "材料名称", "材料编号"])).select("col", F.col("value").alias("header"))).collect()}
    assert m == {"order_no": "发言顺序", "title": "材料名称", "code": "材料编号"}


def test_agenda_rows(spark):
    rows = [(2, "1", "标题一", ""), (3, "1", "标题二", ""), (4, "2", "", ""), (5, "4月23日下午", "x", ""), (6, "24.0", "", "A1"), (7, "inf", "x", ""), (8, None, "x", "")]
    r = A.validate_rows(spark.createDataFrame(rows, "source_row int, order_raw string, title string, code string")).orderBy("source_row").collect()
    assert [x["status"] for x in r] == ["item", "duplicate", "missing_identity", "skipped", "item", "skipped", "skipped"]
    assert r[1]["first_row"] == 2 and r[4]["order_no"] == 24


@pytest.mark.parametrize("top, second, status", [(1.0, 0.90, "needs_review"), (0.98, 0.88, "needs_review"), (0.95, 0.75, "matched"), (0.88, 0.75, "matched")])
def test_margins_are_double(spark, top, second, status):
    s = spark.createDataFrame([("i", "a", top, "m"), ("i", "b", second, "m")], "item_id string, file_id string, score double, method string")
    d = docs(spark, ("a", 0, "a", ".pdf", None, None), ("b", 1, "b", ".pdf", None, None))
    assert M.assign(items(spark, ("i", 1, "t", None)), d, s).first()["status"] == status


def brute_ladder(title, text):
    """calculate_match_score of the reference, without codes."""
    if title == text:
        return 0.95, "title_exact"
    a, b = (re.sub(r"\s+", "", x).strip(" .。") for x in (title, text))
    if a in b or b in a:
        return 0.90, "title_contains"
    if (sim := SequenceMatcher(None, a, b).ratio()) >= 0.8:
        return (0.88 if sim >= 0.9 else 0.75), "title_similarity"
    tokens = [w for w in re.split(r"[，,。；;：:\s]+", a) if len(w) >= 2]
    score = min(0.6 * sum(w in b for w in tokens) / len(tokens), 0.6) if tokens else 0
    return score, "keyword"


def test_queries_over_the_whole_ladder(spark, tmp_path):
    from folioloom.plans import matching as P

    titles = [(1, "annual budget of the city"), (2, "report on water,sewers"), (3, "minutes of the spring meeting"), (4, "zzzz"), (5, "plan for road repairs")]
    texts = [(10, "annual budget of the city"), (11, "annual budget of the citi"), (12, "all about sewers"), (13, "minutes of the sprung meating"), (14, "plan for roads and repairs"), (15, "qq")]
    spark.createDataFrame(titles, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    scores = {(i, d): s for i, t in titles for d, x in texts if (s := brute_ladder(t, x))[0] > 0}
    assert {m for _, m in scores.values()} == {"title_exact", "title_similarity", "keyword"}
    every = P.QUERIES["match_similarity"][0](spark, str(tmp_path)).collect()
    assert {(r["item_id"], r["file_id"]): (round(r["score"], 9), r["method"]) for r in every} == {k: (round(s, 9), m) for k, (s, m) in scores.items()}
    ranks = {i: sorted((d for j, d in scores if j == i), key=lambda d: (-scores[i, d][0], d)) for i, _ in titles}
    got = P.QUERIES["match_candidates_top5_whole"][0](spark, str(tmp_path)).collect()
    want = {(i, k + 1, d, *scores[i, d]) for i, r in ranks.items() for k, d in enumerate(r[:5])}
    assert {(r["item_id"], r["rnk"], r["file_id"], round(r["score"], 9), r["method"]) for r in got} == {(*w[:3], round(w[3], 9), w[4]) for w in want}
    used, states = set(), {}
    for i, r in sorted(ranks.items()):
        best = [scores[i, d][0] for d in r] + [0]
        take = bool(r) and best[0] >= 0.85 and best[0] - best[1] >= 0.10 and r[0] not in used
        used |= {r[0]} if take else set()
        states[i] = "matched" if take else "needs_review" if r else "unmatched"
    assert {r["item_id"]: r["status"] for r in P.QUERIES["match_assign_whole"][0](spark, str(tmp_path)).collect()} == states
    assert states[1] == "needs_review" and states[2] == "needs_review" and states[4] == "unmatched"
    unused = P.QUERIES["match_unused_docs_whole"][0](spark, str(tmp_path)).collect()
    assert {r["file_id"] for r in unused} == {d for d, _ in texts} - used
    for name in ("kpis", "report", "confirm_skip", "validate", "occupancy"):
        P.QUERIES[f"match_{name}_whole"][0](spark, str(tmp_path)).collect()
