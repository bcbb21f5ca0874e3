"""Coercion, text, templates, results, merge, sources and streaming on small data."""

import hashlib
import io
import json
import random
import re
import zipfile
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioloom.functions import coerce as K
from folioloom.functions import json_fields as J
from folioloom.functions import text as T
from folioloom.operators import backends, console, folder_merge, merge, results, template
from folioloom.sources import files, ooxml, writers
from folioloom.streaming import admission


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r["x"] for r in rows.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_coercion_of_extracted_values(spark):
    assert column(spark, ["1,234", "12.7", "约3份", "-5", "x", None], K.to_int) == [1234, 12, 3, -5, None, None]
    assert column(spark, ["1.2万元", "¥1,000.50", "$ 3", "none"], K.to_float) == [1.2, 1000.5, 3.0, None]
    dates = ["2024-02-30", "2024年3月5日", "3/5/2024", "13/05/2024", "20240305", "2024.13.40", "x"]
    assert column(spark, dates, K.to_date) == ["2024-02-30", "2024-03-05", "2024-03-05", "2024-05-13", "2024-3-5", None, None]
    assert column(spark, ["是", "错", " TRUE ", "maybe"], K.to_bool) == [True, False, True, None]
    assert column(spark, ["a；b，c", '["x", " y "]', "a、b", "one", "[bad", "a,,b"], K.to_list) == [["a", "b，c"], ["x", "y"], ["a", "b"], ["one"], ["[bad"], ["a", "b"]]


def test_coercion_of_edits(spark):
    assert column(spark, ["13/05/2024", "2024年3月5日", "2024-1-2", "soon", "2024-02-30x"], K.edit_date) == ["2024-13-05", "2024-03-05", "2024-01-02", "soon", "2024-02-30x"]
    assert column(spark, ["y", "不是", "对"], K.edit_bool) == [True, False, None]
    assert column(spark, ["1,5", "12 pcs", "", None, "1e3", "inf"], lambda v: K.edit_valid(v, F.lit("integer"))) == [True, False, True, True, True, False]


def test_json_answers(spark):
    answers = ['```json\n{"a": 1}\n```', 'Sure: {"a": 2} ok', "{'a': None}", "[1]", "{", None]
    assert [x and json.loads(x) for x in column(spark, answers, J.repaired_json)] == [{"a": 1}, {"a": 2}, {"a": None}, [1], None, None]
    fields = spark.createDataFrame([("a", "A", "integer", True, 0), ("b", "B", "text", False, 1)], "key string, name string, type string, required boolean, ord int")
    rows = spark.createDataFrame([(1, '{"a": {"value": "x", "source_snippet": "s"}, "b": " t ", "c": 1}')], "file_id int, raw_json string")
    got = {r["key"]: r for r in J.fields_from_json(rows, fields).collect()}
    assert got["a"]["type_invalid"] and got["a"]["source_snippet"] == "s" and got["b"]["v_text"] == "t" and not got["b"]["type_invalid"]


def test_text_functions(spark):
    assert column(spark, ["evalu-\nation", "中文-\n字", "a"], T.dehyphenate) == ["evaluation", "中文-\n字", "a"]
    assert column(spark, ["中 文 字 符", "a b"], T.rejoin_cjk) == ["中文 字符", "a b"]
    assert column(spark, ["A0B", "1O1", "1l1", "a l b"], T.ocr_fixes) == ["AOB", "101", "111", "a 1 b"]
    assert column(spark, ["ﬁx “q”\x00 \n\n\n\nend  \n", None], T.clean_text) == ['fix "q"\n\nend', ""]
    assert column(spark, ["　x y　", " "], T.word_count) == [2, 0]
    assert column(spark, ["aaaa", "xAaA"], lambda v: T.keyword_starts(v, "aa")) == [[1, 2, 3], [2, 3]]
    assert column(spark, ["x" * 30], lambda v: F.size(T.chunks(v, 12, 2))) == [3]
    pairs = [("abcd", "abxd"), ("xyz", "zyx"), ("", "a")]
    df = spark.createDataFrame(pairs, "a string, b string").select(T.sequence_ratio("a", "b").alias("r"))
    assert [r["r"] for r in df.collect()] == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_snippets(spark):
    full = "The quick  brown fox\njumps over the lazy dog and runs far away"
    rows = ["quick brown fox jumps over", "wrong start fox jumps over the lazy wrong", "entirely made up text here", "short"]
    got = column(spark, rows, lambda v: T.verify_snippet(v, F.lit(full)))
    assert got[0] == rows[0] and got[2] == "" and got[3] == "short"


def test_templates(spark):
    rows = [("t", 0, "合同 编号", None, "text", "是", "HT", None), ("t", 1, "金额", None, "number", "否", None, None), ("t", 2, "金额", None, "小数", "", None, None), ("t", 3, " ", None, None, None, None, None)]
    fields, errors = template.build_fields(spark.createDataFrame(rows, "template_id string, row int, name string, description string, type string, required string, example string, prompt_hint string"))
    assert [(r["key"], r["type"], r["required"], r["ord"]) for r in fields.orderBy("ord").collect()] == [("合同_编号", "text", True, 0), ("金额", "integer", False, 1)]
    assert [r["row_number"] for r in errors.collect()] == [4]


def test_results(spark):
    f = spark.createDataFrame([("a.pdf", 1, 0), ("a.pdf", 1, 1), ("b.exe", 1, 2), ("a.pdf", 2, 3), (".pdf", 3, 4)], "filename string, size long, pos int")
    assert [r["reason"] for r in results.admit_files(f).orderBy("pos").collect()] == [None, "duplicate", "unsupported", None, "unsupported"]
    r = spark.createDataFrame([(k, f"F%{k}.pdf", "success", k % 2) for k in range(120)], "file_id int, filename string, status string, issue_count int")
    assert results.filter_results(r, keyword="f%1").count() == 31
    page = results.page(r, ["file_id"], 3, 50).collect()
    assert len(page) == 20 and page[0]["total"] == 120
    with pytest.raises(ValueError):
        results.page(r, ["file_id"], 0)
    values = spark.createDataFrame([(1, "n", "5", False), (2, "n", "6", False)], "file_id int, key string, raw_value string, manually_edited boolean")
    edits = spark.createDataFrame([(1, "n", "7", 1), (1, "n", "8", 2), (2, "n", "9", 1), (2, "zz", "1", 2)], "file_id int, key string, new_value string, seq int")
    merged, bad = results.apply_edits(values, edits, spark.createDataFrame([("n", "integer")], "key string, type string"))
    assert {r["file_id"]: r["raw_value"] for r in merged.collect()} == {1: "8", 2: "6"} and bad.count() == 1
    # an edit of a field without a value row adds one; the status follows
    template = spark.createDataFrame([("n", "N", "integer", True), ("t", "T", "text", True)], "key string, name string, type string, required boolean")
    more = spark.createDataFrame([(1, "t", "new", 1), (2, "n", "", 1)], "file_id int, key string, new_value string, seq int")
    merged, bad = results.apply_edits(values, more, template)
    assert sorted((r["file_id"], r["key"], r["raw_value"], r["manually_edited"]) for r in merged.collect()) == [(1, "n", "5", False), (1, "t", "new", True), (2, "n", "", True)]
    noted = spark.createDataFrame([(1, "t", "required_missing", "old"), (1, "n", "low_confidence", "x")], "file_id int, key string, issue_type string, message string")
    files, left = results.recalculate_status(merged, noted, template)
    assert {r["file_id"]: r["status"] for r in files.collect()} == {1: "success", 2: "needs_review"}
    assert sorted((r["file_id"], r["key"], r["issue_type"], r["message"]) for r in left.collect()) == [(1, "n", "low_confidence", "x"), (2, "n", "required_missing", "必填字段 [N] 未找到值"), (2, "t", "required_missing", "必填字段 [T] 未找到值")]


def test_merge_against_pandas(spark):
    heads = [(k, c, h) for k, f in enumerate([["姓名", "手机号"], ["客户姓名", "联系电话", "City", "Citys"]]) for c, h in enumerate(f)]
    found = folder_merge.leaders(spark.createDataFrame(heads, "sheet int, col int, header string"))
    assert [r["name"] for r in found.orderBy("at").collect()] == ["姓名", "联系电话", "City"]
    a, b = pd.DataFrame({"x": ["1", "2"], "y": ["a", "b"]}), pd.DataFrame({"y": ["c"], "z": ["d"]})
    got = merge.union_exact([spark.createDataFrame(a), spark.createDataFrame(b)]).toPandas()
    pd.testing.assert_frame_equal(got, pd.concat([a, b], ignore_index=True).fillna(""))
    out = folder_merge.merge_tables([("f1", spark.createDataFrame([("n", "1")], ["姓名", "手机"])), ("f2", spark.createDataFrame([("m", "2")], ["客户姓名", "电话"]))])
    assert sorted(map(tuple, out.collect())) == [("m", "2", "f2"), ("n", "1", "f1")]
    rows = spark.createDataFrame([(1, "h", "序号", "Unnamed: 2"), (2, " a ", "1", "x"), (3, "h", "序号", "Unnamed: 2"), (4, "", " ", None)], ["n", "h", "序号", "Unnamed: 2"])
    # only a first row that repeats the header goes
    assert [tuple(r) for r in merge.clean_rows(rows, ["n"]).orderBy("n").collect()] == [(2, "a"), (3, "h")]
    assert [tuple(r) for r in merge.clean_rows(rows.where("n > 1"), ["n"]).orderBy("n").collect()] == [(2, "a"), (3, "h")]


def test_markdown_and_packing(spark):
    text = "x\n| a | **b** |\n|---|---|\n| 1 | 2 |\n\n| lone |\n| k |\n| v | w |"
    got = [(r["table_no"], r["row_no"], r["cells"]) for r in console.markdown_rows(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("table_no", "row_no").collect()]
    assert got == [(0, 0, ["a", "b"]), (0, 1, ["1", "2"]), (1, 0, ["lone"]), (1, 1, ["k"]), (1, 2, ["v"])]
    parts = column(spark, ["p" * 500 + "\n" + "q" * 500 + "\nr", None, ""], console.pack_paragraphs)
    assert [len(p) for p in parts[0]] == [500, 502] and parts[1] is None and parts[2] == [""]
    # line breaks don't count
    assert column(spark, ["p" * 450 + "\n" + "q" * 450 + "\nr", " \n "], console.pack_paragraphs) == [["p" * 450 + "\n" + "q" * 450, "r"], [" \n "]]


def test_backend_failures_are_rows(spark):
    def flaky(prompt):
        if prompt == "bad":
            raise RuntimeError("no answer")
        return "{}"

    got = {r["file_id"]: (r["raw_json"], r["error_message"]) for r in backends.ask(spark.createDataFrame([(1, "ok"), (2, "bad")], "file_id int, prompt string"), flaky).collect()}
    assert got == {1: ("{}", None), 2: (None, "no answer")}


def test_office_files(spark, tmp_path):
    (tmp_path / "t.xlsx").write_bytes(ooxml.xlsx_bytes({"s1": [["name", "n"], ["a", 1], [None, "NA"]], "s2": [["z"]]}))
    (tmp_path / "~$t.xlsx").write_bytes(b"lock")
    (tmp_path / "d.docx").write_bytes(ooxml.docx_bytes([("Heading1", "Top"), ("", "one"), ("page", "two")], [[["a", "a", "b"], ["a", "b"]]]))
    (tmp_path / "bad.docx").write_bytes(b"not a zip")
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("ppt/slides/slide1.xml", '<p xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:p><a:t>hi</a:t></a:p><a:tbl><a:tr><a:tc><a:p><a:t>c1</a:t></a:p></a:tc><a:tc><a:p><a:t>c2</a:t></a:p></a:tc></a:tr></a:tbl></p>')
    (tmp_path / "s.pptx").write_bytes(z.getvalue())
    found = files.scan(spark, str(tmp_path))
    assert found.count() == 4
    cells = files.sheet_cells(found.where("extension = '.xlsx'"))
    assert cells.where("sheet = 's2'").first()["value"] == "z"
    assert sorted(map(str, files.sheet_table(cells.where("sheet = 's1'"), na=True).drop("_row").collect())) == ["Row(name='a', n='1')"]
    pages = {(r["filename"], r["page_num"]): r["text"] for r in files.pages(found.where("extension <> '.xlsx'")).collect()}
    assert pages[("d.docx", 1)] == "# Top\none" and pages[("d.docx", 2)] == "two\na | b" and ("bad.docx", None) in pages
    assert pages[("s.pptx", 1)] == "--- Slide 1 ---\nhi\nc1 | c2"
    wide = spark.createDataFrame([("f", "v")], "filename string, A string")
    assert list(ooxml.xlsx_cells(writers.results_xlsx(wide)))[-1] == ("results", 2, 2, "v")


def test_streamed_admission(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"filename": "a.pdf", "size": 1, "arrived": "2024-01-01T00:00:00Z"}, {"filename": "a.pdf", "size": 1, "arrived": "2024-01-01T01:00:00Z"}, {"filename": "a.txt", "size": 1, "arrived": "2024-01-01T00:00:00Z"}]
    (tmp_path / "in/x.json").write_text("\n".join(map(json.dumps, rows)))
    q = admission.start(admission.admitted(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_registered_queries_have_unique_columns_and_sql():
    import __spark_entry__ as e

    names = e.queries()
    assert set(e.oracle_sql()) <= set(names) and "match_assign" in names


def brute_strip_md(text):
    text = text or ""
    for mark in (r"\*\*", "__", r"\*", "_", "`", "~~"):
        text = re.sub(f"{mark}(.+?){mark}", lambda m: m.group(1), text)
    for pattern in (r"^#{1,6}\s+", r"^[-–—]{3,}$", r"^[*+-]\s+", r"^\d+[.)]\s+"):
        text = re.sub(pattern, "", text, flags=re.M)
    return re.sub(r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "", re.sub(r"\n{3,}", "\n\n", text)).strip()


def test_queries_over_whole_texts(spark, tmp_path):
    from folioloom.plans import documents as D

    rng = random.Random(31)
    bits = ["**bold**", "__u__", "*i*", "_x_", "`c`", "~~s~~", "# H ", "#######", "---", "—––", "- a", "* b", "+\xa0c", "1. d", "٣) e", "\n", "\n", "\n\n\n", "\r\n", "\x85", "\u2028", "\x1c", "\x07", " ", "\u3000", "plain words", "a_b", "$1", "\\1", "*", "_", "é😀"]
    texts = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for k in range(400)] + [(400, None), (401, "x " * 40 + "**end**\n- last")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["plain_md5"] for r in D.QUERIES["strip_markdown"][0](spark, str(tmp_path)).collect()}
    assert got == {k: hashlib.md5(brute_strip_md(x).encode()).hexdigest() for k, x in texts}
    by_id = {k: x or "" for k, x in texts}
    want = {}
    for k, x in by_id.items():
        n, other = len(x.strip()), by_id.get(k + 1, "")
        want[k] = other if n < 50 and len(other.strip()) > n * 1.2 else x
    assert {r["doc_id"]: r["chosen"] for r in D.QUERIES["page_text_choice"][0](spark, str(tmp_path)).collect()} == want
