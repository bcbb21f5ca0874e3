"""Extraction runs: whatever goes wrong with one file is a row of its own."""

import json

from folioloom.operators import extraction as X

TEMPLATE = [("a", "A", "text", True, 1), ("b", "B", "integer", False, 0), ("c", "C", "list", True, 2)]


def run(spark, files):
    def model(prompt):
        text = prompt.split(X.OPEN, 1)[1][: -len(X.CLOSE)]
        if text.startswith("raise"):
            raise TimeoutError("too slow")
        if text.startswith("narrow"):
            return json.dumps({"a": str(len(text)), "c": ["x"]}) if len(text) == X.NARROWED else "{"
        return text

    df = spark.createDataFrame(files, "file_id int, filename string, text string, read_error string, earlier_retries int")
    template = spark.createDataFrame(TEMPLATE, "key string, name string, type string, required boolean, ord int")
    return X.run_extraction(df, template, model)


def test_every_way_to_fail(spark):
    good = '{"a": {"value": " v ", "source_snippet": "v"}, "b": "3 pieces", "c": ["p", "q"]}'
    files = [
        (1, "good", good, None, None), (2, "unread", good, "broken zip", 2), (3, "empty", "", None, None), (4, "null", None, None, 0),
        (5, "raises", "raise", None, 1), (6, "prose", "no json here", None, None), (7, "list", "[1]", None, None), (8, "none", "null", None, None),
        (9, "narrow", "narrow" + "x" * 9000, None, 4), (10, "blank", '{"a": "   ", "b": "none", "c": []}', None, None), (11, "absent", "{'a': None}", None, None),
    ]
    got = run(spark, files)
    results = {r["filename"]: r for r in got.results.collect()}
    assert len(results) == len(files)
    status = {k: r["status"] for k, r in results.items()}
    assert status == {"good": "success", "unread": "failed", "empty": "failed", "null": "failed", "raises": "failed", "prose": "failed", "list": "failed", "none": "failed",
                      "narrow": "success", "blank": "needs_review", "absent": "needs_review"}
    assert results["unread"]["error_message"] == "broken zip" and results["empty"]["error_message"] == results["null"]["error_message"] == X.NO_TEXT
    assert results["raises"]["error_message"] == X.GAVE_UP % (3, "too slow") and results["prose"]["error_message"].startswith(X.GAVE_UP.split("%d")[0] + "3")
    assert {k: r["retry_count"] for k, r in results.items() if r["retry_count"]} == {"unread": 3, "null": 1, "raises": 2, "narrow": 7}
    fields = {(r["file_id"], r["key"]): r for r in got.fields.collect()}
    assert len(fields) == 3 * 4 and fields[1, "a"]["v_text"] == "v" and fields[1, "b"]["v_int"] == 3 and fields[1, "c"]["v_list"] == ["p", "q"]
    assert fields[9, "a"]["v_text"] == str(X.NARROWED)
    issues = sorted((r["file_id"], r["ord"], r["issue_type"], r["message"]) for r in got.issues.collect())
    assert [i[:3] for i in issues] == [(10, 0, "type_invalid"), (10, 1, "required_missing"), (10, 2, "required_missing"), (11, 1, "required_missing"), (11, 2, "required_missing")]
    assert issues[1][3] == X.EMPTY % "A" and issues[3][3] == X.NOT_FOUND % "A"
    assert {r["filename"]: r["issue_count"] for r in results.values() if r["issue_count"]} == {"blank": 3, "absent": 2}


def test_no_files(spark):
    got = run(spark, [])
    assert got.results.count() == got.fields.count() == got.issues.count() == 0


def test_prompt_text(spark):
    from pyspark.sql import functions as F

    lengths = [0, 1, 79_999, 80_000, 80_001, 200_000]
    df = spark.createDataFrame([(n, "".join(chr(97 + i % 26) for i in range(n))) for n in lengths], "n int, t string")
    for r in df.select("n", "t", X.prompt_text(F.col("t")).alias("p")).collect():
        n, text = r["n"], r["t"]
        parts, used, start = [], 0, 0
        while n > 80_000:
            chunk = text[start : start + 12_000]
            if used + len(chunk) > 80_000:
                parts.append(X.CUT_MARK % f"{n:,}")
                break
            parts.append(X.CHUNK_MARK % (len(parts) + 1) + chunk)
            used, start = used + len(chunk), start + 11_500
        assert r["p"] == (text if n <= 80_000 else "\n\n".join(parts))


def test_many_files_of_one_task_go_through_python_in_slices(spark):
    n = 2 * X.AT_ONCE + 3
    files = [(k, f"f{k}", "raise" if k % 10 == 0 else json.dumps({"a": str(k), "c": ["x"]}), "locked" if k % 7 == 0 else None, k % 3 or None) for k in range(n)]
    df = spark.createDataFrame(files, "file_id int, filename string, text string, read_error string, earlier_retries int").coalesce(1)
    template = spark.createDataFrame(TEMPLATE, "key string, name string, type string, required boolean, ord int")
    asked = X.answered(df, template, lambda prompt: json.dumps({"seen": prompt.split(X.OPEN, 1)[1][: -len(X.CLOSE)]}) if "raise" not in prompt.split(X.OPEN, 1)[1] else 1 / 0)
    assert "MapInArrow" in asked._jdf.queryExecution().executedPlan().toString()
    rows = {r["file_id"]: r for r in asked.collect()}
    assert len(rows) == n
    for k, name, text, locked, earlier in files:
        failed = locked or (X.GAVE_UP % (3, "division by zero") if k % 10 == 0 else None)
        r = rows[k]
        assert (r["filename"], r["text"], r["error_message"]) == (name, text, failed)
        assert r["raw_json"] == (None if failed else json.dumps({"seen": text}, ensure_ascii=False))
        assert r["retry_count"] == (earlier + 1 if earlier else 0) + (3 if failed and not locked and k % 10 == 0 else 0) or k % 10 == 0
