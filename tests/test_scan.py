"""Two-pass scans and outlines on their edges."""

from pyspark.sql import functions as F

from folioloom.operators import scan
from folioloom.operators.console import outline

PAGES, WORDS = "file_id int, page_num int, native string", "file_id int, page_num int, mode int, seq int, word string, conf string"


def test_two_pass(spark):
    full = "x" * 50
    pages = spark.createDataFrame([(1, 1, full), (1, 2, "short"), (1, 3, None), (1, 4, "sixteen letters!"), (2, 1, ""), (2, 2, "a"), (3, 1, "tie")], PAGES)
    words = [(1, 1, 6, 0, "never looked at" * 9, "99"), (1, 2, 6, 1, "second", "30"), (1, 2, 6, 0, "first", "90"), (1, 2, 6, 2, "unsure", "29"), (1, 2, 6, 3, "point", "88.5"), (1, 2, 6, 4, " ", "99"), (1, 2, 6, 5, "none", None),
             (1, 2, 4, 0, "another mode that isn't in the preset", "99"), (1, 4, 6, 0, "just sixteen +1", "99"), (2, 1, 6, 0, "broken page", "99"), (2, 2, 6, 0, "ab", "-1"), (2, 2, 3, 0, "abc", "50"),
             (3, 1, 6, 0, "equal six", "60"), (3, 1, 3, 0, "three iii", "70")]
    errors = spark.createDataFrame([(2, 1, "no image"), (1, 1, "not needed")], "file_id int, page_num int, error string")
    got = scan.two_pass(pages, spark.createDataFrame(words, WORDS), "mixed", errors)
    rows = {(r["file_id"], r["page_num"]): (r["text"], r["used_ocr"], r["ocr_confidence"], r["ocr_mode"], r["ocr_error"]) for r in got.collect()}
    assert rows == {
        (1, 1): (full, False, None, None, None), (1, 2): ("first second", True, 60.0, 6, None), (1, 3): ("", False, None, None, None), (1, 4): ("sixteen letters!", False, None, None, None),
        (2, 1): ("", False, None, None, "no image"), (2, 2): ("abc", True, 50.0, 3, None), (3, 1): ("three iii", True, 70.0, 3, None),
    }
    files = {r["file_id"]: (r["pages"], r["ocr_pages"], r["mean_confidence"], r["ocr_errors"]) for r in scan.scanned_files(got).collect()}
    assert files == {1: (4, 1, 60.0, []), 2: (2, 1, 50.0, ["page 1: no image"]), 3: (1, 1, 70.0, [])}
    off = scan.two_pass(pages, spark.createDataFrame(words, WORDS), "off", errors, max_pages=1)
    assert sorted((r["file_id"], r["text"], r["used_ocr"], r["ocr_error"]) for r in off.collect()) == [(1, full, False, None), (2, "", False, None), (3, "tie", False, None)]


def test_outline(spark):
    texts = ["", "One. Two? 三。", "- a: b\n* c\n3) d：e：f\nnot one", "1. x\r\n2.y\n• : z", "...", "-none\n1 none"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = [[tuple(p) for p in r["o"]] for r in df.select("k", outline(F.col("t")).alias("o")).orderBy("k").collect()]
    assert got == [[], [("1", "One"), ("2", "Two"), ("3", "三")], [("a", "b"), ("2", "c"), ("d", "e：f")], [("1", "x"), ("", "z")], [], [("1", "-none\n1 none")]]


def nested(pages, words, errors):
    """Pages that bring their words and errors."""
    lists = words.groupBy("file_id", "page_num", "mode").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "word", "conf"))), lambda x: F.struct(x["word"].alias("word"), x["conf"].alias("conf"))).alias("words"))
    reads = lists.groupBy("file_id", "page_num").agg(F.collect_list(F.struct("mode", "words")).alias("reads"))
    return pages.join(reads, ["file_id", "page_num"], "left").join(errors, ["file_id", "page_num"], "left")


def test_pages_that_bring_their_words_need_no_shuffle(spark, tmp_path):
    import random

    rng = random.Random(2)
    keys = [(f, p) for f in range(12) for p in range(1, 6)]
    word = lambda: rng.choice(["", " ", "ab", "中", "x-", None, "longer"])
    pages = spark.createDataFrame([(*k, rng.choice([None, "", "short", "x" * 49, "x" * 50, "中 文"])) for k in keys], PAGES)
    words = spark.createDataFrame([(*k, m, i, word(), rng.choice(["29", "30", "99", "--5", "-1", "88.5", None])) for k in keys for m in (3, 6, 11) for i in range(rng.choice([0, 3, 9]))], WORDS)
    errors = spark.createDataFrame([(*k, "no image") for k in keys if rng.random() < 0.2], "file_id int, page_num int, error string")
    nested(pages, words, errors).write.parquet(f"{tmp_path}/pages")
    brought = spark.read.parquet(f"{tmp_path}/pages")
    for preset in ("mixed", "photo", "default", "off"):
        flat, got = scan.two_pass(pages, words, preset, errors), scan.two_pass(brought, preset=preset)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, flat.collect()))
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_cleaning_rejoins_before_hyphens_with_one_python_step(spark):
    from folioloom.functions import text as T

    texts = [None, "", "a b", "中 文 字 a-\nb", "a 中 文", "soft-\nware é", "中\n文", "ﬁ-\nx　y"] + [f"{k} é 中 文" for k in range(300)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").coalesce(1)
    cleaned = df.select("k", T.clean_text(F.col("t")).alias("c"))
    got = {r["k"]: r["c"] for r in cleaned.collect()}
    assert [got[k] for k in range(8)] == ["", "", "a b", "中文 字 a-\nb", "a 中 文", "software é", "中文", "fi-\nx　y"]
    assert all(got[8 + k] == f"{k} é 中文" for k in range(300))
    assert cleaned._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_fixes_are_those_of_the_plain_patterns(spark):
    import random

    from folioloom.functions import text as T

    rng = random.Random(7)
    texts = ["".join(rng.choice(["A", "0", "O", "l", "1", "٣", " ", "-\n", "\n", "é", "中", "x"]) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    fixed, joined = F.col("t"), F.regexp_replace("t", r"(?U)([\p{L}\p{N}_]+)-\n([\p{L}\p{N}_]+)", "$1$2")
    for pattern, new in ((r"(?<=[A-Z])0(?=[A-Z])", "O"), (r"(?<=\p{Nd})O(?=\p{Nd})", "0"), (r"(?<=\p{Nd})l(?=\p{Nd})", "1"), (r"(?U)\bl\b", "1")):
        fixed = F.regexp_replace(fixed, pattern, new)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    pairs = df.select(T.ocr_fixes(F.col("t")), fixed, T.dehyphenate(F.col("t")), F.when(T.has_cjk(F.col("t")), F.col("t")).otherwise(joined)).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in pairs) and any(r[1] != t for r, t in zip(pairs, texts, strict=True))
    texts = ["".join(rng.choice([*T.SPACES, "x", "é"]) for _ in range(rng.randint(0, 6))) for _ in range(3000)] + ["x" + c for c in T.SPACES]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    tidy = F.regexp_replace("t", r"\n{3,}", "\n\n")
    for pattern, new in ((r"\r\n?|[\x{85}\x{2028}\x{2029}]", "\n"), (r"\n\z", ""), (r"(?m)[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}&&[^\n]]+$", "")):
        tidy = F.regexp_replace(tidy, pattern, new)
    for t, stripped, got, want in df.select("t", T.strip(F.col("t")), T.tidy_lines(F.col("t")), tidy).collect():
        assert stripped == t.strip() and got == want, t
