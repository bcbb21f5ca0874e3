"""The title rungs by one pass over the documents, against plain comparison of all pairs."""

import random
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioloom.functions import text as T
from folioloom.operators import matching as M
from folioloom.operators.ladder import Alike, rungs


def edited(rng, text, alphabet, share):
    return "".join(c if rng.random() > share else rng.choice(["", rng.choice(alphabet), c + rng.choice(alphabet)]) for c in text)


@pytest.mark.parametrize("alphabet, lengths", [("abc", (1, 30)), ("etaoinshrdlucmfwypvbgkjqxz", (150, 420)), ("eeeeeeetttttaaaaooooiinnzqxjk😀中", (180, 260))])
def test_alike_finds_what_the_matcher_finds(alphabet, lengths):
    rng = random.Random(11)
    titles = ["".join(rng.choice(alphabet) for _ in range(rng.randint(*lengths))) for _ in range(25)]
    texts = [edited(rng, t, alphabet, share) for t in titles for share in (0.03, 0.12, 0.2, 0.3)] + ["x", "", *titles[:3]]
    alike = Alike(titles, 0.8)
    want = {(k, x): r for x in texts if x for k, t in enumerate(titles) if (r := SequenceMatcher(None, t, x).ratio()) >= 0.8}
    assert {(k, x): r for x in texts for k, r in alike.found(x)} == want
    assert len(want) > 10


def brute(agenda, texts):
    out = set()
    for item, title, tokens in agenda:
        for key, text in texts:
            if title in text or text in title:
                out.add((item, key, 0.90, "title_contains"))
            if (r := SequenceMatcher(None, title, text).ratio()) >= 0.8:
                out.add((item, key, 0.88 if r >= 0.9 else 0.75, "title_similarity"))
            if n := sum(t in text for t in tokens):
                out.add((item, key, min(0.6 * n / len(tokens), 0.6), "keyword"))
    return out


def test_rungs_equal_all_pairs(monkeypatch):
    from folioloom.operators import ladder

    monkeypatch.setattr(ladder, "AT_ONCE", 60)  # many parts, texts longer than one
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab\0é") for _ in range(rng.randint(1, n)))
    agenda = [(k, t, [w for w in t.split(",") if len(w) >= 2]) for k in range(40) if (t := ",".join(word(11) for _ in range(rng.randint(1, 3))))]
    agenda.append((99, agenda[0][1], agenda[0][2]))
    texts = [(k, ",".join(word(12) for _ in range(rng.randint(1, 9)))) for k in range(200)] + [(900 + k, t) for k, (_, t, _) in enumerate(agenda[:5])]
    got = [tuple(r) for b in rungs(agenda, 0.8)(iter([pd.DataFrame(texts, columns=["file_id", "dt"])])) for r in b.itertuples(index=False)]
    assert len(got) == len(set(got)) and set(got) == brute(agenda, texts)
    assert {m for *_, m in got} == {"title_contains", "title_similarity", "keyword"}


def test_large_agendas_give_the_same_and_no_plan_pairs_all_with_all(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 10)))
    i = spark.createDataFrame([(f"i{k}", ",".join(word() for _ in range(rng.randint(1, 3)))) for k in range(30)], "item_id string, title string")
    d = spark.createDataFrame([(k, ";".join(word() for _ in range(rng.randint(1, 5)))) for k in range(120)] + [(200, "")], "file_id long, doc_title string")
    i, d = i.withColumn("nt", T.normalise_title(F.col("title"))), d.withColumn("nt", T.normalise_title(F.col("doc_title")))
    shown = lambda p: sorted((r["item_id"], r["file_id"], round(r["score"], 12), r["method"]) for r in M.best_rung(p).collect())
    pairs = M.title_pairs(i, d, similarity=True)
    few = shown(pairs)
    monkeypatch.setattr(M, "BROADCAST_CHARS", -1)
    many = M.title_pairs(i, d, similarity=True)
    assert shown(many) == few and {r[3] for r in few} >= {"title_contains", "keyword"}
    for p in (pairs, many):
        plan = p._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_block_finds_each_title_s_common_subsequence():
    from folioloom.operators.ladder import Block

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [max(row[k], new) if x != y else row[k - 1] + 1 for k, (y, new) in enumerate(zip(b, _seen(row, x, b), strict=True), 1)]
        return row[-1]

    def _seen(row, x, b):  # the new row's own values, from the left
        left, out = 0, []
        for k, y in enumerate(b, 1):
            out.append(left)
            left = row[k - 1] + 1 if x == y else max(row[k], left)
        return out

    rng = random.Random(4)
    titles = ["".join(rng.choice("abcé😀") for _ in range(rng.randint(1, 70))) for _ in range(12)] + ["b" * 64, "a"]
    block = Block(titles)
    for text in ["", "b" * 80, "zzz", *titles[:4], "".join(rng.choice("abcéx") for _ in range(90))]:
        assert block.in_common(text, list(range(len(titles)))) == [plain(t, text) for t in titles]


def test_plain_title_is_the_column_s(spark):
    rng = random.Random(6)
    parts = [".pdf", ".PDF", ".docx", ".xlſx", "\n", "\r\n", "\r", "\x85", " ", "\x1c", "　", " ", "。", ".", "《", "]", "’", "ﬁ", "Ａ", "①", "材料", "发言稿", "报告材料", "汇报稿", "é", "é", "😀", "x"]
    texts = [None, "", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(3000))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", T.normalise_title(F.col("t")).alias("folded"), T.normalise_title_native(F.col("t")).alias("native")).collect():
        assert (T.plain_title(row["t"], True), T.plain_title(row["t"], False)) == (row["folded"], row["native"]), row["t"]


def test_documents_titles_are_normalised_in_the_pass(spark):
    items = spark.createDataFrame([(1, "《Annual report》材料", "")], "item_id int, title string, code string").withColumn("nt", T.normalise_title(F.col("title")))
    docs = spark.createDataFrame([(7, "x Ａnnual report y.pdf"), (8, "Annual repost"), (9, None)], "file_id int, doc_title string")
    pairs = M.title_pairs(items, docs, similarity=True)
    assert sorted((r["file_id"], r["score"], r["method"]) for r in M.best_rung(pairs).collect()) == [(7, 0.90, "title_contains"), (8, 0.88, "title_similarity")]
    assert "ArrowEvalPython" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_strings_are_found_by_their_bytes(monkeypatch):
    from folioloom.operators.ladder import Strings

    rng = random.Random(12)
    word = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(rng.randint(1, n)))
    for alphabet in ("ab", "ab\0é中😀\ud800", "abcdefgh"):
        strings = list(dict.fromkeys(word(alphabet, n) for n in (2, 3, 5, 8, 12, 20) for _ in range(60)))
        texts = ["", "a", *(word(alphabet, 60) for _ in range(150)), *("x" + s for s in strings[:40])]
        for some in (texts, texts[:1], ["a" * 5000, "b"]):  # the last has more places than may be looked at one by one
            found = Strings(strings).found(some)
            assert [sorted(f) for f in found] == [[k for k, s in enumerate(strings) if s in t] for t in some]
    many = ["aaaaaaaa" + word("bc", 12) for _ in range(300)]
    found = Strings(many).found(["a" * 3000 + many[7], "aaaaaaaab"])
    assert [sorted(f) for f in found] == [[k for k, s in enumerate(many) if s in t] for t in ("a" * 3000 + many[7], "aaaaaaaab")]


def test_documents_are_read_once_and_ranks_cut_before_the_shuffle(spark, tmp_path):
    items = spark.createDataFrame([(k, "", t) for k, t in enumerate(["()", "ab", "cd ef"])], "item_id int, code string, title string")
    spark.createDataFrame([(k, k, "", t, "") for k, t in enumerate(["()", "ab", "xabx", "cd ef", "cdef", "abx"])], "file_id int, pos int, filename string, extracted_title string, extracted_code string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    i, d = M.prepared(items, "title", "code"), M.prepared(docs.withColumn("doc_title", F.col("extracted_title")), "doc_title", "extracted_code").drop("nt")
    pairs = M.title_pairs(i, d, similarity=True)
    assert pairs._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    exact = sorted((r["item_id"], r["file_id"]) for r in pairs.where("method = 'title_exact'").collect())
    assert exact == [(0, 0), (1, 1), (2, 3)]
    best = M.ranked(M.match_scores(items, docs), docs, 2)
    assert "WindowGroupLimit" in best._jdf.queryExecution().executedPlan().toString()
    shown = sorted((r["item_id"], r["rnk"], r["file_id"], r["next_score"]) for r in best.collect())
    assert shown == [(0, 1, 0, 0.0), (1, 1, 1, 0.90), (1, 2, 2, 0.90), (2, 1, 3, 0.90), (2, 2, 4, 0.0)]
