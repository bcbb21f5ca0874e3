"""Scores that bring their documents' places along, and those that can't."""

import pytest

from folioloom.operators import matching as M

ITEM = "item_id int, order_no int, title string, code string"
DOC = "file_id int, pos int, filename string, extracted_title string, extracted_code string"
ROWS = [(7, 3, "a.pdf", "xabcdx", None), (8, 1, "b.pdf", "abcd", None), (9, 2, "c.pdf", "abcd, efgh", None), (10, 0, "d.pdf", "efgh abcz", None)]


def _best(spark, rows):
    items = spark.createDataFrame([(1, 1, "abcd", None), (2, 2, "abcd, efgh", None), (2, 3, "efgh, zz", None)], ITEM)
    docs = spark.createDataFrame(rows, DOC)
    scores = M.match_scores(items, docs)
    return scores, M.ranked(scores, docs, 3), docs


def test_no_pair_is_shuffled_and_none_is_there_twice(spark):
    scores, best, docs = _best(spark, ROWS)
    assert "pos" in scores.columns and scores.count() == scores.select("item_id", "file_id").distinct().count()
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    joined = M.ranked(scores.drop("pos"), docs, 3)
    shown = lambda d: sorted((r["item_id"], r["rnk"], r["file_id"], r["score"], r["method"], r["next_score"]) for r in d.collect())
    assert shown(best) == shown(joined) and [r[2] for r in shown(best) if r[0] == 1] == [8, 9, 7]


@pytest.mark.parametrize("more", [(8, 1, "b.pdf", "abcd, efgh", None), (11, 9, "e.pdf", "q", "")])
def test_highest_rung_of_a_pair(spark, more):
    """A file_id twice is one document, with the highest rung of both."""
    scores, _, _ = _best(spark, [*ROWS, more])
    got = {(r["item_id"], r["file_id"]): (r["score"], r["method"]) for r in scores.collect()}
    assert scores.count() == len(got)
    assert got[1, 8] == (0.95, "title_exact") and got[2, 8] == ((0.95, "title_exact") if more[0] == 8 else (0.90, "title_contains"))


def test_report_with_a_document_for_two_items_and_none(spark):
    items = spark.createDataFrame([(1, 1, "abcd", None), (2, None, "zz", None), (3, 2, "abcd", None)], ITEM)
    docs = spark.createDataFrame(ROWS, DOC)
    matches = spark.createDataFrame([(1, 1, 8), (2, None, None), (3, 2, 8)], "item_id int, order_no int, selected_file_id int")
    got = sorted((r["order_key"], r["filename"]) for r in M.report(matches, items, docs).collect())
    assert got == [(1, "b.pdf"), (2, "b.pdf"), (999999, "")]
