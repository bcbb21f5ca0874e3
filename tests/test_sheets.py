"""Similar pairs, leader clustering and folder merges against loops over everything; agenda sheets on their edges."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from folioloom.functions.text import normalise_header
from folioloom.operators import agenda, folder_merge
from folioloom.operators.merge import GROUPS
from folioloom.operators.similar import similar_pairs

HEADS = "sheet int, col int, header string"


def ratio(a, b):
    return 0.0 if not a or not b else 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


def word(rng):
    return "".join(rng.choice("abcde") for _ in range(rng.randint(1, 7)))


@pytest.mark.parametrize("least", [0.6, 0.75, 0.9])
def test_similar_pairs_finds_all(spark, least):
    rng = random.Random(4)
    a, b = ({word(rng) for _ in range(70)} | {"aaaa", "é b", "a b c"} for _ in range(2))
    frame = lambda name, words: spark.createDataFrame([(w,) for w in words], f"{name} string")
    got = {(r["a"], r["b"]): r["ratio"] for r in similar_pairs(frame("a", a), frame("b", b), least).collect()}
    assert got == {(x, y): ratio(x, y) for x in a for y in b if ratio(x, y) >= least}


def keys_of(spark, heads):
    words = sorted({h for _, _, h in heads if h} | {w for g in GROUPS for w in g})
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", normalise_header(F.col("w")).alias("k"))
    return {r["w"]: r["k"] for r in df.collect()}


def looped(spark, heads):
    """One header after the other, each against all leaders so far; then each header against all leaders."""
    keys = keys_of(spark, heads)
    unified = {keys[w]: g[0] for g in GROUPS for w in g}
    group = {keys[w]: k for k, g in enumerate(GROUPS) for w in g}
    led = []
    for _, _, h in sorted(heads):
        if h and keys[h]:
            shown = unified.get(keys[h], h)
            key = keys[shown]
            if all(ratio(key, k) < 0.75 for k, _ in led):
                led.append((key, shown))
    targets = {}
    for sheet, col, h in heads:
        key = keys.get(h, "")
        alike = [n for k, n in led if key in group and group.get(k) == group[key]] + [n for k, n in led if k == key and key]
        best = max(led, key=lambda x: ratio(key, x[0]), default=(None, None))
        targets[sheet, col] = alike[0] if alike else best[1] if best[0] and ratio(key, best[0]) >= 0.6 else h
    return led, targets


def test_leaders_against_the_loop(spark):
    rng = random.Random(5)
    known = [w for g in GROUPS for w in g]
    heads = [(s, c, rng.choice(known) if rng.random() < 0.2 else rng.choice(["", " ", None, "!!"]) if rng.random() < 0.1 else rng.choice([word(rng), word(rng).upper() + " " + word(rng), word(rng) + "_1"]))
             for s in range(60) for c in range(5)]
    heads = [(s, c, h) for s, c, h in heads if h is not None]
    df = spark.createDataFrame(heads, HEADS)
    found = folder_merge.leaders(df)
    led, targets = looped(spark, heads)
    assert [(r["key"], r["name"]) for r in found.orderBy("at").collect()] == led
    assert {(r["sheet"], r["col"]): r["target"] for r in folder_merge.mapping(df, found).collect()} == targets
    assert folder_merge.leaders(spark.createDataFrame([], HEADS)).count() == 0


def test_mergeable(spark):
    files = spark.createDataFrame([(f,) for f in ("b.xlsx", "A.XLSX", "~$b.xlsx", "c.xls", folder_merge.OUTPUT)], "filename string")
    assert sorted(r["filename"] for r in folder_merge.mergeable(files).collect()) == ["A.XLSX", "b.xlsx"]


CELLS = "sheet string, row int, col int, value string"


def cells_of(spark, sheets, first=0):
    return spark.createDataFrame([(s, r, c, v) for s, rows in sheets.items() for r, row in enumerate(rows, first) for c, v in enumerate(row, first) if v is not None], CELLS)


def test_merge_folder_small(spark):
    sheets = {
        "b.xlsx": [["id", "name", "name", "city"], ["1", " x ", "y", "NA"], [None, "lost", "lost", "lost"], ["2", "N/A", None, "c"]],
        "a.xlsx": [["序号", "city", "zip", None, "Unnamed: 4"], ["序号", "city", "zip"], ["7", "d", None, "?"], ["8", None, None, "?"]],
        "empty.xlsx": [["p", "q", "r"], [None, None, None]],
    }
    cells, columns = folder_merge.merge_folder(cells_of(spark, sheets))
    assert [r["name"] for r in columns.orderBy("place").collect()] == ["city", "zip", "id", "name", "name.1"]
    got = [tuple(r) for r in folder_merge.wide(cells, columns).orderBy(folder_merge.NUMBER).collect()]
    assert got == [(1, "d", "", "", "", ""), (2, "", "", "1", "x", "y"), (3, "c", "", "2", "", "")]


def test_agenda_sheets_small(spark):
    sheets = {
        "plain": [["序号", "时间", "标题"], ["1", "9:00", "a"], ["1.0", None, "b"], ["x", None, "c"], ["2", None, " "]],
        "below": [["议程"], [None], ["时间", "发言标题", "顺序"], ["9", "t", "3"]],
        "bare": [["1", "9", "first", "north"], ["2", None, "second", None]],
        "lost": [["甲", "乙"], ["1", "2"]],
    }
    rows, found = agenda.read_sheets(cells_of(spark, sheets, 1))
    got = {(r["sheet"], r["source_row"]): (r["order_no"], r["title"], r["time_range"], r["region"], r["status"]) for r in rows.collect()}
    assert got == {
        ("plain", 2): (1, "a", "9:00", None, "item"), ("plain", 3): (1, "b", None, None, "duplicate"), ("plain", 4): (None, "c", None, None, "skipped"), ("plain", 5): (2, None, None, None, "missing_identity"),
        ("below", 4): (3, "t", "9", None, "item"), ("bare", 1): (1, "first", "9", "north", "item"), ("bare", 2): (2, "second", None, None, "item"), ("lost", 2): (None, None, None, None, "skipped"),
    }
    assert {r["sheet"]: (r["headerless"], r["skipped"], r["error"]) for r in found.collect()} == {
        "plain": (False, 1, None), "below": (False, 0, None), "bare": (True, 0, None), "lost": (False, 1, agenda.NO_ORDER)}
    assert {r["sheet"]: r["header_row"] for r in found.collect()}["below"] == 3
