"""Similar pairs by blocks, and the mapping that looks for far ones only where there is no near one."""

import random
from difflib import SequenceMatcher

from folioloom.operators import folder_merge as M
from folioloom.operators import similar as S


def test_blocks_give_the_matchers_pairs(monkeypatch):
    monkeypatch.setattr(S, "AT_ONCE", 50)
    rng = random.Random(1)
    for case in range(60):
        n, m = (rng.randint(1, 9), rng.randint(1, 9)) if case % 6 else (rng.randint(60, 80), rng.randint(60, 80))  # also beyond 63 characters
        word = lambda k: "".join(rng.choice("aabcé中😀") for _ in range(k))
        xs, ys, least = list({word(n) for _ in range(25)}), list({word(m) for _ in range(25)}), rng.choice([0.5, 0.6, 0.75])
        want = {(x, y, r) for x in xs for y in ys if (r := SequenceMatcher(None, x, y).ratio()) >= least}
        got = list(S.block_pairs(xs, ys, least))
        assert len(got) == len(want) and set(got) == want


def test_many_blocks_and_far_mappings(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 7)
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 8))) for _ in range(120)})
    heads = spark.createDataFrame([(1, k, w) for k, w in enumerate(words)], "sheet int, col int, header string")
    names = words[:6] + ["zz"]
    canonical = spark.createDataFrame([(w, w.upper(), (0, k)) for k, w in enumerate(names)], "key string, name string, at struct<sheet: int, col: int>")

    def target(w):
        ratio, k = max((SequenceMatcher(None, w, c).ratio(), -k) for k, c in enumerate(names))
        return w.upper() if w in names else names[-k].upper() if ratio >= 0.6 else w

    got = {r["header"]: r["target"] for r in M.mapping(heads, canonical).collect()}
    assert got == {w: target(w) for w in words}
    assert any(t != w and t != w.upper() for w, t in got.items())
