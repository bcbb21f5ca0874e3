"""What signing of lines gives, and where band keys are grouped."""

import random

from pyspark.sql import functions as F

from folioloom.llm import line_dedup as L


def test_values_are_the_nearest_hashes_in_integers(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab é中😀") for _ in range(n)) for n in (9, 10, 24, 25, 40, 300)] + ["short"]
    lines = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "h long, line string")
    got = {r["h"]: [r[f"m{j}"] for j in range(L.HASHES)] for r in L._signed(lines).collect()}
    hashes = {r["h"]: r["s"] for r in lines.where("line <> 'short'").select("h", L._hashed(F.col("line")).alias("s")).collect()}
    want = {h: [min((x % (1 << 64) >> 32) ^ (j << 28) for x in s) - (1 << 31) for j in range(L.HASHES)] for h, s in hashes.items()}
    assert got == want and len(want) == 6
    plan = L._signed(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "shiftrightunsigned" not in plan  # its longs cost more


def test_band_keys_are_grouped_once_they_are_dealt(spark, monkeypatch):
    plans = {}
    settle = L.settle
    monkeypatch.setattr(L, "settle", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().sparkPlan().toString()), settle(df, name))[1])
    docs = spark.createDataFrame([(k, "one line of some length\nand the line " + "abcdefgh"[k % 8] * 30) for k in range(20)], "doc_id long, text string")
    assert L.line_dedup_report(docs).where("n_removed > 0").count() == 19
    steps = [x.strip(" +-:") for x in plans["line-shared"].splitlines()]
    first, dealt = max(k for k, x in enumerate(steps) if "partial_bit_xor" in x), next(k for k, x in enumerate(steps) if "REPARTITION_BY_COL" in x)
    assert first < dealt and "min(key" not in " ".join(steps[first + 1 :])  # read from the last step to the first
