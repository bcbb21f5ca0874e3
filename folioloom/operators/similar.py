"""Similar pairs of short texts by sequence ratio."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of a block, and pairs whose common subsequences are measured at a time.
BLOCK, AT_ONCE = 2000, 1 << 18
BUCKETS = 256


def _coded(texts: list[str]) -> np.ndarray:
    """Code points of texts of one length, a row each."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), -1)


def _counts(codes: np.ndarray) -> np.ndarray:
    """A row a text: how many of its characters, numbered by occurrence, are in each bucket. Products of rows are common characters, or more."""
    letters = np.sort(codes, axis=1).astype(np.int64)
    place = np.broadcast_to(np.arange(letters.shape[1]), letters.shape)
    first = np.maximum.accumulate(np.where(np.diff(letters, axis=1, prepend=-1) != 0, place, 0), axis=1)
    bucket = (letters * 7 + (place - first) * 101) % BUCKETS
    rows = np.arange(len(codes))[:, None] * BUCKETS
    return np.bincount((rows + bucket).ravel(), minlength=len(codes) * BUCKETS).reshape(-1, BUCKETS).astype(np.float32)


def _in_common(masks: np.ndarray, n: int, others: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of rows a and b the length of the longest common subsequence, or more; texts of a have ``n`` characters, 63 at most."""
    full = np.uint64((1 << n) - 1)
    v = np.full(len(a), full)
    for c in range(others.shape[1]):
        u = v & masks[a, others[b, c]]
        v = ((v + u) | (v - u)) & full
    return n - np.bitwise_count(v)


def block_pairs(xs: list[str], ys: list[str], least: float) -> Iterator[tuple[str, str, float]]:
    """(x, y, ratio) with ``least`` or more; the texts of a side have one length.

    The ratio is twice the matched characters over all. The matched ones are common, and a common subsequence: pairs without enough of
    them are ruled out a block at a time, and only what is left goes to the sequence matcher.
    """
    a_codes, b_codes = _coded(xs), _coded(ys)
    n, m = a_codes.shape[1], b_codes.shape[1]
    enough = least * (n + m) / 2 - 1e-6
    at_a, at_b = np.nonzero((_counts(b_codes) @ _counts(a_codes).T >= enough).T)
    if n <= 63:
        masks, small = np.zeros((len(xs), BUCKETS), np.uint64), (b_codes % BUCKETS).astype(np.int64)
        for c in range(n):
            masks[np.arange(len(xs)), a_codes[:, c] % BUCKETS] |= np.uint64(1 << c)
        parts = np.split(np.arange(len(at_a)), range(AT_ONCE, len(at_a), AT_ONCE))
        stays = np.concatenate([_in_common(masks, n, small, at_a[p], at_b[p]) for p in parts]) >= enough
        at_a, at_b = at_a[stays], at_b[stays]
    order = np.argsort(at_b, kind="stable")
    matcher, last = SequenceMatcher(None, "", ""), -1
    for k, j in zip(at_a[order].tolist(), at_b[order].tolist(), strict=True):
        if j != last:
            matcher.set_seq2(ys[j])
            last = j
        matcher.set_seq1(xs[k])
        if (ratio := matcher.ratio()) >= least:
            yield xs[k], ys[j], ratio


def similar_pairs(texts: DataFrame, others: DataFrame, least: float) -> DataFrame:
    """(a, b, ratio) of all pairs of ``texts`` (a) and ``others`` (b), each distinct and not empty, whose ratio is ``least`` or more.

    Texts are dealt into blocks of one length; blocks whose lengths allow the ratio meet, a pair of blocks a row, spread over all tasks.
    Memory goes with a block; the work goes with the square of the distinct texts, at some nanoseconds a pair.
    """

    def blocks(side: DataFrame, name: str) -> DataFrame:
        words = side.select(F.col(name).alias("text")).where("text <> ''").distinct().withColumn("n", F.length("text"))
        counts = words.groupBy("n").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
        dealt = words.join(counts, "n").withColumn("part", F.pmod(F.xxhash64("text"), F.col("parts")))
        return dealt.groupBy("n", "part").agg(F.collect_list("text").alias(f"{name}s")).withColumnRenamed("part", f"{name}_part")

    def compare(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in rows:
            for xs, ys in zip(some["as"], some["bs"], strict=True):
                yield pd.DataFrame(block_pairs(list(xs), list(ys), least), columns=["a", "b", "ratio"])

    lengths = F.sequence(F.ceil(F.col("n") * least / (2 - least) - 1e-6), F.floor(F.col("n") * (2 - least) / least + 1e-6))
    met = blocks(texts, "a").withColumn("m", F.explode(lengths)).join(blocks(others, "b").withColumnRenamed("n", "m"), "m")
    tasks = 8 * texts.sparkSession.sparkContext.defaultParallelism
    return met.repartition(tasks, "n", "a_part", "m", "b_part").select("as", "bs").mapInPandas(compare, "a string, b string, ratio double")
