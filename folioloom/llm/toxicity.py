"""Toxicity scores by non-negative positive-unlabelled learning."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, text_rows
from .pieces import Memo

WORDS = re.compile(r"\w+")
#: Bounds of the two samples that are fitted: confirmed toxic rows, and rows taken as unlabelled.
MAX_TOXIC, MAX_UNLABELLED = 8_000, 16_000
#: A feature must occur in so many toxic rows of the sample, and there more often than in the unlabelled ones by so
#: many standard errors; of those the most significant are taken.
LEAST_DF, LEAST_Z, MAX_FEATURES = 4, 4.0, 5_000
#: Lengths of the beginnings of words that are features besides the words.
PREFIXES = (4, 5, 6, 7)
FOLDS = 5
EPOCHS, BATCHES, RATE, DECAY = 40, 16, 0.05, 2e-4
SEEDS = (1, 2, 3)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; rows of fold 0 are held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def features(word: str) -> list[int]:
    """Ids of a word and of its beginnings of some lengths."""
    parts = [word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]
    return [x - (1 << 63) for x in map(xxhash.xxh64_intdigest, parts)]


def _feature_lists(keep: frozenset[int] | None):
    """Distinct features of each text, those in ``keep`` only, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(lambda w: [x for x in features(w) if keep is None or x in keep], 50_000)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = [sorted(set(chain.from_iterable(map(memo.__getitem__, set(WORDS.findall(t.lower())))))) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lists, pa.list_(pa.int64()))], names=["toxic", "features"])

    return run


_LISTS = "toxic int, features array<long>"


class Model:
    """Linear classifiers over the presence of features; the logistic of their mean logit is the score."""

    def __init__(self, known: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.bias = float(bias.mean())
        self.weights = dict(zip(known.tolist(), weights.mean(0).tolist(), strict=True))

    def scorer(self) -> Callable[[str], float]:
        """A function of a text, with a memo of the known features of each word."""
        weights, bias = self.weights, self.bias
        memo = Memo(lambda w: tuple(x for x in features(w) if x in weights))

        def score(text: str) -> float:
            found = set(chain.from_iterable(filter(None, map(memo.__getitem__, set(WORDS.findall(text.lower()))))))
            logit = bias + sum(weights[x] for x in sorted(found))
            return 1 / (1 + math.exp(-min(30.0, max(-30.0, logit))))

        return score


class _Rows:
    """Word presence of some documents as a compressed sparse matrix."""

    def __init__(self, lists: list[np.ndarray], vocabulary: np.ndarray):
        at = [np.searchsorted(vocabulary, w) for w in lists]
        at = [a[(a < len(vocabulary)) & (vocabulary[np.minimum(a, len(vocabulary) - 1)] == w)] for a, w in zip(at, lists, strict=True)]
        self.starts = np.cumsum([0, *map(len, at)])
        self.columns = np.concatenate([*at, np.empty(0, np.int64)]).astype(np.int64)

    def some(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns and the position in ``rows`` of each entry."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        at = np.repeat(self.starts[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return self.columns[at], np.repeat(np.arange(len(rows)), sizes)


def nnpu_fit(toxic: _Rows, n_toxic: int, mixed: _Rows, n_mixed: int, width: int, prior: float, seed: int) -> tuple[np.ndarray, float]:
    """Minimise prior * R+(P) + max(0, R-(U) - prior * R-(P)) with the logistic loss, by Adam on mini-batches.

    Where the estimated risk of the negatives is below zero, the step goes up its gradient instead, which keeps the
    classifier from fitting the unlabelled rows as negatives one by one.
    """
    rng = np.random.default_rng(seed)
    w, b = np.zeros(width), 0.0
    m, v, mb, vb, t = np.zeros(width), np.zeros(width), 0.0, 0.0, 0
    for _ in range(EPOCHS):
        p_parts = np.array_split(rng.permutation(n_toxic), BATCHES)
        u_parts = np.array_split(rng.permutation(n_mixed), BATCHES)
        for p, u in zip(p_parts, u_parts, strict=True):
            if not len(p) or not len(u):
                continue
            (pc, pr), (uc, ur) = toxic.some(p), mixed.some(u)
            logits = b + np.bincount(pr, w[pc], len(p))
            ps = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            us = 1 / (1 + np.exp(-np.clip(b + np.bincount(ur, w[uc], len(u)), -30, 30)))
            # softplus(z) is the loss of a negative with logit z; that of a positive is less by z
            negative = np.logaddexp(0, b + np.bincount(ur, w[uc], len(u))).mean() - prior * np.logaddexp(0, logits).mean()
            if negative >= 0:
                gp, gu = np.full(len(p), -prior / len(p)), us / len(u)
            else:
                gp, gu = prior * ps / len(p), -us / len(u)
            g = np.bincount(pc, gp[pr], width) + np.bincount(uc, gu[ur], width) + DECAY * w
            gb = gp.sum() + gu.sum()
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            fix = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            w -= RATE * fix * m / (np.sqrt(v) + 1e-8)
            b -= RATE * fix * mb / (np.sqrt(vb) + 1e-8)
    return w, b


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most MAX_TOXIC confirmed toxic rows and MAX_UNLABELLED rows whose labels aren't looked at.

    Only rows whose fold isn't 0 are used. Both samples are the rows with the least hashes of their ids, so the same
    rows are drawn whatever the partitioning. The class prior is the share of toxic rows among the labelled ones of
    those folds. Without a toxic row, the model gives every text a score of 0.
    """
    known = labels.select(labels[id_col].alias("doc_id"), labels[label_col].alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold(F.col("doc_id")) != 0)
    counts = known.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("toxic")).first()
    if not counts["toxic"]:
        return Model(np.empty(0, np.int64), np.zeros((1, 0)), np.array([-30.0]))
    prior = min(0.95, counts["toxic"] / counts["n"])
    rows = text_rows(docs, id_col, text_col).where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    draw = F.xxhash64("doc_id", F.lit("toxicity sample"))
    # both samples are settled on by ids alone, so that no text is shuffled to draw them
    last = rows.select(draw.alias("draw")).orderBy("draw").limit(MAX_UNLABELLED).agg(F.max("draw").alias("draw")).first()["draw"]
    some = rows.where(draw <= F.lit(last)).select(F.lit(0).alias("toxic"), "text")
    picks = F.broadcast(known.where("toxic = 1").select("doc_id").orderBy(draw).limit(MAX_TOXIC))  # MAX_TOXIC ids at most
    sure = rows.join(picks, "doc_id", "left_semi").select(F.lit(1).alias("toxic"), "text")
    sample = settle(some.union(sure).repartition(24), "toxicity-sample")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1):
        return Model(np.empty(0, np.int64), np.zeros((1, 0)), np.array([-30.0]))
    share = (F.col("u") + 1) / F.lit(float(sizes[0]))
    chosen = (
        sample.mapInArrow(_feature_lists(None), _LISTS)
        .select("toxic", F.explode("features").alias("f"))
        .groupBy("f")
        .agg(F.count_if(F.col("toxic") == 1).alias("p"), F.count_if(F.col("toxic") == 0).alias("u"))
        .where(F.col("p") >= LEAST_DF)
        .withColumn("z", (F.col("p") / sizes[1] - share) / F.sqrt(share / sizes[1]))
        .where(F.col("z") >= LEAST_Z)
        .orderBy(F.desc("z"), "f")
        .limit(MAX_FEATURES)
    )
    known_features = np.array(sorted(r["f"] for r in chosen.collect()), np.int64)
    table = sample.mapInArrow(_feature_lists(frozenset(known_features.tolist())), _LISTS).toArrow()
    marks = table.column("toxic").to_numpy()
    lists = [np.asarray(x.values, np.int64) for x in table.column("features")]
    order = sorted(range(len(lists)), key=lambda i: (marks[i], lists[i].tolist()))  # whatever order the rows came in
    p = _Rows([lists[i] for i in order if marks[i]], known_features)
    u = _Rows([lists[i] for i in order if not marks[i]], known_features)
    fits = [nnpu_fit(p, sizes[1], u, sizes[0], len(known_features), prior, seed) for seed in SEEDS]
    return Model(known_features, np.stack([w for w, _ in fits]), np.array([b for _, b in fits]))


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    The score depends on the text alone: the presence of words the model knows, over the whole text. Null text counts
    as empty, whose score is the model's bias. A null id is never held out. Repeated rows are scored alike. An empty
    table gives an empty result. No shuffle; the model, whose size the training sample bounds, goes with the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                scores = [score(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    rows = text_rows(docs, id_col, text_col)
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", held, "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores below 0.5, with all their columns; a null text scores as the empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = shared.value.scorer()
        for part in parts:
            yield pd.Series([score(t) for t in part], dtype="float64")

    scored = F.pandas_udf(scores, "double")
    return docs.where(scored(F.coalesce(docs[text_col], F.lit(""))) < 0.5)
