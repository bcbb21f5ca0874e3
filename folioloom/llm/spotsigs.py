"""SpotSigs document fingerprints: chains of content words behind common-word anchors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, text_rows

WORDS = re.compile(r"\w+")
CHAIN = 2  # content words behind an anchor
THRESHOLD = 0.8
#: Buckets of neighbouring ids for each shuffle partition.
BUCKETS = 4

# Common words of English, German, French and Spanish.
ANCHORS = frozenset(
    """
    a an and are as at be by for from have he in is it of on only or that the this to was were which with you
    als am auf aus bei das dem den der des die ein eine einer es für im ist mit nicht sich sie und von war zu
    au aux avec ce dans de des du elle en est et la le les ne par pas pour que qui se sur un une
    al como con del el era esta los las lo más no para pero por se su una y
    """.split()
)

_K = np.uint64(0x9E3779B97F4A7C15)


def spots(text: str) -> np.ndarray:
    """Sorted distinct 64-bit signatures: each anchor with the next CHAIN content words, fewer at the end of the text.

    A text without such a chain has one signature, the hash of all its words, or of its characters if it has no word.
    """
    words = WORDS.findall(text.lower())
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    anchor = np.fromiter(map(ANCHORS.__contains__, words), bool, len(words))
    content = np.concatenate([h[~anchor], np.zeros(CHAIN, np.uint64)])
    n = len(content) - CHAIN
    at = np.cumsum(~anchor)[anchor]
    inside = at < n
    at, out = at[inside], h[anchor][inside]
    for k in range(CHAIN):
        out = (out ^ (out >> np.uint64(29))) * _K + content[at + k]
    if not len(out):
        return np.array([xxhash.xxh64_intdigest(" ".join(words) or text)], np.uint64)
    return np.unique(out ^ (out >> np.uint64(32)))


def as_text(signatures: np.ndarray) -> str:
    """The fingerprint: all signatures, 16 hex digits each, in ascending order."""
    return signatures.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity, or 0 without counting where the sizes alone keep it below ``least``."""
    small, large = sorted((len(a), len(b)))
    if small < least * large:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (small + large - both)


_OUT = "doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _neighbours(rows: DataFrame) -> DataFrame:
    """(bucket, ahead, doc_id, text): neighbouring ids share a bucket, and each bucket also has its successor's first row.

    Buckets are cut at quantiles of the ids; what reaches the driver is two ids a bucket. Rows with ``ahead`` are copies
    of the first document of the next bucket; the last bucket gets that of the first.
    """
    spark = rows.sparkSession
    n = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc_id", F.lit([k / n for k in range(1, n)]), F.lit(20 * n)).alias("q")).first()["q"] if n > 1 else []
    bounds = np.unique(np.array(cuts or [], np.int64))

    def find(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        out = np.zeros(len(ids), np.int64)
        out[known] = 1 + np.searchsorted(bounds, ids[known].astype(np.int64), "right")
        return pd.Series(out)

    bucket = F.pandas_udf(find, "long")
    firsts = rows.select("doc_id", bucket("doc_id").alias("bucket")).groupBy("bucket").agg(F.max("doc_id").alias("first")).collect()
    order = sorted(((r["bucket"], r["first"]) for r in firsts), reverse=True)
    goes = {first: order[k - 1][0] for k, (_, first) in enumerate(order)}  # the first row of bucket k also to bucket k - 1

    def places(ids: pd.Series) -> pd.Series:
        home = find(ids)
        return pd.Series([[2 * int(b)] + ([2 * goes[i] + 1] if (i := None if pd.isna(x) else int(x)) in goes else []) for b, x in zip(home, ids)])

    place = F.pandas_udf(places, "array<long>")
    return rows.select("doc_id", "text", F.explode(place("doc_id")).alias("place")).select(
        F.expr("place div 2").alias("bucket"), F.expr("place % 2").alias("ahead"), "doc_id", "text"
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text of a document is its text with the last floor(n_chars / 2) code points replaced by the first as
    many of the next document in descending order of the id, or all of it if that is shorter; the last document is
    followed by the first. ``near_*`` are Jaccard similarities of the signature sets.

    Null text counts as empty. Rows with one id follow each other in order of their texts, null ids come last. With a
    single row its next document is itself. An empty table gives an empty result. One shuffle, in which rows with
    neighbouring ids meet; a task reads its rows in order and holds two documents.
    """
    rows = text_rows(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    yield from zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True)

        out, last, mine = [], None, None
        for bucket, ahead, doc, text in stream():
            own = spots(text)
            if last is not None and last[0] == bucket:
                _, old_doc, old = last
                half = len(old) // 2
                edited = old[: len(old) - half] + text[:half]
                sig = spots(edited)
                out.append((old_doc, len(old), hashlib.sha256(edited.encode()).hexdigest(), as_text(mine), as_text(sig), likeness(mine, sig), likeness(mine, own)))
            last, mine = (None if ahead else (bucket, doc, text)), own
            if len(out) == 200:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    placed = _neighbours(rows)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartition(n, "bucket").sortWithinPartitions("bucket", "ahead", F.desc_nulls_last("doc_id"), "text")
    return placed.mapInArrow(run, _OUT.format(kind="long"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = [x.split()[0] for x in _OUT.format(kind="long").split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sigs = [spots(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sigs], pa.string()), pa.array([s.view(np.int64) for s in sigs], pa.list_(pa.int64()))],
            names=["doc_id", "node", "sigs"],
        )


def similar_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, similarity) of fingerprints at ``threshold`` or above, and (doc_id, node) of all rows.

    Equal fingerprints are one node. A pair can reach the threshold only if the sizes differ by less than it, so sets
    are partitioned by size, each partition as wide as the threshold lets sizes differ, and meet only those of their
    own partition and the next. Within these, two sets must share one of their first size - ceil(threshold * size) + 1
    signatures; pairs that do are compared in full.
    """
    members = settle(text_rows(docs, id_col, text_col).mapInArrow(_signed, "doc_id long, node string, sigs array<long>"), "spots")
    nodes = members.select("node", "sigs").dropDuplicates(["node"]).withColumn("size", F.size("sigs"))
    nodes = settle(nodes.withColumn("part", F.floor(F.log("size") / -F.log(F.lit(threshold))).cast("long")), "spot-nodes")
    first = F.slice("sigs", 1, (F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9) + 1).cast("int"))
    keys = nodes.select("node", "size", "part", F.explode(first).alias("key"))
    other = keys.select(F.col("node").alias("b"), F.col("size").alias("nb"), "key", F.explode(F.array("part", F.col("part") - 1)).alias("part"))
    met = keys.join(other, ["key", "part"]).where("(size < nb or (size = nb and node < b)) and size >= " + repr(threshold) + "D * nb - 1e-9D")
    met = met.select(F.col("node").alias("a"), "b").distinct()
    both = met.join(nodes.select(F.col("node").alias("a"), F.col("sigs").alias("sa")), "a").join(nodes.select(F.col("node").alias("b"), F.col("sigs").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    pairs = both.select("a", "b", (common / (F.size("sa") + F.size("sb") - common)).alias("similarity")).where(F.col("similarity") >= threshold - 1e-9)
    return pairs, members.select("doc_id", "node")
