"""Centroid clustering in exact integers; nearest centroids by annulus search over centroid norms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, settle

DIM, SCALE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Quantised components are held within these bounds, so that a squared distance of 64 components fits 64 bits.
LIMIT = (1 << 27) - 1


class Annulus:
    """Centroids sorted by norm, for exact nearest-centroid search.

    By the triangle inequality a centroid no farther from a vector than ``bound`` has a norm within ``bound`` of the
    vector's. Those centroids lie next to each other in the order of norms: two binary searches find them, and only they
    are compared, by integers. Norms are doubles; the annulus is a little wider than need be to make up for their rounding.
    """

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def _squared(self, vectors: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        gap = vectors - self.centroids[numbers]
        return np.einsum("ij,ij->i", gap, gap)

    def nearest(self, vectors: np.ndarray, hint: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each vector's nearest centroid, of equally near ones the smallest number.

        ``hint`` is a centroid a vector, whose distance is the vector's bound (the one it was nearest to a round
        ago); without it the centroid of the nearest norm takes its place.
        """
        norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        if hint is None:
            at = np.clip(np.searchsorted(self.norms, norms), 0, len(self.norms) - 1)
            before = np.maximum(at - 1, 0)
            hint = self.order[np.where(np.abs(self.norms[before] - norms) < np.abs(self.norms[at] - norms), before, at)]
        best, number = self._squared(vectors, hint), hint.astype(np.int64)
        bound = np.sqrt(best.astype(np.float64))
        slack = 1e-9 * (norms + bound + self.norms[-1]) + 1e-9
        first = np.searchsorted(self.norms, norms - bound - slack, "left")
        last = np.searchsorted(self.norms, norms + bound + slack, "right")
        for step in range(int((last - first).max(initial=0))):
            rows = np.flatnonzero(first + step < last)
            rival = self.order[first[rows] + step]
            far = self._squared(vectors[rows], rival)
            wins = (far < best[rows]) | ((far == best[rows]) & (rival < number[rows]))
            best[rows[wins]], number[rows[wins]] = far[wins], rival[wins]
        return number, best


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def quantised(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, q): vectors of exactly ``dim`` components, none null or non-finite, each component x as floor(scale * x).

    All other rows are left out, null vectors among them. Components beyond LIMIT are held at it.
    """
    x = embeddings[vector_col].cast("array<double>")
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    held = F.transform(x, lambda v: F.floor(F.least(F.lit(float(LIMIT)), F.greatest(F.lit(-float(LIMIT)), v * float(scale)))).cast("int"))
    return embeddings.where((F.size(x) == dim) & fit).select(embeddings[id_col].alias("vec_id"), held.alias("q"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:vec_id``; a null id counts as the empty string, equal hashes go by components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("key"), "q").orderBy("key", "q").limit(k).collect()
    return np.array([r["q"] for r in rows], np.int64)


def _assigned(vectors: DataFrame, centroids: np.ndarray, distances: bool) -> DataFrame:
    """``vectors`` with their nearest centroid as ``cluster``, the cluster they had being the hint; and its distance instead of q."""
    fields = vectors.schema.fields
    id_field = next(f for f in fields if f.name == "vec_id")
    hinted = any(f.name == "cluster" for f in fields)
    tail = [T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())] if distances else [
        T.StructField("q", T.ArrayType(T.IntegerType())), T.StructField("cluster", T.IntegerType())]
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(centroids)
        for batch in batches:
            if not batch.num_rows:
                continue
            hint = batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64) if hinted else None
            number, best = search.nearest(_matrix(batch.column("q"), width), hint)
            made = [pa.array(number, pa.int32()), pa.array(best, pa.int64())] if distances else [batch.column("q"), pa.array(number, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *made], names=["vec_id", *(f.name for f in tail)])

    return vectors.mapInArrow(run, T.StructType([id_field, *tail]))


def moved(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each non-empty centroid replaced by its vectors' componentwise floor(sum / count), exactly; one row a centroid reaches the driver."""
    sums = [F.sum(F.col("q")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for row in assigned.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        out[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(centroids.shape[1])]
    return out


def cluster(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE,
    k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED,
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid (its components), centroid_sha256.

    Vectors that ``quantised`` leaves out have no row. Each of ``rounds`` rounds assigns every vector to its nearest
    centroid by ``Annulus`` and moves the centroids; a last assignment follows. A round reads the table of the round
    before, whose clusters give the bounds, and writes its own, which the next one replaces. One row for each of ``k``
    centroids, a number that doesn't grow with the data, is all that passes through the driver and goes to each task.

    Ties go to the smaller number. Repeated rows are vectors of their own, and may both be first centroids. With fewer
    than ``k`` vectors each is a first centroid. Rows with a null id are clustered like all others. Sums of distances
    beyond 64 bits are held at the largest long. Extra columns are ignored. An empty table gives an empty result.
    """
    now = settle(quantised(embeddings, id_col, vector_col, dim, scale), "quantised")
    centroids = first_centroids(now, k, seed).reshape(-1, dim)
    if not len(centroids):
        return _named(now.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids)
    for _ in range(rounds):
        before, now = now, settle(_assigned(now, centroids, distances=False), "assigned")
        discard(before)
        centroids = moved(now, centroids)
    found = settle(_assigned(now, centroids, distances=True), "distances")
    discard(now)
    return _named(found, centroids)


def _named(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    rows = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    most, whole = (1 << 63) - 1, sum(int(r["d"]) for r in rows)
    table = found.sparkSession.createDataFrame(
        [(r["cluster"], min(most, int(r["d"])), min(most, whole), centroids[r["cluster"]].tolist()) for r in rows],
        "cluster int, cluster_inertia long, inertia long, centroid array<long>",
    )
    sha = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.join(F.broadcast(table), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", sha.alias("centroid_sha256")
    )
