"""N-gram Jaccard self join with Bayesian pruning of MinHash candidates."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, settle, text_rows
from .graph import connected_components

WORDS = re.compile(r"\w+")
SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 28, 5
TOLERANCE = 1e-6
STEP = 20  # MinHash values compared before each decision
BLOCK = 256  # documents of one candidate group compared at once

_K = np.uint64(0x9E3779B97F4A7C15)
_LANES = np.random.default_rng(20240607).integers(0, 1 << 32, size=(2, BANDS * ROWS, 1), dtype=np.uint32)
_MUL, _ADD = _LANES[0] | np.uint32(1), _LANES[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's lower-case word n-grams; a shorter text is one n-gram; none: empty."""
    words = WORDS.findall(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    m = max(1, len(h) - n + 1)
    out = np.zeros(m, np.uint64)
    for i in range(min(n, len(h))):
        out = out * _K + _mix(h[i : i + m])
    return np.unique(_mix(out + np.uint64(min(n, len(h)))))


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """BANDS * ROWS MinHash values of 32 bits."""
    out = np.full(len(_MUL), 0xFFFFFFFF, np.uint32)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(low), 1024):
        mixed = _MUL * low[i : i + 1024]
        mixed += _ADD
        np.minimum(out, mixed.min(1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.astype(np.uint64).reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        out = _mix(out * _K + parts[:, i])
    return out.view(np.int64)


@lru_cache
def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest equal values among n for which the posterior chance of a similarity of ``threshold`` is ``tolerance``.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1), whose tail above t is
    P(Binomial(n + 1, t) <= m).
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


_SIGN_SCHEMA = "doc_id long, mark long, node binary, n_shingles long, sig binary, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            node, size, sig, bands = [], [], [], []
            for text in part.column(1).to_pylist():
                s = shingle_hashes(text)
                size.append(len(s))
                if len(s):
                    m = min_hashes(s)
                    node.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sig.append(m.tobytes())
                    bands.append(band_keys(m))
                else:
                    node.append(None)
                    sig.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), part.column(2), pa.array(node, pa.binary()), pa.array(size, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "mark", "node", "n_shingles", "sig", "bands"],
            )


_SETS_SCHEMA = "node binary, n_copies long, grp binary, blocks long, sig binary, shingles binary"


def _reshingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [shingle_hashes(t).tobytes() for t in part.column("text").to_pylist()]
            cols = [part.column(c) for c in ("node", "n_copies", "grp", "blocks", "sig")]
            out = pa.RecordBatch.from_arrays([*cols, pa.array(sets, pa.binary())], names=["node", "n_copies", "grp", "blocks", "sig", "shingles"])
            # another row may have the same id and another text
            yield out.filter(pa.array([xxhash.xxh3_128_digest(s) == n for s, n in zip(sets, part.column("node").to_pylist(), strict=True)]))


def _survivors(sigs: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no comparison of MinHash values, taken STEP by STEP, has ruled out."""
    same = np.zeros(len(a), np.int64)
    for i in range(0, sigs.shape[1], STEP):
        part = sigs[:, i : i + STEP]
        same += (part[a] == part[b]).sum(1)
        keep = same >= least_matches(min(i + STEP, sigs.shape[1]))
        a, b, same = a[keep], b[keep], same[keep]
        if not len(a):
            break
    return a, b


def _shared(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of sets[a] and sets[b]."""
    if len(a) < 64:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], np.int64)
    left, at_a = np.unique(a, return_inverse=True)
    right, at_b = np.unique(b, return_inverse=True)
    used = np.union1d(left, right)
    values, places = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
    ends = np.cumsum([0, *(len(sets[i]) for i in used)])
    total = np.zeros((len(left), len(right)), np.float64)
    of = {int(x): (int(ends[k]), int(ends[k + 1])) for k, x in enumerate(used)}
    width = max(1, 8_000_000 // (len(left) + len(right)))
    for lo in range(0, len(values), width):
        def dense(docs: np.ndarray) -> np.ndarray:
            m = np.zeros((len(docs), min(width, len(values) - lo)), np.float32)
            for k, x in enumerate(docs):
                p = places[of[int(x)][0] : of[int(x)][1]]
                p = p[np.searchsorted(p, lo) : np.searchsorted(p, lo + width)] - lo
                m[k, p] = 1
            return m

        total += dense(left) @ dense(right).T
    return total[at_a, at_b].round().astype(np.int64)


def _links(sigs: np.ndarray, sets: list[np.ndarray], first: np.ndarray, second: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs with a Jaccard similarity of THRESHOLD, among ``first`` or between ``first`` and ``second``."""
    if second is None:
        x, y = np.triu_indices(len(first), 1)
        a, b = first[x], first[y]
    else:
        a, b = np.repeat(first, len(second)), np.tile(second, len(first))
    a, b = _survivors(sigs, a, b)
    if not len(a):
        return a, b
    both = _shared(sets, a, b)
    sizes = np.array([len(s) for s in sets], np.int64)
    keep = both >= THRESHOLD * (sizes[a] + sizes[b] - both) - 1e-9
    return a[keep], b[keep]


_LINK_SCHEMA = "node binary, root binary, links long"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (grp, i, j): all documents of one pair of blocks, or of one block, together."""

    def solve(rows: list[tuple]) -> pa.RecordBatch | None:
        sigs = np.stack([np.frombuffer(r[4], np.uint32) for r in rows])
        sets = [np.frombuffer(r[5], np.uint64) for r in rows]
        copies = np.array([r[6] for r in rows], np.int64)
        own = np.array([r[7] for r in rows])
        i, j = rows[0][1], rows[0][2]
        first = np.flatnonzero(own == i)
        a, b = _links(sigs, sets, first, None if i == j else np.flatnonzero(own == j))
        if not len(a):
            return None
        links = np.zeros(len(rows), np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        up = list(range(len(rows)))

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if (p := top(x)) != (q := top(y)):
                up[max(p, q)] = min(p, q)
        linked = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[x][3] for x in linked], pa.binary()), pa.array([rows[top(int(x))][3] for x in linked], pa.binary()), pa.array(links[linked], pa.int64())],
            names=["node", "root", "links"],
        )

    key, rows = None, []
    for batch in batches:
        for r in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True):
            if rows and r[:4] == rows[-1][:4]:
                continue  # a repeated row of one document
            if r[:3] != key:
                if len(rows) > 1 and (out := solve(rows)):
                    yield out
                key, rows = r[:3], []
            rows.append(r)
    if len(rows) > 1 and (out := solve(rows)):
        yield out


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, n_shingles.

    Two documents are linked when the Jaccard similarity of their sets of lower-case five-word shingles is 0.8 or
    more. ``n_links`` is the number of other rows a row is linked to; ``class_id`` the smallest id of its class, the
    documents that links connect.

    1. Rows with equal shingle sets are one node; only nodes are compared, and their number of rows kept as a weight.
    2. BANDS keys of ROWS MinHash values each: nodes that share a key are joined to the least node of that key, and
       the components of these stars are the candidate groups. A pair at 0.8 misses all keys once in 60,000.
    3. Each candidate group is dealt into blocks of about BLOCK nodes. Every pair of blocks is one unit of work, which
       compares MinHash values STEP by STEP, drops a pair once the posterior chance of reaching 0.8 is below TOLERANCE,
       and counts the shared shingles of all the others exactly. It returns a row a node, not a row a pair.
    4. The components of the verified links are the classes.

    Null and empty texts, and texts without a word, have no shingles: each is a class of its own without links. A text
    of fewer than five words is one shingle. Repeated rows count as rows. Rows with a null id are compared like all
    others; a class of such rows alone has a null ``class_id``. An empty table gives an empty result.
    """
    return classes(signatures(docs, id_col, text_col), docs, id_col, text_col).select("doc_id", "class_id", "n_links", "n_shingles")


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, mark): mark tells rows with one id and other text apart."""
    return text_rows(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, node, n_shingles, sig, bands): MinHash signatures, settled."""
    return settle(_marked(docs, id_col, text_col).mapInArrow(_sign, _SIGN_SCHEMA), "signatures")


def classes(signed: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, root, class_id, n_links, n_shingles) of all rows; root is the same for rows of one class, and null where a row is alone."""
    rows = signed.select("doc_id", "mark", "node", "n_shingles")
    at = F.xxhash64("doc_id", "mark").alias("at")  # of a node any row will do to fetch the text from
    nodes = settle(
        rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min(at).alias("at"), F.count("*").alias("n_copies")), "nodes"
    )
    keys = signed.where("node is not null").select("node", F.explode("bands").alias("key"))
    stars = keys.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("last")).where("center < last")
    edges = keys.join(stars.select("key", "center"), "key").where("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b"))
    groups = settle(connected_components(edges, "candidates").withColumnRenamed("root", "grp"), "groups")
    sizes = groups.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    members = groups.join(sizes, "grp").join(nodes, "node").select("node", "grp", "blocks", "at", "n_copies")
    # repeated rows share "at": one of each side, or n copies would meet n times n
    sigs = signed.where("node is not null").select(at, "node", "sig").dropDuplicates(["at"])
    texts = _marked(docs, id_col, text_col).select(at, "text").dropDuplicates(["at"])
    sets = members.join(sigs, ["at", "node"]).join(texts, "at").mapInArrow(_reshingle, _SETS_SCHEMA)
    return _finish(rows, nodes, sets)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class of near-duplicates: the one with the smallest id, and of texts with that id one.

    Rows are told apart by id and text, so another text with the id of a row that goes stays. A row that is repeated
    and has a word is a copy of itself, and one stays. Texts without a word are in no class: all their rows stay. Same
    columns. An empty table gives an empty result.
    """
    found = settle(classes(signatures(docs, id_col, text_col), docs, id_col, text_col).where("root is not null").select("doc_id", "mark", "root", "class_id"), "near-classes")
    least = F.expr("doc_id <=> class_id")
    keep = found.groupBy("root").agg(F.count("*").alias("n"), F.min(F.when(least, F.col("mark"))).alias("stays"))
    named = settle(lookup(found, settle(keep, "near-keep"), "root", "n", found.count()).select("doc_id", "mark", (least & (F.col("mark") == F.col("stays"))).alias("kept")), "near-named")
    gone = named.where("not kept").select("doc_id", "mark").distinct().toDF("gone_id", "gone_mark")
    twice = settle(named.where("kept").groupBy("doc_id", "mark").count().where("count > 1").select("doc_id", "mark").toDF("gone_id", "gone_mark"), "near-twice")

    def is_in(table: DataFrame):
        return docs[id_col].eqNullSafe(table["gone_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == table["gone_mark"])

    left = docs.join(gone, is_in(gone), "left_anti")
    if twice.head(1):
        left = left.join(twice, is_in(twice), "left_anti").unionByName(left.join(twice, is_in(twice), "left_semi").dropDuplicates([id_col, text_col]))
    return left


def _finish(rows: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    block = F.expr("pmod(xxhash64(node), blocks)")
    pairs = F.expr("transform(sequence(0L, blocks - 1), x -> struct(least(x, own) as i, greatest(x, own) as j))")
    units = (
        sets.withColumn("own", block)
        .select("grp", "own", "node", "sig", "shingles", "n_copies", F.explode(pairs).alias("p"))
        .select("grp", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "node", "sig", "shingles", "n_copies", "own")
        .repartition("grp", "i", "j")
        .sortWithinPartitions("grp", "i", "j", "node")
    )
    found = settle(units.mapInArrow(_compare, _LINK_SCHEMA), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "classes")
    named = parts.join(nodes.select("node", "rep"), "node")
    named = named.join(named.groupBy("root").agg(F.min("rep").alias("class_id"), F.lit(True).alias("linked")), "root").select("node", "root", "class_id", "linked")
    table = settle(
        nodes.join(named, "node", "left")
        .join(links, "node", "left")
        .where("n_copies > 1 or linked")
        .select(
            "node",
            F.coalesce("root", "node").alias("root"),
            F.coalesce("class_id", "rep").alias("class_id"),
            "n_copies",
            (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"),
        ),
        "node-classes",
    )
    out = lookup(rows, table, "node", "n_copies", rows.count())
    return out.select(
        "doc_id",
        "mark",
        "root",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "n_shingles",
    )
