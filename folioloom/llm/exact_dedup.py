"""Exact deduplication on a cuckoo-filter index of text digests."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, settle, text_rows

SLOTS = 4
_ODD = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


class CuckooIndex:
    """Live digests with a payload each.

    A table of 16-bit fingerprints, SLOTS to a bucket, tells most absent digests without touching the content. A hit
    is only a hint: the content bucket of the digest is searched for the full digest. When an insertion finds no slot
    within ``max_kicks`` moves the table overflows: it is doubled and refilled from the stored digests, so no digest is
    ever lost. Deletion removes one fingerprint, and only after the digest was found live in the content; so it can't
    take the fingerprint of another.
    """

    def __init__(self, buckets: int = 256, max_kicks: int = 64):
        self.buckets = 1 << max(1, buckets - 1).bit_length()
        self.max_kicks = max_kicks
        self.false_hits = self.resizes = self.live = 0
        self._content: dict[int, dict[bytes, object]] = {}
        self._clear()

    def _clear(self) -> None:
        self._mask = self.buckets - 1
        self._table = array("H", bytes(2 * SLOTS * self.buckets))

    @staticmethod
    def _split(digest: bytes) -> tuple[int, int]:
        """Fingerprint (never 0) and the hash that places it."""
        return int.from_bytes(digest[:2], "little") or 1, int.from_bytes(digest[2:10], "little")

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ ((mark * _ODD & _M64) >> 20)) & self._mask

    def _slot(self, bucket: int, mark: int) -> int:
        at = bucket * SLOTS
        for i in range(at, at + SLOTS):
            if self._table[i] == mark:
                return i
        return -1

    def _place(self, mark: int, where: int) -> bool:
        table, bucket = self._table, where & self._mask
        for bucket in (bucket, self._other(bucket, mark)):
            if (i := self._slot(bucket, 0)) >= 0:
                table[i] = mark
                return True
        for kick in range(self.max_kicks):
            i = bucket * SLOTS + (mark + kick) % SLOTS
            mark, table[i] = table[i], mark
            bucket = self._other(bucket, mark)
            if (i := self._slot(bucket, 0)) >= 0:
                table[i] = mark
                return True
        return False

    def _grow(self) -> None:
        while True:
            self.buckets *= 2
            self.resizes += 1
            self._clear()
            if all(self._place(*self._split(d)) for held in self._content.values() for d in held):
                return

    def get(self, digest: bytes):
        """The payload, or None for a digest that isn't live."""
        mark, where = self._split(digest)
        first = where & self._mask
        if self._slot(first, mark) < 0 and self._slot(self._other(first, mark), mark) < 0:
            return None
        found = self._content.get(where, {}).get(digest)
        self.false_hits += found is None
        return found

    def put(self, digest: bytes, payload) -> None:
        """Insert, or replace the payload of a live digest."""
        mark, where = self._split(digest)
        held = self._content.setdefault(where, {})
        fresh = digest not in held
        held[digest] = payload
        if fresh:
            self.live += 1
            if not self._place(mark, where):
                self._grow()

    def delete(self, digest: bytes) -> bool:
        """Remove a live digest; False (and no change) if it isn't live."""
        if self.get(digest) is None:
            return False
        mark, where = self._split(digest)
        held = self._content[where]
        del held[digest]
        if not held:
            del self._content[where]
        first = where & self._mask
        i = self._slot(first, mark)
        self._table[i if i >= 0 else self._slot(self._other(first, mark), mark)] = 0
        self.live -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        for held in self._content.values():
            yield from held.items()


_GROUP_SCHEMA = "text_sha256 string, keep_chars long, keep_id long, group_size long"
_GROUP_ARROW = pa.schema(
    [("text_sha256", pa.string()), ("keep_chars", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())]
)


def _better(a: tuple, b: tuple) -> bool:
    """Whether (chars, id) a stays rather than b: more code points, then the smaller id, a null id last."""
    return (a[0], a[1] is not None, -(a[1] or 0)) > (b[0], b[1] is not None, -(b[1] or 0))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold the groups of a partition into one row a digest, through one index."""
    index = CuckooIndex()
    for batch in batches:
        for digest, chars, doc, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key = bytes.fromhex(digest)
            held = index.get(key)
            if held is None:
                index.put(key, [chars, doc, n])
            else:
                if _better((chars, doc), (held[0], held[1])):
                    held[:2] = chars, doc
                held[2] += n
    out: list[tuple] = []
    for key, (chars, doc, n) in index.items():
        out.append((key.hex(), chars, doc, n))
        if len(out) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _GROUP_ARROW)], schema=_GROUP_ARROW)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _GROUP_ARROW)], schema=_GROUP_ARROW)


def normal_digest(text: Column) -> Column:
    """SHA-256 of the text without its ASCII white space, as lowercase hex."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\f\r", ""), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same without the characters 9-13 and 32. The row with the most code points in
    its original text stays, then the one with the smallest id.

    Each scan task folds its rows through a cuckoo index of its own, so a digest reaches the shuffle once a task
    however many rows share it; then each shard of digests is folded the same way. An index holds what one partition
    holds, never more. Only groups of two rows or more are looked up again, heavy ones by broadcast.

    Null text counts as empty; empty texts form one group. Repeated rows (same id and text) count as rows of their
    group, and each has ``kept`` true where its id is the one that stays. A null id stays only if no other row of its
    group is as long. An empty table gives an empty result.
    """
    rows = settle(
        text_rows(docs, id_col, text_col).select(
            "doc_id", F.length("text").cast("long").alias("chars"), normal_digest(F.col("text")).alias("text_sha256")
        ),
        "digests",
    )
    parts = rows.select("text_sha256", "chars", "doc_id", F.lit(1).cast("long").alias("n")).mapInArrow(_fold, _GROUP_SCHEMA)
    groups = parts.repartition("text_sha256").mapInArrow(_fold, _GROUP_SCHEMA)
    groups = settle(groups.where("group_size > 1").select("text_sha256", "keep_id", "group_size"), "groups")
    found = lookup(rows, groups, "text_sha256", "group_size", rows.count())
    return found.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def update_index(index: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply insertions and deletions to a stored index.

    ``index``: (digest hex, copies long) of live digests. ``changes``: (seq long, op 'insert' | 'delete', digest hex);
    per digest they apply in order of ``seq``. A digest stays live while it has copies; deleting one that isn't live
    changes nothing, as does a null digest. Returns the new (digest, copies). Work is dealt by digest; a task holds
    the digests of its partition.
    """
    both = index.select(F.lit(-1).cast("long").alias("seq"), F.lit("insert").alias("op"), "digest", F.col("copies").cast("long")).union(
        changes.select(F.col("seq").cast("long"), "op", "digest", F.lit(1).cast("long"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = CuckooIndex()
        for batch in batches:
            for _, op, digest, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = bytes.fromhex(digest)
                held = live.get(key)
                if op == "insert":
                    live.put(key, (held or 0) + n)
                elif held == 1:
                    live.delete(key)
                elif held:
                    live.put(key, held - 1)
        pairs = [(k.hex(), n) for k, n in live.items()]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.int64())], names=["digest", "copies"])

    kept = both.where("digest is not null").repartition("digest").sortWithinPartitions("digest", "seq")
    return kept.mapInArrow(run, "digest string, copies long")
