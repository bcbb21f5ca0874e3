"""Byte-level BPE with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import text_rows
from .pieces import Memo, single_spaced

WORD = 256  # bits in a word of the bitmap: 8 bits of a rank say which


class RankQueue:
    """Positions by merge rank: a bucket a rank, and a two-level bitmap of the ranks whose buckets hold something.

    The lowest rank is found by find-first-set on the summary word and then on one word of the lower level, whatever
    the number of entries. Within a bucket the leftmost position comes first.
    """

    def __init__(self, ranks: int):
        self._words = [0] * (ranks // WORD + 1)
        self.top = 0
        self._buckets: list[list[int] | None] = [None] * (ranks + 1)

    def push(self, rank: int, position: int) -> None:
        bucket = self._buckets[rank]
        if bucket is None:
            self._buckets[rank] = [position]
            w = rank >> 8
            self._words[w] |= 1 << (rank & 255)
            self.top |= 1 << w
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int]:
        """(rank, position) of the lowest rank of a queue that isn't empty: one whose ``top`` isn't 0."""
        top = self.top
        w = (top & -top).bit_length() - 1
        bits = self._words[w]
        low = bits & -bits
        rank = (w << 8) + low.bit_length() - 1
        bucket = self._buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        self._buckets[rank] = None
        self._words[w] = bits = bits ^ low
        if not bits:
            self.top = top & (top - 1)
        return rank, bucket[0]


class Bpe:
    """Encoder and decoder for tiktoken-style ranks: ``ranks`` maps the bytes of each token to its rank, which is its id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self._longest = max(map(len, ranks))
        self._queue = RankQueue(max(ranks.values()) + 1)
        self._pattern = regex.compile(pattern)
        self._pre = Memo(lambda p: b"".join(i.to_bytes(4, "little") for i in self.merge(p.encode())))
        self._first = Memo(self._cut)
        self._later = Memo(lambda p: self._cut(" " + p))

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token.

        Tokens are a linked list over byte positions. ``pair[i]`` is the rank of the token at i joined to its
        successor, or -1. A queue entry whose rank isn't the present ``pair`` of its position is stale and skipped.
        """
        ranks, n = self.ranks, len(piece)
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        get, longest, queue = ranks.get, self._longest, self._queue
        push, pop = queue.push, queue.pop
        after = list(range(1, n + 2))
        before = list(range(-1, n))
        pair = [get(piece[i : i + 2], -1) for i in range(n)]
        pair[-1] = -1
        for i, r in enumerate(pair):
            if r >= 0:
                push(r, i)
        while queue.top:
            rank, i = pop()
            if pair[i] != rank:
                continue
            gone = after[i]
            end = after[gone]
            pair[gone] = -1
            after[i] = end
            if end < n:
                before[end] = i
                stop = after[end]
                pair[i] = r = get(piece[i:stop], -1) if stop - i <= longest else -1
                if r >= 0:
                    push(r, i)
            else:
                pair[i] = -1
            if (p := before[i]) >= 0:
                r = get(piece[p:end], -1) if end - p <= longest else -1
                if r != pair[p]:
                    pair[p] = r
                    if r >= 0:
                        push(r, p)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def _cut(self, text: str) -> bytes:
        return b"".join(map(self._pre.__getitem__, self._pattern.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not single_spaced(text):
            return self._cut(text)
        parts = text.split(" ")
        return self._first[parts[0]] + b"".join(map(self._later.__getitem__, parts[1:]))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Bpe:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines()) if a}
    return Bpe(ranks, pattern)


def bpe_round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` ids array<int>.

    Encodes each whole text without special tokens and decodes the ids again. ``vocabulary`` is the path of a file of
    base64 tokens and ranks that every executor can open. No shuffle; a task holds one batch of texts and two bounded
    memos, which last as long as its Python worker. Null text counts as empty and has no tokens. Ids, ties and
    repeated rows play no part. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
                cols = [
                    part.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array([list(memoryview(x).cast("I")) for x in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = text_rows(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema)
