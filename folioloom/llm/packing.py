"""Packing documents into training sequences by cutting-stock column generation."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import cutting_stock
from .common import settle, text_rows

CAPACITY = 2048
END_ID = 1
#: Code points of the pieces, and of the words, that a memo holds before it is emptied.
MEMO = 6_000_000
SMALL = 200_000  # cut pieces that may be broadcast

# The pattern of the tokenizer, in lower case and for the characters of _PLAIN alone.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pieces whose case, composition and pattern need no tables of Unicode: printable ASCII, its white space, Latin-1 letters.
_PLAIN = re.compile(r"[\t\n\r!-~À-ÖØ-öø-ÿ]*")
_WORD_END = b"\xff"  # no byte of UTF-8


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def word_encoder(spec: dict) -> Callable[[bytes], list[int]] | None:
    """Ids of one word, WORD_END behind it; None unless the tokenizer is known to be one whose merges are its ranks.

    That is so where the k-th merge makes the k-th token behind the single bytes: then the pair merged first is always
    the one whose result has the least id.
    """
    model, steps = spec["model"], (spec.get("normalizer") or {}).get("normalizers", [])
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>" or split != _SPLIT or [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"]:
        return None
    merges = ("".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"])
    if any(model["vocab"].get(m) != 512 + k for k, m in enumerate(merges)):
        return None
    byte, special = _byte_of(), {t["content"] for t in spec["added_tokens"]}
    ranks = {}
    for token, i in model["vocab"].items():
        if token not in special:
            body = token.removesuffix("</w>")
            ranks[bytes(map(byte.__getitem__, body)) + _WORD_END * (body != token)] = i
    return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece


class Encoder:
    """Ids of whole texts as a ``tokenizers`` file gives them, as unsigned 32-bit little-endian bytes.

    For a tokenizer that drops white space, lower-cases and normalises without regard to what a space parts, and never
    joins across a space: a text is encoded space by space, each new piece once. Pieces of plain characters are cut by
    the tokenizer's pattern and their words merged by rank; pieces of other characters, and all that could hold a
    special string, go to the library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._merge = word_encoder(json.loads(self.tokenizer.to_str()))
        self._marks = tuple({t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        self._pieces: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}
        self._held = self._held_words = 0

    def _plain(self, piece: str) -> bool:
        return self._merge is not None and len(piece) < 400 and _PLAIN.fullmatch(piece) is not None and not any(m in piece for m in self._marks)

    def _learn(self, new: set[str]) -> None:
        """Bring the ids of pieces that the memo lacks into it."""
        self._held += sum(map(len, new))
        if self._held > MEMO:
            self._pieces.clear()
            self._held = 0
        plain = [p for p in new if self._plain(p)]
        cut = [_WORDS.findall(p.lower()) for p in plain]
        words = self._words
        if fresh := set().union(*cut).difference(words):
            self._held_words += sum(map(len, fresh))
            if self._held_words > MEMO:
                words.clear()
                self._held_words, fresh = 0, set().union(*cut)
            merge = self._merge
            words.update((w, array("I", merge(w.encode() + _WORD_END)).tobytes()) for w in fresh)
        get = words.__getitem__
        self._pieces.update((p, b"".join(map(get, c))) for p, c in zip(plain, cut, strict=True))
        if len(plain) < len(new) and (other := list(new.difference(plain))):
            found = self.tokenizer.encode_batch_fast(other, add_special_tokens=False)
            self._pieces.update((p, array("I", e.ids).tobytes()) for p, e in zip(other, found, strict=True))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        parts = [t.split(" ") for t in texts]
        if new := (known := set().union(*parts)).difference(self._pieces):
            self._learn(new)
            if len(new) < len(known) and (gone := known.difference(self._pieces)):
                self._learn(gone)  # the memo was emptied meanwhile
        pieces = self._pieces
        return [b"".join(itemgetter(*p)(pieces)) if len(p) > 1 else pieces[p[0]] for p in parts]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


@lru_cache(maxsize=2)
def load(path: str) -> Encoder:
    return Encoder(path)


_PIECES = "doc_id long, doc_tokens long, part int, start long, length int, rank long, crc long, ids binary"
_PLACED = "doc_id long, doc_tokens long, part int, piece int, rank long, cut int, start long, length long, crc long, sequence_id long, offset long"


def _tokenise(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """A row a piece: full pieces of ``capacity`` tokens, then what remains, with its ids.

    ``rank`` counts the pieces of a length within a task, ``part`` is the task.
    """
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, ranks = load(tokenizer), TaskContext.get().partitionId(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                rows = []
                some = batch.slice(at, 128)
                for doc, ids in zip(some.column(0).to_pylist(), encoder.encode_many(some.column(1).to_pylist()), strict=True):
                    ids += tail
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        piece = ids[4 * start : 4 * (start + capacity)]
                        size = len(piece) // 4
                        rank = ranks.get(size, 0)
                        ranks[size] = rank + 1
                        kept = None if size == capacity else piece
                        rows.append((doc, n, part, start, size, rank, zlib.crc32(piece), kept))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _PIECES.split(", ")])

    return text_rows(docs).mapInArrow(run, _PIECES)


class Plan:
    """Where the k-th piece of each length goes. Its size depends on the number of lengths, not of documents."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        rest = {x: n for x, n in counts.items() if x < capacity}
        chosen = cutting_stock.dissolve(cutting_stock.whole_patterns(rest, capacity), capacity)
        sequence = counts.get(capacity, 0)
        self.slots: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = {x: ([], []) for x in rest}
        self.covered = dict.fromkeys(rest, 0)
        self.gap_from: list[int] = []
        self.gap_of: list[tuple[int, int]] = []
        gaps = 0
        for pattern, n in chosen:
            offset = 0
            for x in sorted(pattern, reverse=True):
                k = pattern[x]
                self.slots[x][0].append(self.covered[x])
                self.slots[x][1].append((k, sequence, offset))
                self.covered[x] += k * n
                offset += k * x
            if offset < capacity:
                self.gap_from.append(gaps)
                self.gap_of.append((capacity - offset, sequence))
                gaps += n * (capacity - offset)
            sequence += n
        self.gaps, self.tail_from = gaps, sequence
        #: Pieces that are in no pattern.
        self.pooled = sum(rest[x] - self.covered[x] for x in rest)
        self.pool_from: dict[int, int] = {}
        pool = 0
        for x in sorted(rest):
            self.pool_from[x] = pool
            pool += x * (rest[x] - self.covered[x])
        #: Pool tokens beyond the gaps fill sequences one after another; the last, if not full, is dealt into powers of two.
        beyond = max(0, pool - gaps)
        left, self.steps, at = beyond % capacity, [], 0
        self.full = beyond // capacity
        while left:
            size = 1 << (left.bit_length() - 1)
            self.steps.append((at, size))
            at, left = at + size, left - size

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(from, to, sequence, offset) for each part of the piece of ``length`` with this rank."""
        if length == self.capacity:
            return [(0, length, rank, 0)]
        k = rank - self.covered[length]
        if k < 0:
            starts, found = self.slots[length]
            i = bisect_right(starts, rank) - 1
            copies, sequence, offset = found[i]
            copy, slot = divmod(rank - starts[i], copies)
            return [(0, length, sequence + copy, offset + slot * length)]
        out, done, at = [], 0, self.pool_from[length] + k * length
        while done < length:
            if at < self.gaps:
                i = bisect_right(self.gap_from, at) - 1
                gap, sequence = self.gap_of[i]
                copy, inside = divmod(at - self.gap_from[i], gap)
                room, place = gap - inside, (sequence + copy, self.capacity - gap + inside)
            else:
                n, inside = divmod(at - self.gaps, self.capacity)
                if n < self.full:
                    room, place = self.capacity - inside, (self.tail_from + n, inside)
                else:
                    j = bisect_right([s for s, _ in self.steps], inside) - 1
                    begin, size = self.steps[j]
                    room, place = begin + size - inside, (self.tail_from + self.full + j, inside - begin)
            take = min(room, length - done)
            out.append((done, done + take, *place))
            done, at = done + take, at + take
        return out


def _placed(meta: DataFrame, plan: Plan) -> DataFrame:
    """Where each piece of ``meta`` goes, one row a part; crc is null and ``cut`` its start in the piece where a piece is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32() if x.endswith(" int") else pa.int64() for x in _PLACED.split(", ")]
        for batch in batches:
            out = []
            for doc, tokens, start, length, part, rank, ahead, crc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for a, b, sequence, offset in plan.place(length, rank + ahead):
                    out.append((doc, tokens, part, length, rank, a, start + a, b - a, crc if b - a == length else None, sequence, offset))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _PLACED.split(", ")])

    return meta.mapInArrow(run, _PLACED)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    1. One pass encodes each document, adds ``end_id`` and cuts it into full pieces of ``capacity`` and a remainder. The
       pieces are settled as a table, each with its rank among the pieces of its length in its task.
    2. The number of pieces by length, at most ``capacity`` numbers, reaches the driver, which solves the cutting-stock
       program by column generation and rounds its patterns through residual programs (``cutting_stock``), so that
       every remainder lies whole in a pattern. Of the sequences that come of it, the least filled are dissolved, as
       many as it takes to fill what the others leave free.
    3. Offsets by (task, length) make ranks global; rank and length alone then say where a piece goes. Full pieces are a
       sequence each. The remainders of dissolved sequences are cut to fill the others, and what is left over follows in
       sequences of powers of two. So no token of padding is needed, and few documents up to ``capacity`` are cut.
    4. Only pieces that are cut need their ids again: they are joined to them, broadcast up to SMALL pieces.

    ``tokenizer`` is the path of a tokenizers file (see ``Encoder``) that every executor can open. Null text counts as
    empty: one token, ``end_id``. Repeated rows are packed each; a null id stays null. Ties are broken by the order of
    rows in their tasks. An empty table gives an empty result.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    pieces = settle(_tokenise(rows, tokenizer, capacity, end_id), "pieces")
    counts = settle(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    plan = Plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    # the offsets grow with the tasks, so they are never broadcast; without their ids, pieces are short rows
    meta = pieces.drop("ids").join(offsets.hint("merge"), ["length", "part"]).select("doc_id", "doc_tokens", "start", "length", "part", "rank", "ahead", "crc")
    placed = settle(_placed(meta, plan), "placed")
    cut = placed.where("crc is null").drop("crc")
    of = pieces.select("part", F.col("length").alias("piece"), "rank", "ids")
    cut = of.join(F.broadcast(cut) if plan.pooled <= SMALL else cut, ["part", "piece", "rank"])
    cut = cut.withColumn("crc", F.crc32(F.substring("ids", 4 * F.col("cut") + 1, (4 * F.col("length")).cast("int"))))
    columns = ["doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"]
    return placed.where("crc is not null").select(columns).unionByName(cut.select(columns))
