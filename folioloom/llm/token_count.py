"""Token counts of whole texts; long ones in overlapping chunks that are spliced at proven boundaries."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_rows
from .pieces import Memo, single_spaced

CHUNK = 4_096  # code points of a chunk before its overlap; a longer text is encoded in chunks
OVERLAP = 256
LIMIT = 1024
#: No boundary so close to the end of a chunk is used: a special string could be cut off there.
GUARD = 32

_EDGE = re.compile(r"[^\W\d_](?=[\W\d_])")


class Counter:
    """Counts tokens as a byte-level ``tokenizers`` file gives them, special strings included, none added."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk, self.overlap = chunk, overlap
        self.widened = 0
        self._memo = Memo()
        self._starts_of = Memo(lambda piece: [a for a, _ in self.tokenizer.encode(piece, add_special_tokens=False).offsets])

    def _library(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Bring the counts of pieces, each behind a space, into the memo: all new ones in one call of the library."""
        known = set(pieces)
        self._memo.room(len(known))
        new = self._memo.absent(known)
        self._memo.update(zip(new, self._library([" " + p for p in new]), strict=True))

    def count_many(self, texts: list[str]) -> list[int]:
        return [self.count_long(t) if len(t) > self.chunk else self._whole(t) for t in texts]

    def _whole(self, text: str) -> int:
        if not single_spaced(text):
            return self._library([text])[0]
        first, *rest = text.split(" ")
        self._learn(rest)
        return self._library([first])[0] * bool(first) + sum(map(self._memo.__getitem__, rest))

    def _encode(self, text: str, at: int, end: int, head: int, tail: int) -> tuple[int, list[int], list[int]]:
        """Of the encoding of text[at:end]: its tokens, where those start that start before ``head``, and those from ``tail`` on."""
        part = text[at:end]
        if not single_spaced(part):
            starts = [at + a for a, _ in self.tokenizer.encode(part, add_special_tokens=False).offsets]
            return len(starts), [s for s in starts if s < head], [s for s in starts if s >= tail]
        first, *rest = part.split(" ")
        self._learn(rest)
        n = self._library([first])[0] * bool(first) + sum(map(self._memo.__getitem__, rest))
        pieces = [first, *(" " + p for p in rest)]
        before, place, k = [], at, 0
        while place < head and k < len(pieces):
            before += [place + a for a in self._starts_of[pieces[k]]] if pieces[k] else []
            place, k = place + len(pieces[k]), k + 1
        after, place, k = [], end, len(pieces)
        while place > tail and k:
            k -= 1
            place -= len(pieces[k])
            after += [place + a for a in self._starts_of[pieces[k]]] if pieces[k] else []
        return n, [s for s in before if s < head], [s for s in after if s >= tail]

    def count_long(self, text: str) -> int:
        """Splice chunks where both encodings start a token and the pre-tokenizer must cut.

        It must cut between a letter and what isn't one: no token of its pattern goes on from a letter to another
        character, and nothing of the pattern looks back. Where two chunks share no such boundary, the earlier one is
        encoded anew with an overlap twice as wide, if need be to the end of the text. Of a chunk only its number of
        tokens and those that start within its overlaps are kept.
        """
        if single_spaced(text):
            self._learn(text.split(" ")[1:])
        n, total, begin, at, overlap = len(text), 0, 0, 0, self.overlap
        end = min(n, at + self.chunk + overlap)
        head = at
        tokens, before, after = self._encode(text, at, end, head, end - overlap)
        while end < n:
            next_at = end - overlap
            next_end = min(n, next_at + self.chunk + self.overlap)
            following = self._encode(text, next_at, next_end, end, next_end - self.overlap)
            both = set(after).intersection(following[1])
            edges = (m.end() for m in _EDGE.finditer(text, next_at, end))
            splice = max((p for p in edges if p <= end - GUARD and p > begin and p in both), default=None)
            if splice is None:
                self.widened += 1
                overlap *= 2
                end = min(n, end + overlap)
                tokens, before, after = self._encode(text, at, end, head, end - overlap)
                continue
            total += tokens - sum(s < begin for s in before) - sum(s >= splice for s in after)
            begin, at, head, end, overlap = splice, next_at, end, next_end, self.overlap
            tokens, before, after = following
        return total + tokens - sum(s < begin for s in before)


@lru_cache(maxsize=2)
def load(path: str, chunk: int, overlap: int) -> Counter:
    return Counter(path, chunk, overlap)


def token_counts(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    ``tokenizer`` is the path of a byte-level tokenizers file that every executor can open. No shuffle. Texts up to
    ``chunk`` code points are counted at once, longer ones chunk by chunk, so that no encoding is larger than a chunk
    with its overlap unless a text has no boundary for that long. Null text counts as empty: 0 bytes, 0 tokens. Ids
    may be null or repeated. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(tokenizer, chunk, overlap)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                n = counter.count_many(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    rows = text_rows(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
