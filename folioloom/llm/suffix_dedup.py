"""Removal of repeated byte strings by sharded suffix arrays.

A string of WINDOW bytes belongs to its anchor, the KMER bytes in it whose hash is least (the leftmost of equal ones).
Equal strings have equal anchors, so the suffixes of the corpus can be dealt to shards by anchor without parting
equal strings. The strings of a text that follow each other with one anchor are a run; its bytes are its stretch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, settle, text_rows
from .induced_sort import permuted_prefixes, suffix_array

WINDOW, KMER = 100, 32
PIECE = 1 << 20  # bytes searched for anchors at once; their places take as many bits
SIEVE_BITS = 27  # of the bitmap of repeated anchors: 16 MB, whatever the data
SHARD = 1 << 21  # bytes of a suffix array, about
CELL = 1 << 16  # bytes of the stretches of one anchor from which they are told apart further
FEW_KEYS = 1 << 18  # keys that are broadcast; more are shuffled
END = 0xFF  # between stretches; not a byte of UTF-8

_K = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _K)


def _kmer_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes whose upper bits are good for order; ``_mix`` them for anything else."""
    h, power, n = _BYTE[data], int(_K), 1
    while n < KMER:
        left = h[:-n] * np.uint64(power)
        left += h[n:]
        h, power, n = left, power * power & 0xFFFFFFFFFFFFFFFF, n * 2
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all ``width`` neighbours."""
    n = 1
    while n * 2 <= width:
        x, n = np.minimum(x[:-n], x[n:]), n * 2
    rest = width - n
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class Runs:
    """The runs of some texts: text number, first string's place in the text, number of strings, anchor hash, and the
    anchor's place in the stretch; ``stretch(i)`` gives the bytes."""

    def __init__(self, data: memoryview, at: np.ndarray, text: np.ndarray, lo: np.ndarray, n: np.ndarray, anchor: np.ndarray, inside: np.ndarray):
        self.data, self.at, self.text, self.lo, self.n, self.anchor, self.inside = data, at, text, lo, n, anchor, inside

    def stretch(self, i: int) -> memoryview:
        return self.data[self.at[i] : self.at[i] + self.n[i] + WINDOW - 1]


def runs(texts: list[bytes]) -> Iterator[Runs]:
    """All runs, text by text in order; a long text is searched in overlapping pieces, at whose ends runs are cut."""
    pack: list[tuple[int, int, memoryview]] = []
    size = 0
    for k, text in enumerate(texts):
        view = memoryview(text)
        for start in range(0, len(text) - WINDOW + 1, PIECE // 2):
            part = view[start : start + PIECE // 2 + WINDOW - 1]
            if size + len(part) > PIECE:
                yield _runs(pack)
                pack, size = [], 0
            pack.append((k, start, part))
            size += len(part)
    if pack:
        yield _runs(pack)


def _runs(pack: list[tuple[int, int, memoryview]]) -> Runs:
    data = b"".join(p for _, _, p in pack)
    h = _kmer_hashes(np.frombuffer(data, np.uint8))
    places = np.uint64(PIECE - 1)
    ordered = h & ~places
    ordered |= np.arange(len(h), dtype=np.uint64)
    nearest = _least(ordered, WINDOW - KMER + 1)
    sizes = np.array([len(p) for _, _, p in pack])
    base = np.cumsum(sizes) - sizes
    ends = base + sizes - WINDOW + 1  # of the places where strings begin
    at = np.union1d(np.flatnonzero(nearest[1:] != nearest[:-1]) + 1, base)
    part = np.searchsorted(base, at, "right") - 1
    within = at < ends[part]
    at, part = at[within], part[within]
    n = np.minimum(np.append(at[1:], len(data)), ends[part]) - at
    place = (nearest[at] & places).astype(np.int64)
    lo = at - base[part] + np.array([s for _, s, _ in pack])[part]
    return Runs(memoryview(data), at, np.array([k for k, _, _ in pack])[part], lo, n, _mix(h[place]).view(np.int64), place - at)


class Sieve:
    """A bitmap of anchors of fixed size: it never misses an anchor of its own, and lets few others pass while it is sparse.

    What else passes only costs work. With 2^27 bits, 10^7 anchors let 7 % of the others pass; the more there are, the more.
    """

    def __init__(self, anchors: DataFrame, bits: int = SIEVE_BITS):
        self.shift = 64 - bits
        cell = F.shiftrightunsigned("anchor", self.shift)
        words = anchors.select(F.shiftright(cell, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(anchor, {self.shift}) & 63 as int))").alias("bit"))
        found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        table = np.zeros(1 << (bits - 6), np.uint64)
        table[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        self.table: Broadcast = anchors.sparkSession.sparkContext.broadcast(table)

    def passes(self, anchor: np.ndarray) -> np.ndarray:
        cell = anchor.view(np.uint64) >> np.uint64(self.shift)
        return (self.table.value[cell >> np.uint64(6)] >> (cell & np.uint64(63))) & np.uint64(1) == 1


def _bytes_of(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, mark): each anchor of a text once, and once more with another mark if the text has it more than once."""
    for batch in batches:
        marks = batch.column("mark").to_numpy()
        for r in runs(_bytes_of(batch.column("text"))):
            # texts of a pack are told apart by a multiplier; should two keys meet by chance, one anchor more passes
            key = r.anchor ^ _mix(r.text.astype(np.uint64) + np.uint64(1)).view(np.int64)
            order = key.argsort()
            key, anchor, text = key[order], r.anchor[order], r.text[order]
            again = np.concatenate([[False], key[1:] == key[:-1]])
            third = again & np.concatenate([[False], again[:-1]])
            mark = np.where(again, ~marks[text], marks[text])
            yield pa.RecordBatch.from_arrays([pa.array(anchor[~third]), pa.array(mark[~third])], names=["anchor", "mark"])


_RUN = "anchor long, stretch long, n int, doc_id long, mark long, lo long, f1 int"


def _finder(sieve: Sieve):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column("doc_id"), batch.column("mark").to_numpy()
            for r in runs(_bytes_of(batch.column("text"))):
                keep = np.flatnonzero(sieve.passes(r.anchor))
                ctx = np.fromiter((xxhash.xxh3_64_intdigest(r.stretch(i)) for i in keep), np.uint64, len(keep)).view(np.int64)
                text = r.text[keep]
                columns = [pa.array(r.anchor[keep]), pa.array(ctx), pa.array(r.n[keep].astype(np.int32)), ids.take(pa.array(text)), pa.array(marks[text]), pa.array(r.lo[keep].astype(np.int64)), pa.array(r.inside[keep].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "stretch", "n", "doc_id", "mark", "lo", "f1"])

    return find


_CELL = "cell long, doc_id long, mark long, lo long, n int, f1 int, f2 int, bytes binary"


def _cells(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["cell", "doc_id", "mark", "lo", "n", "f1", "f2", "bytes"])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, ...) with their bytes, of the runs that are wanted of each text."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part, rows = batch.slice(at, 256), []
            for doc_id, mark, data, wanted in zip(part.column("doc_id").to_pylist(), part.column("mark").to_pylist(), _bytes_of(part.column("text")), part.column("wanted").to_pylist(), strict=True):
                for w in wanted:
                    rows.append((w["anchor"], doc_id, mark, w["lo"], w["n"], w["f1"], w["f1"] + KMER, data[w["lo"] : w["lo"] + w["n"] + WINDOW - 1]))
            yield _cells(rows)


def _halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each run in two: the strings that hold half of what is still free of WINDOW before the fixed bytes, and the others,
    which hold the rest of it after them. Those bytes become fixed, and part of the key; equal strings stay together."""
    for batch in batches:
        rows = []
        for cell, doc_id, mark, lo, n, f1, f2, data in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
            free = WINDOW - (f2 - f1)
            half = (free + 1) // 2
            left = min(n, max(0, f1 - half + 1))  # strings that begin at f1 - half or before
            for side, first, count, a, b in (("L", 0, left, f1 - half, f2), ("R", left, n - left, f1, f2 + free - half + 1)):
                if count:
                    key = xxhash.xxh3_64_intdigest(b"%d%c" % (cell, ord(side)) + data[a:b])
                    rows.append((key - (1 << 64) if key >> 63 else key, doc_id, mark, lo + first, count, a - first, b - first, data[first : first + count + WINDOW - 1]))
        yield _cells(rows)


_CUT = "doc_id long, mark long, start long, n long"


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edges[::2], edges[1::2]


def _repeats(stretches: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """For each stretch, which of its strings are equal to one that begins earlier, in it or in a stretch before it."""
    text = np.frombuffer(bytes([END]).join(stretches), np.uint8)
    sizes = np.array([len(s) for s in stretches]) + 1
    base = np.cumsum(sizes) - sizes
    order = suffix_array(text, 256)
    common = permuted_prefixes(text, order, WINDOW)
    opens = common[order] < WINDOW  # suffixes between two of these begin with the same WINDOW bytes
    first = np.minimum.reduceat(order, np.flatnonzero(opens))
    again = np.empty(len(text), bool)
    again[order] = order != first[np.cumsum(opens) - 1]
    return [again[b : b + n] for b, n in zip(base, counts, strict=True)]


def _sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (shard, doc_id, mark, lo). Gives the strings that are repeats, as ranges of where they begin."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        found = []
        for (_, doc_id, mark, lo, _, _), again in zip(rows, _repeats([r[5] for r in rows], [r[4] for r in rows]), strict=True):
            found += [(doc_id, mark, lo + a, b - a) for a, b in zip(*(x.tolist() for x in _ranges(again)), strict=True)]
        columns = list(zip(*found, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "mark", "start", "n"])

    shard, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if row[0] != shard:
                if len(rows) > 1:
                    yield solve(rows)
                shard, rows = row[0], []
            if not rows or rows[-1][:4] != row[:4]:  # a repeated row of one document is that document
                rows.append(row)
    if len(rows) > 1:
        yield solve(rows)


_REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, length: long>>, kept binary"


def _remover(sieve: Sieve, keep_bytes: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield solve(batch.slice(at, 256))

    def solve(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = _bytes_of(batch.column("text"))
        listed, cuts, copy = (batch.column(c).to_pylist() for c in ("listed", "cuts", "is_copy"))
        again = [np.full(max(0, len(t) - WINDOW + 1), bool(c)) for t, c in zip(texts, copy, strict=True)]
        for r in runs([b"" if c else t for t, c in zip(texts, copy, strict=True)]):
            keep = np.flatnonzero(sieve.passes(r.anchor))
            for k in np.unique(r.text[keep]).tolist():
                own = keep[r.text[keep] == k]
                own = own[~np.isin(r.lo[own], np.array(listed[k] or (), np.int64))]
                # not the first with these bytes
                for lo, n in zip(r.lo[own].tolist(), r.n[own].tolist(), strict=True):
                    again[k][lo : lo + n] = True
        out = []
        for k, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), texts, strict=True)):
            for c in cuts[k] or ():
                again[k][c["start"] : c["start"] + c["n"]] = True
            a, b = _ranges(again[k])
            spans, kept, end = [], [], 0
            for start, stop in zip(a.tolist(), (b + WINDOW - 1).tolist(), strict=True):
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = stop
                else:
                    spans.append([start, stop])
            for start, stop in spans:
                kept.append(text[end:start])
                end = stop
            left = b"".join([*kept, text[end:]])
            out.append((doc_id, len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), [{"start": s, "length": e - s} for s, e in spans], left if keep_bytes else None))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.binary())
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return remove


def _at() -> Column:
    return F.xxhash64("doc_id", "mark")


def _joined(texts: DataFrame, table: DataFrame, columns: list[str], how: str) -> DataFrame:
    """``texts`` with what ``table`` has for their (doc_id, mark); a null id is an id like others."""
    t, o = texts.withColumn("at", _at()), table.select(_at().alias("at"), F.col("doc_id").alias("its_id"), F.col("mark").alias("its_mark"), *columns)
    same = (t["at"] == o["at"]) & t["doc_id"].eqNullSafe(o["its_id"]) & (t["mark"] == o["its_mark"])
    return t.join(o, same, how).select("doc_id", "mark", "text", *columns)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False, sieve_bits: int = SIEVE_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, length), kept (if ``keep_bytes``).

    A byte goes if a string of WINDOW bytes around it also starts earlier: in a document with a smaller id, or earlier in
    the same one; strings never cross documents, and are judged on the input.

    1. Anchors that two different texts, or two places of one, have in common are counted, and kept as a ``Sieve``.
    2. Runs with such anchors are aggregated by their bytes: of equal stretches the first goes on, and the strings of the others
       are all repeats. So a group of copies of whatever size sends one, and an anchor with one stretch is settled.
    3. Their bytes are fetched. An anchor with more than CELL bytes of different stretches (a common phrase in ever other
       surroundings) has its runs halved by the bytes around, until its cells are small; strings without a like drop out on the way.
    4. Shards of about SHARD bytes are suffix-sorted by induced sorting, with the permuted common prefixes up to WINDOW.
       Suffixes between which the prefix is WINDOW are equal strings: all but the first begin removed ranges.
    5. Each document has its ranges applied. Whole copies of a text with at least WINDOW bytes go entirely.

    Null and empty texts, and those shorter than WINDOW, stay as they are. Repeated rows, with equal id and text, are one
    document and get one result each. Texts with the same id go by hash among themselves; a null id comes before all others.
    Extra columns are ignored. An empty table gives an empty result.
    """
    texts = text_rows(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("mark", F.xxhash64("text"))
    documents = settle(texts.groupBy("doc_id", "mark", F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("rows")), "suffix-documents")
    copies = documents.groupBy("sha").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.count("*").alias("many")).where("many > 1")
    repeated = bool(documents.where("rows > 1").head(1))

    shared = texts.select("mark", "text").mapInArrow(_anchors, "anchor long, mark long").groupBy("anchor").agg(F.min("mark").alias("a"), F.max("mark").alias("b")).where("a <> b")
    sieve = Sieve(shared, sieve_bits)
    place = F.struct("doc_id", "mark", "lo", "f1")
    found = texts.mapInArrow(_finder(sieve), _RUN).groupBy("anchor", "stretch", "n").agg(F.min(place).alias("x"))
    listed = settle(found.select("anchor", "n", "x.*"), "suffix-runs")

    once = texts.dropDuplicates(["doc_id", "mark"]) if repeated else texts
    several = listed.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    wanted = listed.join(several, "anchor", "left_semi").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("anchor", "lo", "n", "f1")).alias("wanted"))
    cells = settle(_joined(once, wanted, ["wanted"], "inner").mapInArrow(_fetch, _CELL), "suffix-cells")
    cuts = _all_repeats(cells)

    gone = lookup(documents, copies, "sha", "many", documents.count()).where("first is not null").where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark")))).select("doc_id", "mark", F.lit(True).alias("is_copy"))
    facts = listed.select("doc_id", "mark", "lo").unionByName(cuts.select("doc_id", "mark", F.struct("start", "n").alias("cut")), allowMissingColumns=True).unionByName(gone, allowMissingColumns=True)
    table = facts.groupBy("doc_id", "mark").agg(F.collect_list("lo").alias("listed"), F.collect_list("cut").alias("cuts"), F.max("is_copy").alias("is_copy"))
    return _joined(texts, table, ["listed", "cuts", "is_copy"], "left").mapInArrow(_remover(sieve, keep_bytes), _REPORT)


def _parted(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi or anti join by cell; a few keys are broadcast, so that a cell with many rows stays spread."""
    return rows.join(F.broadcast(keys) if keys.count() <= FEW_KEYS else keys, "cell", how)


def _all_repeats(cells: DataFrame) -> DataFrame:
    """(doc_id, mark, start, n): the strings of all cells that are repeats, cells of more than CELL bytes halved as often as need be."""
    ready, cuts = [], []
    while True:
        sizes = cells.groupBy("cell").agg(F.count("*").alias("c"), F.sum(F.length("bytes") + 1).alias("size"))
        large = settle(sizes.where(F.col("size") > CELL).select("cell"), "suffix-large")
        if not large.head(1):
            ready.append(cells)
            break
        ready.append(_parted(cells, large, "left_anti"))
        halves = settle(_parted(cells, large, "left_semi").mapInArrow(_halve, _CELL).withColumn("stretch", F.xxhash64("bytes")), "suffix-halves")
        # of equal stretches the first stays, as before; the others are repeats
        same = halves.groupBy("cell", "stretch", "n").agg(F.min(F.struct("doc_id", "mark", "lo")).alias("a"), F.count("*").alias("c"))
        alone = same.groupBy("cell").agg(F.sum("c").alias("all")).where("all > 1").select("cell")
        halves = halves.join(alone, "cell", "left_semi").join(same.where("c > 1").drop("c"), ["cell", "stretch", "n"], "left")
        x = F.struct("doc_id", "mark", "lo")
        halves = settle(halves.withColumn("later", F.coalesce(x > F.col("a"), F.lit(False))).drop("stretch", "a"), "suffix-cells")
        cuts.append(halves.where("later").select("doc_id", "mark", F.col("lo").alias("start"), F.col("n").cast("long").alias("n")))
        cells = halves.where("not later").select(cells.columns)
    rows = ready[0]
    for more in ready[1:]:
        rows = rows.unionByName(more)
    total = rows.agg(F.sum(F.length("bytes") + 1)).head()[0] or 0
    shard = F.pmod(F.xxhash64("cell"), F.lit(max(1, -(-total // SHARD))))
    dealt = rows.select(shard.alias("shard"), "doc_id", "mark", "lo", "n", "bytes").repartition("shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "mark", "lo")
    out = settle(dealt.mapInArrow(_sort_shards, _CUT), "suffix-cuts")
    for more in cuts:
        out = out.unionByName(more)
    return out
