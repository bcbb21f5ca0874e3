"""Fuzzy line deduplication with DataFrame functions only: MinHash bands, exact Jaccard, distributed union-find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, text_rows
from .graph import connected_components

SHINGLE, THRESHOLD = 9, 0.8
HASHES = 16
STRIDE = 16  # shingles hashed in one row; by measurement, 8 and 32 cost more
SKETCH = 16  # numbers of 64 bits in the parity sketch of a line
BLOCK = 64  # lines of one band compared at once
SMALL = 400_000  # rows of four numbers that may be broadcast


def _planes() -> tuple[tuple[int, ...], ...]:
    """The twenty lines of the affine plane of order 4: each takes four of sixteen values, each two values share one line."""
    times = ((0, 0, 0, 0), (0, 1, 2, 3), (0, 2, 3, 1), (0, 3, 1, 2))  # of the field with four elements, whose sum is the exclusive or
    slanted = tuple(tuple(4 * x + (times[m][x] ^ b) for x in range(4)) for m in range(4) for b in range(4))
    return slanted + tuple(tuple(4 * x + y for y in range(4)) for x in range(4))


BANDS = _planes()


def _lines(rows: DataFrame) -> DataFrame:
    """(doc_id, mark, line_no, line, h, h2) of the lines that aren't blank; mark tells rows with one id and other text apart."""
    return (
        rows.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("mark"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .withColumn("line", F.trim("line"))
        .where("line <> ''")
        .withColumns({"h": F.xxhash64("line"), "h2": F.xxhash64(F.lit(2), "line")})
    )


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once a row, however often later columns use it: no projection merges across explode."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _wide(line: Column) -> Column:
    """The line with four bytes a character, in which a shingle is found without walking there."""
    return F.encode(line, "UTF-32")


def _shingle_at(wide: Column, at: Column) -> Column:
    return F.xxhash64(F.substring(wide, at, F.lit(4 * SHINGLE)))


def _starts(wide: Column, stride: int = 1) -> Column:
    return F.sequence(F.lit(1), F.length(wide) - (4 * SHINGLE - 1), F.lit(4 * stride))


def _signed(lines: DataFrame) -> DataFrame:
    """(h, m0, m1, ... int): MinHash values of each distinct line over all its shingles.

    The j-th value is the 32-bit hash nearest to j * 2^28 by exclusive or: the least of the sixteenth of all hashes
    that begin with j, or of the sixteenth next to it where that has none. A row takes STRIDE shingles; past the last
    one it repeats the last, which changes no minimum. A line of fewer than SHINGLE characters is like no other, and
    isn't signed.
    """
    wide = lines.where(F.length("line") >= SHINGLE).select("h", _wide(F.col("line")).alias("w"))
    placed = wide.select("h", "w", (F.length("w") - (4 * SHINGLE - 1)).alias("last"), F.explode(_starts(F.col("w"), STRIDE)).alias("at"))
    at = [F.least(F.col("at") + 4 * k, F.col("last")) for k in range(STRIDE)]
    hashed = placed.select("h", *(F.shiftright(_shingle_at(F.col("w"), x), 32).cast("int").alias(f"x{k}") for k, x in enumerate(at)))
    # the sign is turned round, so that signed numbers are in the order of unsigned ones
    turned = [F.lit(((j ^ 8) << 28) - ((j ^ 8) >> 3 << 32)).cast("int") for j in range(HASHES)]
    return hashed.groupBy("h").agg(*(F.min(F.least(*(F.col(f"x{k}").bitwiseXOR(turned[j]) for k in range(STRIDE)))).alias(f"m{j}") for j in range(HASHES)))


def _hashed(line: Column) -> Column:
    """The set of a line's shingles as hashes. The wide line is a variable: as a column it would be copied for each shingle."""
    return F.array_distinct(F.flatten(F.transform(F.array(_wide(line)), lambda w: F.transform(_starts(w), lambda at: _shingle_at(w, at)))))


def _alike(x: Column, y: Column) -> Column:
    """Whether the Jaccard similarity of two sets is THRESHOLD or more; sets too unequal in size aren't intersected."""
    small, large, both = F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y)), F.size(F.array_intersect(x, y))
    return (small >= THRESHOLD * large - 1e-9) & (both * (1 + THRESHOLD) >= THRESHOLD * (F.size(x) + F.size(y)) - 1e-9)


def _links(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``pairs`` whose lines a and b are alike."""
    both = pairs.join(found.select(F.col("h").alias("a"), F.col("line").alias("x")), "a").join(
        found.select(F.col("h").alias("b"), F.col("line").alias("y")), "b"
    )
    sets = _once(_once(both, "sx", _hashed(F.col("x"))).drop("x"), "sy", _hashed(F.col("y")))
    return sets.where(_alike(F.col("sx"), F.col("sy"))).select(pairs.columns)


def _with(rows: DataFrame, few: DataFrame, keys: list[str], number: int) -> DataFrame:
    """Inner join with ``few``, settled rows of which there are ``number``: broadcast up to SMALL, else shuffled."""
    return rows.join(F.broadcast(few) if number <= SMALL else few, keys)


def _sketched(found: DataFrame, members: DataFrame) -> DataFrame:
    """(h, size, odd, bands): the number of shingles of a line, for each bit of the sketch the parity of those that fall on it, its bands.

    Bits in which two sketches differ are no more than the shingles that only one of the lines has.
    """
    sets = _once(found, "s", _hashed(F.col("line"))).select("h", F.size("s").alias("size"), F.explode("s").alias("x"))
    bit = F.expr("shiftleft(1L, cast(pmod(shiftright(x, 8), 64) as int))")
    words = [F.bit_xor(F.when(F.expr(f"pmod(x, {SKETCH}) = {k}"), bit).otherwise(0)).alias(f"o{k}") for k in range(SKETCH)]
    sketches = sets.groupBy("h", "size").agg(*words).select("h", "size", F.array(*(f"o{k}" for k in range(SKETCH))).alias("odd"))
    return sketches.join(members.groupBy("h").agg(F.collect_list("key").alias("bands")), "h")  # of each line twenty at most


def _differ(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ."""
    return F.aggregate(F.zip_with(a["odd"], b["odd"], lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def _may_be_alike(a: Column, b: Column) -> Column:
    """False only where sizes or sketches prove two lines less alike than THRESHOLD."""
    close = F.least(a["size"], b["size"]) >= THRESHOLD * F.greatest(a["size"], b["size"]) - 1e-9
    return close & (_differ(a, b) * (1 + THRESHOLD) <= (a["size"] + b["size"]) * (1 - THRESHOLD) + 1e-9)


def _units(dealt: DataFrame, sketches: DataFrame, alone: bool) -> DataFrame:
    """A row a block with itself, or, unless ``alone``, a pair of blocks: (key, i, j, us), us being the lines of both."""
    members = dealt.join(sketches, "h").withColumn("own", F.expr("pmod(xxhash64(h), blocks)"))
    both = F.expr("array(struct(own as i, own as j))" if alone else "transform(sequence(0L, blocks - 1), x -> struct(least(x, own) as i, greatest(x, own) as j))")
    line = F.struct("own", "h", "root", "size", "odd", "bands").alias("u")
    units = members.select("key", F.explode(both).alias("p"), line).groupBy("key", "p").agg(F.collect_list("u").alias("us"))
    return units.where(F.size(F.array_distinct("us.root")) > 1).select("key", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "us")


def _near(units: DataFrame, nearest: bool) -> DataFrame:
    """(a, b, ra, rb): pairs of lines of different components that may be alike; with ``nearest`` one for each line and row.

    A pair that meets in several bands counts in the first alone.
    """

    def met(a: Column) -> Column:
        apart = lambda b: (b["own"] == F.col("j")) & (a["root"] != b["root"]) & ((F.col("i") < F.col("j")) | (a["h"] < b["h"]))
        here = lambda b: F.array_min(F.array_intersect(a["bands"], b["bands"])) == F.col("key")
        found = F.filter("us", lambda b: apart(b) & _may_be_alike(a, b) if nearest else apart(b) & _may_be_alike(a, b) & here(b))
        pair = lambda b: F.struct(_differ(a, b).alias("d"), a["h"].alias("a"), b["h"].alias("b"), a["root"].alias("ra"), b["root"].alias("rb"))
        pairs = F.transform(found, pair)
        return F.when(F.size(pairs) > 0, F.array(F.array_min(pairs))).otherwise(F.slice(pairs, 1, 0)) if nearest else pairs

    hits = F.flatten(F.transform(F.filter("us", lambda a: a["own"] == F.col("i")), met))
    turned = F.expr("e.a > e.b")
    ends = [F.when(turned, F.col(f"e.{x}")).otherwise(F.col(f"e.{y}")).alias(y) for x, y in (("b", "a"), ("a", "b"), ("rb", "ra"), ("ra", "rb"))]
    return units.select(F.explode(hits).alias("e")).select(*ends).distinct()


def _rest(members: DataFrame, parts: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b) roots of components that a link between members of one band joins; (key, h) are ``members``.

    Only bands whose members lie in several components are left to do. Such a band is dealt into blocks of about BLOCK
    lines, and every pair of blocks, or block with itself, is one row that compares the sketches of its lines in place.
    The pairs that a sketch can't rule out are verified like all others. In bands of several blocks each line first
    meets the one of its own block whose sketch is nearest, so that this grows with the members; lines whose components
    that doesn't join then meet all others.
    """
    rooted = members.join(parts.withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    rooted = settle(rooted.select("key", "h", "root"), "line-rooted")
    left = rooted.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    left = settle(left.select("key", F.expr(f"ceil(n / {BLOCK})").alias("blocks")), "line-left")
    dealt = settle(rooted.join(left, "key"), "line-dealt")
    sketches = settle(_sketched(found.join(dealt.select("h").distinct(), "h", "left_semi"), dealt), "line-sketches")
    first = settle(_near(_units(dealt.where("blocks > 1"), sketches, True), True), "line-nearest")
    joined = settle(_links(first, found).select("ra", "rb"), "line-joined")
    tops = connected_components(joined.toDF("a", "b"), "line-tops").withColumnRenamed("root", "top")
    merged = dealt.join(tops.withColumnRenamed("node", "root"), "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")
    apart = settle(_near(_units(merged, sketches, False), False), "line-apart")
    return joined.union(_links(apart, found).select("ra", "rb")).toDF("a", "b")


def line_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(occurrences, duplicates): all lines, and (h, h2, n, keep_doc, keep_line) of each text that occurs again or has a like."""
    occurrences = settle(_lines(rows).select("doc_id", "mark", "line_no", "h", "h2"), "lines")
    signed = settle(_signed(_lines(rows)), "line-signatures")
    bands = [F.xxhash64(F.lit(k), *(F.col(f"m{j}") for j in band)) for k, band in enumerate(BANDS)]
    keys = signed.select("h", F.explode(F.array(*bands)).alias("key"))
    # nearly all keys are there once, so grouping before the shuffle would find little and cost more
    shared = keys.repartition("key").groupBy("key").agg(F.count("*").alias("n"), F.min("h").alias("lo"), F.bit_xor("h").alias("x")).where("n > 1")
    # bands with the same members are one; two members are known from the least and the exclusive or of both
    shared = settle(shared.groupBy("n", "lo", "x").agg(F.min("key").alias("key")), "line-shared")
    few = shared.where("n = 2").select("lo", F.expr("lo ^ x"))
    large = shared.where("n > 2").select("key", F.col("lo").alias("center"))
    members = settle(_with(keys, large, ["key"], large.count()).select("key", "h", "center"), "line-members")
    # of more members each first meets the least
    stars = members.where("h <> center").select(F.col("center").alias("a"), F.col("h").alias("b"))
    pairs = settle(few.toDF("a", "b").union(stars).distinct(), "line-pairs")
    candidates = pairs.select(F.explode(F.array("a", "b")).alias("h")).union(members.select("h")).distinct().withColumn("compared", F.lit(True))
    places = occurrences.groupBy("h").agg(F.min(F.struct("doc_id", "line_no", "h2")).alias("at"), F.count("*").alias("n"))
    places = settle(places.join(candidates, "h", "left").where("n > 1 or compared"), "line-places")
    at = places.where("compared").select("h", "at.doc_id", "at.line_no", "at.h2")
    number = at.count()
    fetched = _lines(_with(rows, at.select("doc_id").distinct(), ["doc_id"], number) if number <= SMALL else rows)  # only documents with a candidate
    found = settle(_with(fetched, at, ["h", "h2", "doc_id", "line_no"], number).select("h", "line").dropDuplicates(["h"]), "line-candidates")
    parts = connected_components(_links(pairs, found), "line-components")
    # then all members of a band that aren't in one component yet meet each other
    more = connected_components(_rest(members.select("key", "h"), parts, found), "line-components")
    alone = more.select("node", "root").join(parts.select("node"), "node", "left_anti")
    joined = parts.join(more.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    parts = joined.select("node", F.coalesce("top", "root").alias("root")).union(alone)
    named = places.drop("compared").join(parts.withColumnRenamed("node", "h"), "h", "left").where("n > 1 or root is not null")
    named = settle(named.withColumn("root", F.coalesce("root", "h")), "line-named")
    keep = named.groupBy("root").agg(F.min("at").alias("keep"))
    keep = settle(keep, "line-keep")
    duplicates = settle(
        named.join(keep, "root").select("h", F.col("at.h2").alias("h2"), "n", F.col("keep.doc_id").alias("keep_doc"), F.col("keep.line_no").alias("keep_line")), "line-duplicates"
    )
    return occurrences, duplicates


def removals(rows: DataFrame) -> DataFrame:
    """(doc_id, mark, removed array<int>, kept_in array<long>): lines to go, and the document that keeps the like of each."""
    occurrences, duplicates = line_classes(rows)
    judged = occurrences.join(duplicates.drop("n"), ["h", "h2"])  # two tables, so that a skewed partition can be split
    gone = judged.where(~((F.col("doc_id") == F.col("keep_doc")) & (F.col("line_no") == F.col("keep_line"))))
    listed = gone.distinct().groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(F.struct("line_no", "keep_doc"))).alias("gone"))
    return listed.select("doc_id", "mark", F.col("gone.line_no").alias("removed"), F.col("gone.keep_doc").alias("kept_in"))


def line_dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, removed array<int> (line numbers from 0), kept_in array<long>.

    Lines are cut at \\n and compared without outer spaces. Two lines are alike when their sets of nine-character
    shingles have a Jaccard similarity of 0.8 or more; of each component of such links one line stays, the one with the
    smallest (doc_id, line number). Every other occurrence goes, copies included.

    1. MinHash values come from all shingles of a line: sixteen, the lines of an affine plane make twenty bands of four.
    2. Equal lines become one text by a hash of 64 bits. A line whose second hash isn't that of the text's first
       occurrence is another text with the same hash: it takes no part and stays. Hashes and positions are shuffled.
    3. Texts that share a band are candidates. A band of two is a pair. Of a larger band each member first
       meets the least, so pairs grow with the members; where that leaves it in several components, all its members of
       different components meet in blocks. There sizes and parity sketches rule out most pairs, none wrongly.
    4. The lines of candidates are fetched and compared by all their shingles, at the pair.
    5. ``graph.connected_components`` joins the links. By simulation, a pair at 0.8 shares no band in 0.3 % of cases, at
       0.85 in 0.03 %; all pairs that share one are compared, unless they are in one component already.

    Null and empty texts have one blank line; blank lines are always kept. Lines shorter than nine characters are alike
    only when equal. Rows that repeat an id and text are one document and keep the same lines. Rows with a null id take
    no part and keep all their lines. An empty table gives an empty result.
    """
    rows = text_rows(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    gone = removals(rows.select("doc_id", "text")).withColumnsRenamed({"doc_id": "gone_id", "mark": "gone_mark"})
    heads = rows.select("doc_id", "mark", F.size(F.split("text", "\n")).alias("n_lines"))
    joined = heads.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("mark") == F.col("gone_mark")), "left")
    empty = F.array().cast("array<int>")
    return joined.select(
        "doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"), F.coalesce("removed", empty).alias("removed"), F.coalesce("kept_in", F.array().cast("array<bigint>")).alias("kept_in")
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False) -> DataFrame:
    """``docs`` with the lines that ``line_dedup_report`` removes cut from the text; same columns.

    The same rows too, unless ``drop_emptied``: then a document that has lost lines and holds nothing but blank lines
    goes. Texts that lose no line, empty and null ones among them, always stay as they are.
    """
    gone = removals(text_rows(docs, id_col, text_col)).select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark"), "removed")
    text = docs[text_col]
    joined = docs.join(gone, docs[id_col].eqNullSafe(gone["gone_id"]) & (F.xxhash64(F.coalesce(text, F.lit(""))) == gone["gone_mark"]), "left")
    cut = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(gone["removed"], i)), "\n")
    new = F.when(gone["removed"].isNull(), text).otherwise(cut)
    if drop_emptied:
        joined = joined.where(gone["removed"].isNull() | (F.trim(F.translate(cut, "\n", "")) != ""))
    return joined.select(*(new.alias(c) if c == text_col else docs[c] for c in docs.columns))
