"""Conversation structure repair by an error-correcting Earley parser over role initials."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Nonterminals by name, terminals as role initials. The language is (s?(ua)+)?.
GRAMMAR = (
    ("Dialog", ()),
    ("Dialog", ("Turns",)),
    ("Turns", ("s", "Pair")),
    ("Turns", ("Pair",)),
    ("Turns", ("Turns", "Pair")),
    ("Pair", ("u", "a")),
)
GOAL = "Dialog"
RULES = {head: tuple(n for n, (h, _) in enumerate(GRAMMAR) if h == head) for head, _ in GRAMMAR}
#: Roles that a row can be given, or that can be inserted.
ROLES = {"u": "user", "a": "assistant"}
#: What edits cost; a truncated row that isn't deleted adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
WHITE = " \t\n\x0b\x0c\r"
#: Rows between two looks for edits that all readings agree on.
AGREE_EVERY = 64


class Chart:
    """The Earley chart of one conversation, of which the last set is kept.

    An item is a rule of GRAMMAR with the place of its dot. It holds the least (cost, audit) of the edits of all rows so
    far that bring the rule there, and what waits for the rule in the set where it began. Items that differ only in where they
    began are one: Pair is all that can repeat, and whatever waits for a Pair goes on alike, so the least outlives the rest.

    Error productions work where an item expects a terminal: a row with that initial is kept; any other is re-roled,
    where the terminal is in ROLES; an empty one is inserted without a row, likewise; or a row is deleted, which leaves the item as
    it is, as it does a finished dialog. Of two audits of equal cost over the same rows neither begins with the other (only
    inserts could follow, and they cost), so what is appended to both never changes which of them is the lesser.
    """

    def __init__(self):
        self.items: dict[tuple[int, int], tuple[int, str, dict]] = {(n, 0): (0, "", {}) for n in RULES[GOAL]}
        self._close(self.items)

    @staticmethod
    def _better(items: dict, key: tuple[int, int], item: tuple[int, str, dict]) -> bool:
        old = items.get(key)
        if old is not None and old[:2] <= item[:2]:
            return False
        items[key] = item
        return True

    def _close(self, items: dict) -> None:
        """Predict, complete and insert until no item gets better."""
        waits: dict[str, dict[tuple[int, int], dict]] = {}
        agenda = list(items)
        while agenda:
            n, dot = key = agenda.pop()
            cost, audit, origin = items[key]
            head, body = GRAMMAR[n]
            if dot == len(body):
                found = [((m, d + 1), (cost, audit, began)) for (m, d), began in origin.get(head, {}).items()]
            elif (symbol := body[dot]) in RULES:
                if key not in waits.setdefault(symbol, {}):
                    waits[symbol][key] = origin
                    # what was inserted whole in this set before anything waited for it
                    agenda += [k for k, i in items.items() if i[2] is waits and GRAMMAR[k[0]][0] == symbol and k[1] == len(GRAMMAR[k[0]][1])]
                found = [((m, 0), (cost, audit, waits)) for m in RULES[symbol]]
            elif symbol in ROLES:
                found = [((n, dot + 1), (cost + INSERT, audit + "I", origin))]
            else:
                found = []
            agenda += [k for k, item in found if self._better(items, k, item)]

    def scan(self, initial: str, must_go: bool, truncated: bool) -> None:
        """Take in the next row."""
        after: dict[tuple[int, int], tuple[int, str, dict]] = {}
        stays = TRUNCATED if truncated else 0
        for (n, dot), (cost, audit, origin) in self.items.items():
            head, body = GRAMMAR[n]
            symbol = body[dot] if dot < len(body) else None
            if symbol in RULES or (symbol is None and head != GOAL):
                continue  # what it predicted, or what it completed, stands for it
            self._better(after, (n, dot), (cost + DELETE, audit + "D", origin))
            if must_go or symbol is None:
                continue
            if symbol == initial:
                self._better(after, (n, dot + 1), (cost + stays, audit + "K", origin))
            elif symbol in ROLES:
                self._better(after, (n, dot + 1), (cost + REROLE + stays, audit + "R", origin))
        self._close(after)
        self.items = after

    def agreed(self) -> str:
        """The edits that all items begin with, which are taken off them; no later row can change these."""
        same = commonprefix([audit for _, audit, _ in self.items.values()])
        self.items = {k: (cost, audit[len(same) :], origin) for k, (cost, audit, origin) in self.items.items()}
        return same

    def best(self) -> tuple[int, str]:
        """(cost, audit) of the cheapest completed dialog, without the edits that ``agreed`` has given."""
        return min(self.items[n, len(GRAMMAR[n][1])][:2] for n in RULES[GOAL] if (n, len(GRAMMAR[n][1])) in self.items)


class Conversation:
    """One conversation's rows, taken in one by one: counts, the parse, and the repaired turns as soon as they are certain."""

    def __init__(self, emit: Callable[[str, str, str], None]):
        self.emit, self.chart, self.rows, self.audit = emit, Chart(), [], []
        self.blank = self.duplicate = self.truncated = self.illegal = self.taken = 0
        self.turns = self.cost = 0
        self.last = self.low = self.high = None
        self.next = "u"

    def row(self, turn: int | None, role: str, text: str, blank: bool, seen: bool, truncated: bool) -> None:
        initial = role[:1]
        if self.taken and (self.last, initial) not in LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        duplicate = seen and not blank
        truncated = truncated and not blank and not duplicate
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        self.chart.scan(initial, blank or duplicate, truncated)
        self.rows.append((role, text))
        self.taken += 1
        if self.taken % AGREE_EVERY == 0:
            self._apply(self.chart.agreed())

    def _apply(self, edits: str) -> None:
        at = 0
        for edit in edits:
            role, text = (ROLES[self.next], "") if edit == "I" else self.rows[at]
            at += edit != "I"
            if edit == "D":
                continue
            if edit == "R":
                role = ROLES[self.next]
            self.emit(edit, role, text)
            self.next = "a" if role[:1] == "u" else "u"
        del self.rows[:at]
        self.audit.append(edits)

    def finish(self) -> None:
        self.cost, edits = self.chart.best()
        self._apply(edits)

    def gaps(self) -> int:
        return 0 if self.high is None else self.high - self.low + 1 - self.turns


def _filled(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, n): rows with faults by crc32(``conv_id:turn``) % 20, alike ones as one row with their number n.

    0 drops a row, 1 empties its text, 2 takes ``[.!?]`` out of it, 3 repeats it, 4 makes its role user. Null roles and texts
    count as one space, null ids and turns in the hash too. A conversation with dropped rows has one row with n = 0.
    """
    rows = conversations.select(conversations[conv_col].alias("conv_id"), conversations[turn_col].cast("long").alias("turn"), _filled(conversations[role_col]).alias("role"), _filled(conversations[text_col]).alias("text"))
    fault = F.crc32(F.concat_ws(":", _filled(F.col("conv_id")), _filled(F.col("turn")))) % 20
    rows = rows.withColumn("fault", fault)
    text = F.when(F.col("fault").isin(0, 1), "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 0, "").when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    n = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
    made = rows.select("conv_id", F.when(F.col("fault") != 0, F.col("turn")).alias("turn"), role.alias("role"), text.alias("text"), n.alias("n"))
    return alike(made)


def alike(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): equal rows as one, with their number, before anything is shuffled; rows with n = 0 apart."""
    return rows.groupBy("conv_id", "turn", "role", "text", (F.col("n") == 0).alias("gone")).agg(F.sum("n").alias("n")).drop("gone")


def undamaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, n): rows as they are, null roles and texts as one space."""
    return alike(conversations.select(conversations[conv_col].alias("conv_id"), conversations[turn_col].cast("long").alias("turn"), _filled(conversations[role_col]).alias("role"), _filled(conversations[text_col]).alias("text"), F.lit(1).alias("n")))


def _in_order(rows: DataFrame) -> DataFrame:
    """Each conversation's rows together, by turn (nulls first), role and text, with their faults."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    first = Window.partitionBy("conv_id", "role", "text", F.col("n") == 0).orderBy(F.col("turn").asc_nulls_first())
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    return (
        rows.repartition("conv_id")
        .withColumn("seen", F.row_number().over(first) > 1)
        .withColumn("blank", bare == "")
        .withColumn("truncated", ~F.right(bare, F.lit(1)).isin(".", "!", "?"))
        .select("conv_id", "turn", "role", "text", "n", "blank", "seen", "truncated")
        .sortWithinPartitions(*order)
    )


def _conversations(batches: Iterator[pa.RecordBatch], start: Callable[[object], Conversation], end: Callable[[Conversation], Iterator]) -> Iterator:
    """Every conversation of a task in turn, row by row; at its end, and after each batch, what ``end`` has to give."""
    talk = key = None
    for batch in batches:
        for conv, turn, role, text, n, blank, seen, truncated in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
            if talk is None or conv != key:
                if talk is not None:
                    talk.finish()
                    yield from end(talk, True)
                talk, key = start(conv), conv
            for copy in range(n):
                talk.row(turn, role, text, blank, seen or copy > 0, truncated)
        if talk is not None:
            yield from end(talk, False)
    if talk is not None:
        talk.finish()
        yield from end(talk, True)


def _schema(rows: DataFrame, tail: str) -> T.StructType:
    return T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL(tail).fields])


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 1), role, text, edit (K kept, R re-roled, I inserted).

    ``rows`` is what ``damaged`` or ``undamaged`` gives. Conversations of which nothing is left have no row.
    """
    schema = _schema(rows, "place long, role string, text string, edit string")
    arrow_id = rows.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kept: list[tuple] = []
        place = 0
        now = None

        def emit(edit: str, role: str, text: str) -> None:
            nonlocal place
            place += 1
            kept.append((now, place, role, text, edit))

        def start(conv: object) -> Conversation:
            nonlocal place, now
            place, now = 0, conv
            return Conversation(emit)

        def end(talk: Conversation, done: bool) -> Iterator[pa.RecordBatch]:
            if len(kept) >= 1024 or (kept and not done):
                yield batch_of()

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*kept, strict=True))
            kept.clear()
            kinds = (to_arrow_type(arrow_id), pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)

        yield from _conversations(batches, start, end)
        if kept:
            yield batch_of()

    return _in_order(rows).mapInArrow(run, schema)


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` is what ``damaged`` or ``undamaged`` gives. Rows go by turn (nulls first), those of one turn by role and
    text. A row's first fault counts: blank, duplicate (role and text seen earlier), truncated (its last character that isn't
    white space is none of ``.!?``). The cheapest edits that give (system? (user assistant)+)? are found by ``Chart``;
    ties go to the ASCII-least audit. ``repaired_sha256`` is the hash of the repaired ``role:text`` lines that ``repaired_turns`` gives.

    Equal rows are counted before they are shuffled. A task streams its conversations in order and keeps of each the last
    set of the chart, the rows whose edits aren't certain yet, and the audit; a conversation of any length is sorted by
    Spark, which spills, and never held. The hash of a conversation's text, being one chain, is what keeps it in one task.

    Null ids are one conversation. A conversation without rows, all null turns (gaps 0), empty texts (blank) and very long ones, extra
    columns of whatever name, and an empty table (an empty result) are all allowed.
    """
    schema = _schema(rows, _REPORT)
    arrow_id = rows.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = (to_arrow_type(arrow_id), *[pa.int64()] * 6, pa.string(), pa.string())
        made: list[tuple] = []
        sha = now = None
        begun = False

        def emit(edit: str, role: str, text: str) -> None:
            nonlocal begun
            sha.update(f"\n{role}:{text}".encode() if begun else f"{role}:{text}".encode())
            begun = True

        def start(conv: object) -> Conversation:
            nonlocal sha, now, begun
            sha, now, begun = hashlib.sha256(), conv, False
            return Conversation(emit)

        def end(talk: Conversation, done: bool) -> Iterator[pa.RecordBatch]:
            if done:
                made.append((now, talk.gaps(), talk.blank, talk.duplicate, talk.truncated, talk.illegal, talk.cost, "".join(talk.audit), sha.hexdigest()))
            if len(made) >= 1024:
                yield batch_of()

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*made, strict=True))
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)

        yield from _conversations(batches, start, end)
        if made:
            yield batch_of()

    return _in_order(rows).mapInArrow(run, schema)
