"""Conversation repair: the cheapest edits by a rank-convergence parallel Viterbi.

A conversation is repaired into roles ``(s?(ua)+)?`` by keeping, re-naming and
deleting rows and by inserting empty ones. Four states tell where in the pattern
one stands: at the start, after s, after u, after a. The cost still to come is a
vector over the states, found backwards row by row. Rows are sorted and dealt by
ranges, so a conversation of any length spreads over tasks; what one task holds of
it is a segment, and a segment is cut into chunks. All chunks of a task run side by
side from speculative vectors; in fix-up passes a chunk runs again from what its
successor found, until its vectors differ from the earlier ones only by a constant
(vectors are kept with smallest entry 0, so until they are equal). The edit that
costs least, of equal ones the first by its letter, is then traced forwards along the
stitched vectors, each chunk from every state it may be entered in.

Only segments at the border of a task depend on other tasks. They answer for every
vector and state they may be given: at most two small rows per task, chained on the
driver, tell every task with which vector and in which state its part goes on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_batches
from quire.session import cut_lineage, discard

#: Costs of the edits, and of a truncated row that stays.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user or assistant row, from each state (the pattern leaves no choice).
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: Cost to come after the last row: nothing at the start and after an assistant, else what has to be inserted.
END = np.array([0, 2 * INSERT, INSERT, 0])
#: Stands for impossible: more than the rows of any task can cost.
FAR = 1 << 40
CHUNK = 64
#: First letters of the roles that the pattern knows; any other has the number 3.
LETTERS = "sua"
LEGAL = ("su", "ua", "au")
#: What doesn't count as a character of a text, and what a whole text ends with.
BLANKS, STOPS = " \t\n\x0b\x0c\r", (".", "!", "?")


def _new_rows(state: int, many: int) -> str:
    """The first letters of rows inserted from ``state`` on."""
    return ("ua" if NEXT[state] == USER else "au")[:many]


@dataclass
class Steps:
    """Rows of one task that need no forced deletion, in order, as costs per state."""

    go: np.ndarray  # n x 4: cheapest way along NEXT (kept or re-named)
    kept: np.ndarray  # n x 4: whether the row can keep its role there
    system: np.ndarray  # n: cost of keeping it as the system row (FAR if it is none)

    @classmethod
    def of(cls, letter: np.ndarray, truncated: np.ndarray) -> Steps:
        extra = np.where(truncated, TRUNCATED, 0)
        fits = letter[:, None] == np.where(NEXT == USER, LETTERS.index("u"), LETTERS.index("a"))
        return cls(np.where(fits, 0, RENAME) + extra[:, None], fits, np.where(letter == LETTERS.index("s"), extra, FAR))

    def take(self, rows: np.ndarray) -> Steps:
        return Steps(self.go[rows], self.kept[rows], self.system[rows])

    def before(self, row: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The costs before rows ``row`` (one per lane) if those after them are ``after``."""
        cost = np.minimum(DELETE + after, self.go[row] + after[:, NEXT])
        cost[:, START] = np.minimum(cost[:, START], self.system[row] + after[:, SYSTEM])
        return _inserted(cost)


def _inserted(cost: np.ndarray) -> np.ndarray:
    """``cost`` if rows may be inserted first."""
    out = cost.copy()
    for _ in range(2):  # two inserted rows lead through every state
        out = np.minimum(out, INSERT + out[:, NEXT])
    return out


class Chunks:
    """The rows of segments, cut into chunks of at most CHUNK rows: the vector before every row and what it was lowered by."""

    def __init__(self, steps: Steps, begin: np.ndarray, end: np.ndarray, after: np.ndarray) -> None:
        """``begin``, ``end``: the rows of each segment, none of them empty; ``after``: the vectors after their last rows."""
        many = -(-(end - begin) // CHUNK)
        self.segment = np.repeat(np.arange(len(begin)), many)
        number = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        self.begin = begin[self.segment] + number * CHUNK
        self.end = np.minimum(self.begin + CHUNK, end[self.segment])
        self.last = number == many[self.segment] - 1
        self.steps, n = steps, len(steps.system)
        self.before, self.fell = np.full((n, 4), -1, np.int64), np.zeros(n, np.int64)
        # Speculation: as if every chunk ended its conversation.
        self.after = np.where(self.last[:, None], after[self.segment], END)
        self.passes, lanes = 0, np.arange(len(self.begin))
        inner = np.flatnonzero(~self.last)
        while len(lanes):
            self._run(lanes)
            wanted = self.after.copy()
            wanted[inner] = self.before[self.begin[inner + 1]]
            lanes = np.flatnonzero((wanted != self.after).any(axis=1))
            self.after = wanted

    def _run(self, lanes: np.ndarray) -> None:
        """One pass of some chunks, each until its vectors equal those it has."""
        self.passes += 1
        row, first, vector = self.end[lanes] - 1, self.begin[lanes], self.after[lanes]
        while len(row):
            cost = self.steps.before(row, vector)
            low = cost.min(axis=1)
            vector = cost - low[:, None]
            changed = (self.before[row] != vector).any(axis=1)
            self.before[row], self.fell[row] = vector, low
            # Before a row whose vector stays the same the others stay the same too.
            go_on = changed & (row > first)
            row, first, vector = row[go_on] - 1, first[go_on], vector[go_on]

    def following(self) -> np.ndarray:
        """The vector after every row."""
        out = np.zeros_like(self.before)
        out[:-1] = self.before[1:]
        out[self.end - 1] = self.after
        return out

    def choices(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row and state: rows inserted first, the edit's letter (D, K, R as a code point), and the state after the row.

        Of the ways that cost least the first by its letters: D before I before K before R.
        """
        after, total, steps, n = self.following(), self.before + self.fell[:, None], self.steps, len(self.before)
        state, take = np.tile(np.arange(4), (n, 1)), np.arange(n)[:, None]
        inserted, edit, to = (np.zeros((n, 4), np.int64) for _ in range(3))
        open_ = np.ones((n, 4), bool)
        while open_.any():
            here = total[take, state]
            delete = DELETE + after[take, state] == here
            insert = ~delete & (INSERT + total[take, NEXT[state]] == here)
            system = (state == START) & (steps.system[:, None] + after[:, [SYSTEM]] == here)
            along = steps.go[take, state] + after[take, NEXT[state]] == here
            keep = system | along & steps.kept[take, state]
            done = open_ & ~insert
            edit[done] = np.where(delete, ord("D"), np.where(keep, ord("K"), ord("R")))[done]
            to[done] = np.where(delete, state, np.where(system, SYSTEM, NEXT[state]))[done]
            open_ = open_ & insert
            inserted[open_] += 1
            state = np.where(open_, NEXT[state], state)
        return inserted, edit, to

    def trace(self, to: np.ndarray, enter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state in which every row is reached, and in which every segment is left, if segments are entered in ``enter``."""
        n_chunks = len(self.begin)
        exits, row, lanes = np.tile(np.arange(4), (n_chunks, 1)), self.begin.copy(), np.arange(n_chunks)
        while len(lanes):  # every chunk from all four states
            exits[lanes] = to[row[lanes, None], exits[lanes]]
            row[lanes] += 1
            lanes = lanes[row[lanes] < self.end[lanes]]
        entry, left, state = np.zeros(n_chunks, np.int64), enter.copy(), 0
        for c in range(n_chunks):
            entry[c] = state if c and not self.last[c - 1] else enter[self.segment[c]]
            state = left[self.segment[c]] = exits[c, entry[c]]
        reached, row, lanes, state = np.zeros(len(to), np.int64), self.begin.copy(), np.arange(n_chunks), entry
        while len(lanes):
            reached[row[lanes]] = state[lanes]
            state[lanes] = to[row[lanes], state[lanes]]
            row[lanes] += 1
            lanes = lanes[row[lanes] < self.end[lanes]]
        return reached, left


class Part:
    """The rows of one task in order; ``live`` are those that needn't be deleted, ``begin`` and ``end`` the segments' rows among them."""

    def __init__(self, rows: pa.Table) -> None:
        self.conv = rows.column("conv_id").to_pylist()
        self.at, self.letter = rows.column("at").to_numpy(), rows.column("letter").to_numpy()
        forced, truncated = (rows.column(c).to_numpy() for c in ("forced", "truncated"))
        same = np.array([a == b for a, b in zip(self.conv, self.conv[1:])], bool)
        self.start = np.flatnonzero(np.r_[True, ~same])
        self.live = np.flatnonzero(~forced)
        self.steps = Steps.of(self.letter[self.live], truncated[self.live])
        cut = np.searchsorted(self.live, np.r_[self.start, len(self.conv)])
        self.begin, self.end = cut[:-1], cut[1:]

    def border(self) -> dict:
        """What other tasks need: the conversations at both ends, letters, and how the segments there answer."""
        last = len(self.start) - 1
        return {
            "first": self.conv[0], "last": self.conv[-1], "one": not last, "first_letter": int(self.letter[0]), "last_letter": int(self.letter[-1]),
            "first_costs": self.costs(0).tolist(), "last_costs": (self.costs(last) if last else self.costs(0)).tolist(),
        }

    def costs(self, segment: int) -> np.ndarray:
        """4 x 4: the least cost of a segment from each state to each.

        To the start and to the state after s only deletions lead; the other two columns are vectors
        found like any other, from those of what comes after if only that state goes on.
        """
        rows = np.arange(self.begin[segment], self.end[segment])
        n = len(rows)
        out = np.full((4, 4), FAR)
        out[START, START] = out[SYSTEM, SYSTEM] = DELETE * n
        if n:
            out[START, SYSTEM] = min(FAR, DELETE * (n - 1) + self.steps.system[rows].min())
        for q in (USER, ASSISTANT):
            after = np.full((1, 4), FAR)
            after[0, q] = 0
            after = _inserted(after)
            out[:, q] = after[0]
            if n:
                chunks = Chunks(self.steps.take(rows), np.array([0]), np.array([n]), after)
                out[:, q] = chunks.before[0] + chunks.fell.sum()
        return out

    def solve(self, given: dict, segments: np.ndarray) -> tuple[np.ndarray, Chunks | None]:
        """Those of ``segments`` with living rows, and their chunks; the last segment goes on with ``given["after"]``."""
        some = segments[self.end[segments] > self.begin[segments]]
        if not len(some):
            return some, None
        after = np.tile(END, (len(some), 1))
        after[some == len(self.start) - 1] = given["after"]
        return some, Chunks(self.steps, self.begin[some], self.end[some], after)

    def exits(self, given: dict) -> dict:
        """In which state the first and the last segment are left, by the state they are entered in."""
        out = {}
        for name, segment in (("first_exits", 0), ("last_exits", len(self.start) - 1)):
            some, chunks = self.solve(given, np.array([segment]))
            to = chunks.choices()[2] if chunks else None
            out[name] = [int(chunks.trace(to, np.array([q]))[1][0]) if chunks else q for q in range(4)]
        return out

    def edits(self, given: dict) -> pa.RecordBatch:
        """What happens to every row."""
        n = len(self.at)
        edit, state, to, inserted = np.full(n, ord("D")), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        left = np.zeros(len(self.start), np.int64)
        left[0] = given["enter"]
        some, chunks = self.solve(given, np.arange(len(self.start)))
        if chunks:
            many, letters, goes = chunks.choices()
            reached, left[some] = chunks.trace(goes, left[some])
            k = np.arange(len(self.live))
            edit[self.live], inserted[self.live] = letters[k, reached], many[k, reached]
            state[self.live], to[self.live] = reached, goes[k, reached]
        ends = np.zeros(n, bool)
        ends[np.r_[self.start[1:], n] - 1] = True
        ends[-1] &= not given["goes_on"]
        tail = np.zeros(n, np.int64)
        tail[np.r_[self.start[1:], n] - 1] = left
        names = [_new_rows(q, int(END[q]) // INSERT) for q in range(4)]
        first = np.zeros(n, bool)
        first[self.start] = True
        before = np.r_[given["letter_before"], self.letter[:-1]]
        legal = np.isin(before * 4 + self.letter, [LETTERS.index(a) * 4 + LETTERS.index(b) for a, b in LEGAL])
        begins = first.copy()
        begins[0] &= given["letter_before"] < 0
        role = np.where(edit == ord("R"), np.where(to == USER, "user", "assistant"), "")
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.at), pa.array([chr(e) for e in edit]), pa.array([_new_rows(q, m) for q, m in zip(state.tolist(), inserted.tolist())]),
                pa.array(role.tolist()), pa.array([names[q] if e else "" for e, q in zip(ends.tolist(), tail.tolist())]), pa.array(~begins & ~legal),
            ],
            names=["at", "edit", "inserted", "new_role", "appended", "illegal"],
        )


def _by_part(slim: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` over the rows of every part, in order; a task holds the few numbers per row of one part at a time."""

    def stream(batches):
        current, waiting = None, []
        for batch in batches:
            part = batch.column("part").to_numpy()
            cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(part)]):
                if waiting and part[a] != current:
                    yield from fn(int(current), pa.Table.from_batches(waiting))
                    waiting = []
                current = part[a]
                waiting.append(batch.slice(a, b - a))
        if waiting:
            yield from fn(int(current), pa.Table.from_batches(waiting))

    return slim.repartition("part").sortWithinPartitions("part", "at").mapInArrow(stream, schema)


_BORDER = pa.schema([
    ("part", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("one", pa.bool_()), ("first_letter", pa.int64()), ("last_letter", pa.int64()),
    ("first_costs", pa.list_(pa.list_(pa.int64()))), ("last_costs", pa.list_(pa.list_(pa.int64()))),
])
_EXITS = pa.schema([("part", pa.int64()), ("first_exits", pa.list_(pa.int64())), ("last_exits", pa.list_(pa.int64()))])


def chained(slim: DataFrame) -> dict[int, dict]:
    """Per part: the vector after it, the state it is entered in, the letter before it (-1: none), and whether its last conversation goes on.

    One row per part reaches the driver, whatever the number of rows.
    """

    def border(part: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from pa.Table.from_pylist([{"part": part, **Part(rows).border()}], schema=_BORDER).to_batches()

    parts = sorted(_by_part(slim, border, "part bigint, first bigint, last bigint, one boolean, first_letter bigint, last_letter bigint, first_costs array<array<bigint>>, last_costs array<array<bigint>>").collect(), key=lambda r: r["part"])
    given = {r["part"]: {"after": END, "enter": START, "letter_before": -1, "goes_on": False} for r in parts}
    for here, there in reversed(list(zip(parts, parts[1:]))):
        if here["last"] == there["first"]:
            after = given[there["part"]]["after"] if there["one"] else END
            cost = (np.array(there["first_costs"]) + after).min(axis=1)
            given[here["part"]] |= {"after": cost - cost.min(), "goes_on": True}
            given[there["part"]] |= {"letter_before": here["last_letter"]}
    if not any(g["goes_on"] for g in given.values()):
        return given

    def exits(part: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if given[part]["goes_on"]:
            yield from pa.Table.from_pylist([{"part": part, **Part(rows).exits(given[part])}], schema=_EXITS).to_batches()

    left = {r["part"]: r for r in _by_part(slim, exits, "part bigint, first_exits array<bigint>, last_exits array<bigint>").collect()}
    for here, there in zip(parts, parts[1:]):
        if given[here["part"]]["goes_on"]:
            enter = given[here["part"]]["enter"] if here["one"] else START
            given[there["part"]] |= {"enter": left[here["part"]]["last_exits"][enter]}
    return given


# Operators


def _conversations(rows: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """The rows in order, with ``at``: larger for later ones, its upper bits the part of the table."""
    space = F.lit(" ")
    named = rows.select(
        F.col(conversation).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role).cast("string"), space).alias("role"), F.coalesce(F.col(text).cast("string"), space).alias("text"),
    ).withColumn("_key", F.md5("text"))
    # The number makes rows that are alike in everything separable; which of them comes first makes no difference.
    stored = cut_lineage(named.withColumn("_row", F.monotonically_increasing_id()))
    order = ["conv_id", "turn", "role", "_key", "_row"]
    out = cut_lineage(stored.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row").withColumn("at", F.monotonically_increasing_id()))
    discard(stored)
    return out


def repair_conversations(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every row (conv_id, turn, role, text) with its ``fault`` and ``edit``, and how the repaired conversation reads.

    Adds ``at`` (larger for later rows), ``fault`` (blank, duplicate, truncated or null),
    ``illegal`` (its role's first letter may not follow that of the row before), ``edit``
    (K keep, R re-name, D delete), ``inserted`` (first letters of the empty rows put before
    it), ``new_role`` (its role after the edit, empty if deleted) and ``appended`` (first letters of
    the rows put after it; last rows only). Rows are read by turn, nulls first, and within
    a turn by role and the MD5 of the text. A null role or text counts as one space; a
    text without a character is blank, and an exact repetition of an earlier row of the
    conversation a duplicate; both are deleted. Letters are those the roles begin with,
    as they are written. Rows with a null conversation form one of their own. Repeated rows
    are rows. Other columns are ignored; an empty table gives an empty one. A conversation
    may have any number of rows: they are sorted and solved in as many tasks as they fill.
    """
    ordered = _conversations(rows, conversation, turn, role, text)
    bare = F.btrim("text", F.lit(BLANKS))
    first = ordered.groupBy("conv_id", "role", "_key").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("_first"))
    fault = F.when(bare == "", "blank").when(F.col("_first").isNull(), "duplicate").when(~F.substring(bare, -1, 1).isin(*STOPS), "truncated")
    slim = cut_lineage(
        ordered.select("at", "conv_id", "role", bare.alias("_bare"), F.col("text")).join(first, "at", "left").select(
            F.shiftright("at", 33).alias("part"), "at", "conv_id", F.pmod(F.instr(F.lit(LETTERS), F.substring("role", 1, 1)) + 3, F.lit(4)).cast("bigint").alias("letter"), fault.alias("fault"),
        )
    )
    numbers = slim.select("part", "at", "conv_id", "letter", F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("forced"), F.coalesce(F.col("fault") == "truncated", F.lit(False)).alias("truncated"))
    given = chained(numbers)

    def edit(part: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        yield Part(rows).edits(given[part])

    edits = _by_part(numbers, edit, "at bigint, edit string, inserted string, new_role string, appended string, illegal boolean")
    return ordered.drop("_key").join(slim.select("at", "fault"), "at").join(edits, "at").withColumn("new_role", F.when(F.col("edit") == "K", F.col("role")).otherwise(F.col("new_role")))


_DIGEST = pa.schema([(c, pa.int64()) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())])
_NAMES = {"u": "user", "a": "assistant"}


class _Digest:
    """What is known of one conversation from its rows so far, read in order; texts go into the hash and are not kept."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.turns, self.first, self.turn = conv_id, 0, None, None
        self.count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.cost, self.audit, self.hash, self.lines = 0, [], hashlib.sha256(), 0

    def _line(self, role: str, text: str) -> None:
        self.hash.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
        self.lines += 1

    def add(self, turn, text, fault, edit, inserted, new_role, appended, illegal) -> None:
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn, self.turns = turn, self.turns + 1
        if fault:
            self.count[fault] += 1
        self.count["illegal"] += illegal
        self.audit.append("I" * len(inserted) + edit + "I" * len(appended))
        self.cost += INSERT * len(inserted + appended) + {"D": DELETE, "K": 0, "R": RENAME}[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
        for x in inserted:
            self._line(_NAMES[x], "")
        if edit != "D":
            self._line(new_role, text)
        for x in appended:
            self._line(_NAMES[x], "")

    def row(self) -> dict:
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return {"conv_id": self.conv_id, "gaps": gaps, **self.count, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def repair_digest(repaired: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for every conv_id of ``conversations``: counts of faults, cost, edits and the hash of the repaired conversation.

    The hash and the edits of a conversation are one value, so its rows stream through one task
    in order; besides them nothing is kept but a letter per edit.
    """

    def stream(batches):
        current = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "text", "fault", "edit", "inserted", "new_role", "appended", "illegal")]
            done = []
            for conv_id, *row in zip(*columns):
                if current is None or conv_id != current.conv_id:
                    if current is not None:
                        done.append(current.row())
                    current = _Digest(conv_id)
                current.add(*row)
            yield from pa.Table.from_pylist(done, schema=_DIGEST).to_batches()
        if current is not None:
            yield from pa.Table.from_pylist([current.row()], schema=_DIGEST).to_batches()

    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = ", ".join(f"{c} bigint" for c in ("conv_id", *numbers)) + ", audit string, repaired_sha256 string"
    found = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(stream, schema).withColumnRenamed("conv_id", "_conv_id")
    every = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv_id")), "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with faults: by crc32 of conv_id:turn modulo 20 one is dropped, emptied, robbed of its stops, repeated, or ascribed to the user."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind")).where("_kind <> 0").select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


# SQL: the ways to all four states forwards, each with its least edits


def _way(source: str, cost: str, letter: str, line: str | None = None) -> str:
    """A way (cost, edits, lines) that goes on from ``source``; ways compare by cost and then by their edits."""
    lines = f"{source}.t" if line is None else f"{source}.t || CASE WHEN {source}.t = '' THEN '' ELSE chr(10) END || {line}"
    return f"{{'c': {source}.c + {cost}, 'a': {source}.a || '{letter}', 't': {lines}}}"


def _with_new_rows(source: str) -> str:
    """The states of ``source`` if rows may be inserted: twice one more."""
    for _ in range(2):
        users = ", ".join(_way(q, str(INSERT), "I", "'user:'") for q in ("s0", "s1", "s3"))
        source = f"SELECT conv_id, i, s0, s1, least(s2, {users}) AS s2, least(s3, {_way('s2', str(INSERT), 'I', chr(39) + 'assistant:' + chr(39))}) AS s3 FROM ({source})"
    return source


def _twin() -> str:
    far = f"{{'c': {FAR}::BIGINT, 'a': '', 't': ''}}"
    late, live = f"(CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END)", "coalesce(fault, '') NOT IN ('blank', 'duplicate')"

    def kept(state: str, letter: str) -> str:
        return f"CASE WHEN {live} AND letter = '{letter}' THEN {_way('p.' + state, late, 'K', 'role || chr(58) || text')} ELSE {far} END"

    def renamed(state: str, role: str) -> str:
        return f"CASE WHEN {live} THEN {_way('p.' + state, f'{RENAME} + {late}', 'R', chr(39) + role + ':' + chr(39) + ' || text')} ELSE {far} END"

    gone = [_way(f"p.{q}", str(DELETE), "D") for q in ("s0", "s1", "s2", "s3")]
    to_user = ", ".join(f"{kept(q, 'u')}, {renamed(q, 'user')}" for q in ("s0", "s1", "s3"))
    step = f"""SELECT p.conv_id, f.i, {gone[0]} AS s0, least({gone[1]}, {kept('s0', 's')}) AS s1, least({gone[2]}, {to_user}) AS s2,
               least({gone[3]}, {kept('s2', 'a')}, {renamed('s2', 'assistant')}) AS s3 FROM p JOIN f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = p.i + 1"""
    start = f"SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS s0, {far} AS s1, {far} AS s2, {far} AS s3 FROM g"
    crc = "list_reduce(list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT), lambda c, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295::BIGINT)"
    blanks = " || ".join(f"chr({ord(c)})" for c in BLANKS)
    return rf"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
x AS (SELECT *, xor({crc}, 4294967295) % 20 AS kind FROM o),
w AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM x WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, trim(text, {blanks}) AS bare, left(role, 1) AS letter FROM w),
f AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                     WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
             coalesce(lag(letter) OVER (PARTITION BY conv_id ORDER BY i) || letter NOT IN {LEGAL}, false) AS illegal FROM n),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate,
             count_if(fault = 'truncated') AS truncated, count_if(illegal) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
p AS ({_with_new_rows(start)} UNION ALL {_with_new_rows(step)}),
b AS (SELECT g.*, least(p.s0, p.s3) AS way FROM g JOIN p ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = g.n)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(way.c, 0)::BIGINT AS cost, coalesce(way.a, '') AS audit, sha256(coalesce(way.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN b ON c.conv_id IS NOT DISTINCT FROM b.conv_id"""


SQL = _twin()
