"""Repair of conversation structure by Knuth's lightest-derivation agenda.

**Edits.**  Rows of a conversation in order: Keep (cost 0), Rerole to user or assistant
(2), Delete (3; forced for blank and duplicate rows), Insert an empty user or assistant row
anywhere (2); a truncated row that stays adds 1.  The initials of the roles left must match
``(s?(ua)+)?``.  The cheapest edits win, among them the least audit (the edits' initials).

**Deductions.**  An item (i, state) says that the first i rows have been turned into a legal
prefix that ends in ``state`` (nothing yet, after the system row, after user, after
assistant).  Every edit is a hyperedge from item to item with the function (cost, audit) ->
(cost + c, audit + initial).  It is monotone and superior: a result is never below its
antecedent, as the cost does not fall and a prefix sorts first (two derivations of one item
with equal cost are never prefixes of each other, for inserts cost).  So Knuth's agenda pops
items in ascending order, each final when popped, until the goal item (all rows, in
"nothing yet" or "after assistant") is.  Solutions depend on a row only through its
class (initial, forced, truncated), so tasks remember those of recent class strings.

**Distribution.**  Rows are range partitioned by (conversation, turn, role, hash of the text, row),
so that a conversation of any size is dealt over tasks, and sorted there.  A conversation inside one
partition and of at most ``SEGMENT`` rows is solved at once.  What may go on in
the next partition, or is longer, becomes segments: rows seen in earlier partitions are found by a
join on their hashes; agendas give the lightest derivation between every pair of
states of a segment; a pass over the segments' results, not their texts, composes them;
each segment then applies its part.  Only the hash of the repaired text goes through
a long conversation's texts in order, one segment in memory at a time.

Defined cases: null roles and texts are one space; a null conversation id is a conversation of
its own; rows sort by turn (nulls first), then role, then MD5 of the text; an empty role is
no legal initial; rows marked dropped only make their conversation known; a conversation
without rows has zeros, an empty audit and the hash of the empty string; extra columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.token_files import fresh_folder
from riskframe.session import cut_lineage

SEGMENT = 256
SPACE = " \t\n\v\f\r"
ROLES = {"u": "user", "a": "assistant"}
#: What may follow each state: nothing yet (0), after s, after u, after a.
NEXT = {"0": "su", "s": "u", "u": "a", "a": "u"}
GOALS = ("0", "a")
#: Row classes: lower case is complete, upper case truncated, '-' must be deleted.
FORCED = "-"


def mark(role: str, complete: bool) -> str:
    """Class of a row that may stay."""
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return initial if complete else initial.upper()


def deductions(marks: str, i: int, state: str) -> Iterator[tuple[int, str, int, str]]:
    """Hyperedges from the item (i, state): added cost, initial, and the item reached."""
    follow = NEXT[state]
    for role in follow:
        if role in ROLES:
            yield 2, "I", i, role
    if i == len(marks):
        return
    yield 3, "D", i + 1, state
    if marks[i] == FORCED:
        return
    initial, late = marks[i].lower(), int(marks[i].isupper())
    if initial in follow:
        yield late, "K", i + 1, initial
    for role in follow:
        if role in ROLES:
            yield 2 + late, "R", i + 1, role


def agenda(marks: str, entry: str = "0", goals: tuple[str, ...] = GOALS, every: bool = False) -> dict[str, tuple[int, str]]:
    """Lightest (cost, audit) of the goal item reached first, or of ``every`` goal state."""
    queue, final, found = [(0, "", 0, entry)], set(), {}
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if (i, state) in final:
            continue
        final.add((i, state))
        if i == len(marks) and state in goals:
            found[state] = (cost, audit)
            if not every or len(found) == len(goals):
                break
        for more, initial, j, reached in deductions(marks, i, state):
            if (j, reached) not in final:
                heapq.heappush(queue, (cost + more, audit + initial, j, reached))
    return found


@lru_cache(maxsize=100_000)
def solve(marks: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return next(iter(agenda(marks).values()))


@lru_cache(maxsize=2_000)
def between(marks: str) -> dict[str, dict[str, tuple[int, str]]]:
    """Lightest derivation of a segment from every state to every state it can reach."""
    return {entry: agenda(marks, entry, tuple(NEXT), every=True) for entry in NEXT}


def apply(turns: list[tuple[str, str]], audit: str, entry: str = "0") -> list[tuple[str, str]]:
    """Rows left by the edits of an audit; the state before each tells its role."""
    out, rows, state = [], iter(turns), entry
    for edit in audit:
        if edit == "I":
            state = "a" if state == "u" else "u"
            out.append((ROLES[state], ""))
            continue
        role, text = next(rows)
        if edit == "R":
            state = "a" if state == "u" else "u"
            out.append((ROLES[state], text))
        elif edit == "K":
            state = role[0]
            out.append((role, text))
    return out


COUNTS = ("blank", "duplicate", "truncated", "illegal")
TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
PIECE = [("key", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("closed", pa.bool_()), ("low", pa.int64()), ("high", pa.int64()),
         ("n_turns", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("first", pa.string()), ("last", pa.string()),
         ("marks", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("turns", TURNS), ("hashes", pa.list_(pa.binary()))]
PIECE_SQL = ("key string, part int, seq int, closed boolean, low long, high long, n_turns long, blank long, duplicate long, truncated long, "
             "illegal long, first string, last string, marks string, cost long, audit string, "
             "turns array<struct<role:string,text:string>>, hashes array<binary>")


class Piece:
    """Rows of one conversation that follow each other, at most SEGMENT."""

    def __init__(self):
        self.turns, self.marks, self.hashes = [], [], []
        self.low = self.high = None
        self.n_turns = 0
        self.count = dict.fromkeys(COUNTS, 0)

    def add(self, turn: int | None, role: str, text: str, seen: set[bytes]) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.n_turns = turn, self.n_turns + 1
        if self.turns and self.turns[-1][0][:1] + role[:1] not in ("su", "ua", "au"):
            self.count["illegal"] += 1
        body = text.rstrip(SPACE)
        # the length of the role keeps ("ab", "c") and ("a", "bc") apart
        mine = hashlib.md5(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()
        complete = body[-1:] in (".", "!", "?")
        if not body:
            fault = "blank"
        elif mine in seen:
            fault = "duplicate"
        else:
            fault = None if complete else "truncated"
        if fault:
            self.count[fault] += 1
        forced = fault in ("blank", "duplicate")
        self.marks.append(FORCED if forced else mark(role, complete))
        self.hashes.append(None if forced else mine)
        self.turns.append((role, text))
        seen.add(mine)

    def row(self, key: str, part: int, seq: int, closed: bool) -> dict:
        marks = "".join(self.marks)
        cost, audit = solve(marks) if closed else (None, None)
        turns = apply(self.turns, audit) if closed else self.turns
        return {"key": key, "part": part, "seq": seq, "closed": closed, "low": self.low, "high": self.high, "n_turns": self.n_turns,
                **self.count, "first": self.turns[0][0][:1] if self.turns else None, "last": self.turns[-1][0][:1] if self.turns else None,
                "marks": marks, "cost": cost, "audit": audit, "turns": [{"role": r, "text": t} for r, t in turns],
                "hashes": None if closed else self.hashes}


def _batched(rows: Iterator[dict], schema: list) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, 200)):
        yield pa.RecordBatch.from_pylist(some, schema=pa.schema(schema))


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in names))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> solved conversations, and segments of those that may go on elsewhere."""
    part = TaskContext.get().partitionId()

    def made() -> Iterator[dict]:
        key = piece = None
        seq, first, seen = 0, True, set()
        for now, turn, role, text, dropped in _rows(batches, "key", "turn", "role", "text", "dropped"):
            if now != key:
                if piece:
                    # the partition's first conversation may have begun in the one before
                    yield piece.row(key, part, seq, closed=seq == 0 and not first)
                    first = False
                key, piece, seq, seen = now, Piece(), 0, set()
            elif len(piece.turns) >= SEGMENT:
                yield piece.row(key, part, seq, closed=False)
                piece, seq = Piece(), seq + 1
            if not dropped:
                piece.add(turn, role, text, seen)
        if piece:
            yield piece.row(key, part, seq, closed=False)    # the last may go on in the next
    return _batched(made(), PIECE)


SEGMENTS = [("key", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("n_turns", pa.int64()),
            *((c, pa.int64()) for c in COUNTS), ("first", pa.string()), ("last", pa.string()), ("marks", pa.string()),
            ("steps", pa.list_(pa.struct([("entry", pa.string()), ("exit", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])))]
SEGMENTS_SQL = ("key string, part int, seq int, low long, high long, n_turns long, blank long, duplicate long, truncated long, illegal long, "
                "first string, last string, marks string, steps array<struct<entry:string,exit:string,cost:long,audit:string>>")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with the hashes that earlier partitions hold -> lightest steps between states."""
    names = ["key", "part", "seq", "low", "high", "n_turns", *COUNTS, "first", "last"]

    def made() -> Iterator[dict]:
        for *plain, marks, hashes, earlier in _rows(batches, *names, "marks", "hashes", "earlier"):
            row, earlier, now = dict(zip(names, plain)), set(earlier or ()), list(marks)
            for k, h in enumerate(hashes or ()):
                if h is not None and h in earlier:
                    row["truncated"] -= now[k].isupper()
                    row["duplicate"] += 1
                    now[k] = FORCED
            row["marks"] = "".join(now)
            row["steps"] = [{"entry": p, "exit": q, "cost": c, "audit": a}
                            for p, reached in between(row["marks"]).items() for q, (c, a) in reached.items()]
            yield row
    return _batched(made(), SEGMENTS)


CHAIN = [("key", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("entry", pa.string()), ("audit", pa.string()),
         ("gaps", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("cost", pa.int64())]
CHAIN_SQL = ("key string, part int, seq int, entry string, audit string, gaps long, blank long, duplicate long, truncated long, "
             "illegal long, cost long")


class Chain:
    """Composition of a conversation's segments, in order."""

    def __init__(self, key: str):
        self.key = key
        self.best = {"0": (0, "")}
        self.back = []                           # per segment: exit -> (entry, audit of the step)
        self.low = self.high = self.last = None
        self.n_turns = 0
        self.count = dict.fromkeys(COUNTS, 0)

    def add(self, row: dict) -> None:
        if row["low"] is not None:
            self.low = row["low"] if self.low is None else self.low
            self.n_turns += row["n_turns"] - (row["low"] == self.high)
            self.high = row["high"]
        for c in COUNTS:
            self.count[c] += row[c]
        if row["first"] is not None:
            if self.last is not None and self.last + row["first"] not in ("su", "ua", "au"):
                self.count["illegal"] += 1
            self.last = row["last"]
        best, back = {}, {}
        for s in row["steps"]:
            if s["entry"] in self.best:
                cost, audit = self.best[s["entry"]]
                if (new := (cost + s["cost"], audit + s["audit"])) < best.get(s["exit"], (float("inf"), "")):
                    best[s["exit"]], back[s["exit"]] = new, (s["entry"], s["audit"])
        self.best = best
        self.back.append((row["part"], row["seq"], back))

    def rows(self) -> Iterator[dict]:
        """The conversation (no part), then the entry state and audit of each segment."""
        (cost, audit), state = min((self.best[g], g) for g in GOALS if g in self.best)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.n_turns
        yield {"key": self.key, "audit": audit, "gaps": gaps, **self.count, "cost": cost}
        for part, seq, back in reversed(self.back):
            state, own = back[state]
            yield {"key": self.key, "part": part, "seq": seq, "entry": state, "audit": own}


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [n for n, _ in SEGMENTS]

    def made() -> Iterator[dict]:
        chain = None
        for values in _rows(batches, *names):
            row = dict(zip(names, values))
            if chain is None or row["key"] != chain.key:
                if chain:
                    yield from chain.rows()
                chain = Chain(row["key"])
            chain.add(row)
        if chain:
            yield from chain.rows()
    return _batched(made(), CHAIN)


APPLIED = [("key", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("turns", TURNS)]
APPLIED_SQL = "key string, part int, seq int, turns array<struct<role:string,text:string>>"


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made() -> Iterator[dict]:
        for key, part, seq, turns, entry, audit in _rows(batches, "key", "part", "seq", "turns", "entry", "audit"):
            left = apply([(t["role"], t["text"]) for t in turns], audit, entry)
            yield {"key": key, "part": part, "seq": seq, "turns": [{"role": r, "text": t} for r, t in left]}
    return _batched(made(), APPLIED)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order -> SHA-256 of each conversation's ``role:text`` lines."""
    def made() -> Iterator[dict]:
        key = sha = None
        for now, turns in _rows(batches, "key", "turns"):
            if now != key:
                if sha:
                    yield {"key": key, "repaired_sha256": sha.hexdigest()}
                key, sha, glue = now, hashlib.sha256(), b""
            for t in turns:
                sha.update(glue + f"{t['role']}:{t['text']}".encode())
                glue = b"\n"
        if sha:
            yield {"key": key, "repaired_sha256": sha.hexdigest()}
    return _batched(made(), [("key", pa.string()), ("repaired_sha256", pa.string())])


def damaged(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
            role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Reproducible faults, by crc32 of ``id:turn`` modulo 20: 0 drops a row (it stays, marked),
    1 empties it, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(id_col), F.lit(":"), space(turn_col))) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate(space(text_col), ".!?", "")).otherwise(space(text_col))
    return conversations.withColumn("_kind", kind).select(
        F.col(id_col), F.col(turn_col), F.when(F.col("_kind") == 4, "user").otherwise(space(role_col)).alias(role_col),
        text.alias(text_col), (F.col("_kind") == 0).alias("dropped"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


@dataclass
class Repair:
    """``summary``: one row per conversation; ``turns``: its repaired rows, in segments by
    (part, seq)."""

    summary: DataFrame
    turns: DataFrame


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", dropped: Column | None = None) -> Repair:
    """Faults, cheapest repair and repaired rows of every conversation."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))
    flat = rows.select(name.alias("key"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
                       F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
                       (F.lit(False) if dropped is None else F.coalesce(dropped, F.lit(False))).alias("dropped"))
    order = ["key", F.col("turn").asc_nulls_first(), "role", "text_hash", "row"]
    dealt = flat.withColumns({"text_hash": F.md5("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(
        parts, *order).sortWithinPartitions(*order)
    folder = fresh_folder(spark, "conversations")
    dealt.select("key", "turn", "role", "text", "dropped").mapInArrow(_pieces, PIECE_SQL).write.parquet(folder)
    pieces = spark.read.parquet(folder)
    closed, open_ = pieces.where("closed"), pieces.where("NOT closed")

    # rows that an earlier partition holds; within a partition they are known already
    at = ["key", "part", "seq"]
    hashes = open_.select(*at, F.explode("hashes").alias("hash")).where("hash IS NOT NULL")
    firsts = hashes.groupBy("key", "hash").agg(F.min("part").alias("first_part"), F.count("*").alias("n")).where("n > 1").drop("n")
    earlier = hashes.join(firsts, ["key", "hash"]).where("part > first_part").groupBy(*at).agg(F.collect_list("hash").alias("earlier"))
    plain = open_.select(*[n for n, _ in SEGMENTS if n != "steps"], "hashes")
    segments = plain.join(earlier, at, "left").mapInArrow(_segments, SEGMENTS_SQL)
    chain = cut_lineage(segments.repartition(parts, "key").sortWithinPartitions(*at).mapInArrow(_chain, CHAIN_SQL))
    fixed = open_.select(*at, "turns").join(chain.where("part IS NOT NULL").select(*at, "entry", "audit"), at).mapInArrow(
        _applied, APPLIED_SQL)
    sha = fixed.repartition(parts, "key").sortWithinPartitions(*at).mapInArrow(_hashed, "key string, repaired_sha256 string")

    counts = [*COUNTS, "cost", "audit"]
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    done = closed.select("key", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n_turns"), F.lit(0)).alias("gaps"), *counts,
                         F.sha2(lines, 256).alias("repaired_sha256"))
    longer = chain.where("part IS NULL").join(sha, "key").select("key", "gaps", *counts, "repaired_sha256")
    kind = rows.schema[id_col].dataType
    id_ = F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).cast(kind).alias(id_col)
    summary = done.unionByName(longer)
    return Repair(summary.select(id_, *[c for c in summary.columns if c != "key"]),
                  closed.select(*at, "turns").unionByName(fixed).select(id_, "part", "seq", "turns"))
