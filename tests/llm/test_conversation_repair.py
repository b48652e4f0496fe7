"""Conversation repair against brute force over all edit sequences and a plain DP."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from riskframe.llm import conversation_repair as C
from riskframe.llm.queries import QUERIES
from tests.llm.helpers import SF

LEGAL = re.compile(r"(s?(ua)+)?")


def every_edit(rows):
    """Least (cost, audit) over all edit sequences with up to two inserts per gap;
    ``rows`` are (initial, forced, truncated)."""
    gaps = ["", "u", "a", "ua", "au"]
    best = None
    for ins in itertools.product(gaps, repeat=len(rows) + 1):
        for edits in itertools.product(*[("D",) if forced else ("D", "K", "Ru", "Ra") for _, forced, _ in rows]):
            cost, audit, roles = 2 * len(ins[0]), "I" * len(ins[0]), ins[0]
            for (initial, _, late), e, more in zip(rows, edits, ins[1:]):
                cost += {"D": 3, "K": 0}.get(e, 2) + (late if e != "D" else 0) + 2 * len(more)
                audit += e[0] + "I" * len(more)
                roles += ("" if e == "D" else initial if e == "K" else e[1]) + more
            if LEGAL.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_agenda_is_lightest(n):
    classes = [("s", 0, 0), ("u", 0, 0), ("a", 0, 0), ("x", 0, 0), ("u", 0, 1), ("x", 0, 1), ("a", 1, 0)]
    for rows in itertools.product(classes, repeat=n):
        marks = "".join(C.FORCED if forced else C.mark(initial, not late) for initial, forced, late in rows)
        assert C.solve(marks) == every_edit(rows), rows


def test_segments_compose_to_the_whole():
    import random
    rng = random.Random(3)
    for _ in range(60):
        marks = "".join(rng.choice("suaxSUAX-") for _ in range(rng.randrange(1, 24)))
        best = {"0": (0, "")}
        at = 0
        while at < len(marks):
            step = C.between(marks[at:at + (size := rng.randrange(1, 8))])
            new = {}
            for p, v in best.items():
                for q, (c, a) in step[p].items():
                    new[q] = min(new.get(q, (10 ** 9, "")), (v[0] + c, v[1] + a))
            best, at = new, at + size
        assert min(best[g] for g in C.GOALS if g in best) == C.solve(marks)


def plain(rows, damage):
    """Summary of one conversation's (conv_id, turn, role, text) rows by a plain DP."""
    seq = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        if damage:
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            seq += [(turn, role, text)] * (2 if kind == 3 else 1)
        else:
            seq.append((turn, role, text))
    seq.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    turns = [t for t, _, _ in seq if t is not None]
    seen, faults, marks = set(), defaultdict(int), []
    for _, role, text in seq:
        body = text.strip(" \t\n\v\f\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        faults[fault] += 1
        seen.add((role, text))
        marks.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def inserts(best):
        for _ in range(2):
            for p, (c, a, out) in list(best.items()):
                for q in follow[p].replace("s", ""):
                    new = (c + 2, a + "I", out + (({"u": "user", "a": "assistant"}[q], ""),))
                    best[q] = min(best.get(q, new), new, key=lambda v: v[:2])
        return best

    best = inserts(best)
    for (initial, forced, late), (_, role, text) in zip(marks, seq):
        new = {}
        for p, (c, a, out) in best.items():
            options = [(p, c + 3, "D", ())]
            if not forced:
                if initial and initial in follow[p]:
                    options.append((initial, c + late, "K", ((role, text),)))
                options += [(q, c + 2 + late, "R", (({"u": "user", "a": "assistant"}[q], text),)) for q in follow[p].replace("s", "")]
            for q, cost, edit, more in options:
                v = (cost, a + edit, out + more)
                new[q] = min(new.get(q, v), v, key=lambda x: x[:2])
        best = inserts(new)
    cost, audit, out = min((best[g] for g in ("", "a") if g in best), key=lambda v: v[:2])
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()), out


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def by_conversation(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    return out


def test_query_on_data(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in QUERIES["op11_conversation_repair"](spark, SF).collect()}
    assert got == {k: plain(v, True)[0] for k, v in by_conversation(rows).items()}
    assert any(v[5] for v in got.values())


AWKWARD = [
    (None, 0, "user", "Lost id."), (None, None, None, None), (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes"),
    (2, 5, "tool", "Odd role!"), (2, None, "", "No role?"), (2, 3, "system", " \t\n\v\f\r"), (3, 2, "assistant", "Only.　"),
    (4, 9, "system", "S."), (4, 10, "system", "S2."), (4, 10, "assistant", "A."), (5, 0, "user", "x" * 200_000 + "."), (5, 1, "assistant", ""),
    (6, 1, "usher", "Same initial."), (6, 1, "assistant", "Ünïcode 日本 𝄞?"), (7, None, "user", None), (8, -3, "user", "Neg."), (8, 4, "assistant", "Ok."),
]
SCHEMA = "conv_id long, turn long, role string, text string, key string, part int, cost long"


@pytest.mark.parametrize("damage", [True, False])
def test_awkward_rows(spark, damage):
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in AWKWARD], SCHEMA).repartition(3)
    out = C.repair(C.damaged(df), dropped=F.col("dropped")) if damage else C.repair(df)
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in out.summary.collect()}
    want = {k: plain(v, damage) for k, v in by_conversation(AWKWARD).items()}
    assert got == {k: v[0] for k, v in want.items()}
    turns = defaultdict(list)
    for r in sorted(out.turns.collect(), key=lambda r: (r.part, r.seq)):
        turns[r.conv_id] += [(t["role"], t["text"]) for t in r.turns]
    assert dict(turns) == {k: list(v[1]) for k, v in want.items()}


def test_long_conversation_is_split(spark):
    """One conversation holds nearly all rows, many of them copies, over all partitions."""
    import random
    rng = random.Random(7)
    rows = [(1, t // 2, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "", f"t{t}.", f"t{t}"])) for t in range(3000)]
    rows += [(0, 0, "user", "q."), (2, 0, "user", "q."), (2, 1, "assistant", "r.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    out = C.repair(df)
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in out.summary.collect()}
    assert got == {k: plain(v, False)[0] for k, v in by_conversation(rows).items()}
    pieces = out.turns.where("conv_id = 1").collect()
    assert len({r.part for r in pieces}) > 1 and max(len(r.turns) for r in pieces) <= 3 * C.SEGMENT


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = C.repair(C.damaged(df), dropped=F.col("dropped"))
    assert out.summary.count() == 0 and out.turns.count() == 0
