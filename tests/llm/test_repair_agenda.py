"""Operator 12 against enumeration of all edits, and its Spark path against plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from vintage.llm import repair_agenda as R

GOAL = re.compile(r"(s?(ua)+)?")


def enumerated(turns, most_inserts):
    """Least (cost, audit) by trying every edit of every turn and up to some inserts in every gap."""
    best = None
    gaps = [list(itertools.chain.from_iterable(itertools.product("ua", repeat=k) for k in range(most_inserts + 1)))] * (len(turns) + 1)
    edits = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for _, f in turns]
    for inserted in itertools.product(*gaps):
        if sum(map(len, inserted)) > most_inserts:
            continue
        for chosen in itertools.product(*edits):
            roles, audit, cost = "".join(inserted[0]), "I" * len(inserted[0]), 2 * len(inserted[0])
            for (x, f), e, more in zip(turns, chosen, inserted[1:]):
                roles += {"D": "", "K": x or "?", "R": e[1:]}[e[0]] + "".join(more)
                audit += e[0] + "I" * len(more)
                cost += {"D": 3, "K": 0, "R": 2}[e[0]] + 2 * len(more) + (f == "truncated" and e != "D")
            if GOAL.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def random_turns(rng, n):
    return [(rng.choice("ssuuaaut"), rng.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(n)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_agenda_finds_the_lightest_edits(n):
    rng = random.Random(n)
    for _ in range(25):
        turns = random_turns(rng, n)
        assert R.repair(turns) == enumerated(turns, n if n < 4 else 3), turns


def test_joined_segments_are_the_whole():
    rng = random.Random(5)
    for _ in range(60):
        turns = random_turns(rng, rng.randrange(2, 40))
        cuts = sorted({0, len(turns), *[rng.randrange(len(turns) + 1) for _ in range(3)]})
        tables = [R.segment_table(turns[i:j]) for i, j in zip(cuts, cuts[1:])]
        whole = R.joined_tables(tables)
        assert whole == R.segment_table(turns)
        assert min(whole[0, q] for q in R.ENDS if (0, q) in whole) == R.repair(turns)


def plain(rows):
    """The contract over (conv_id, turn, role, text) rows."""
    sp = lambda v: " " if v is None else str(v)
    by = {}
    for conv, turn, role, text in rows:
        own, kind, role, text = by.setdefault(conv, []), zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20, sp(role), sp(text)
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, turns = set(), []
        for _, role, text in own:
            body = text.strip(" \t\n\x0b\f\r")
            turns.append((role[:1], "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        numbers = [t for t, _, _ in own if t is not None]
        cost, audit = R.repair(turns)
        rest, state, said = iter(own), "", []
        for e in audit:
            _, role, text = next(rest) if e != "I" else (0, "", "")
            if e == "D":
                continue
            role = role if e == "K" else "assistant" if state == "u" else "user"
            state = role[0]
            said.append(f"{role}:{text}")
        pairs = [a[0] + b[0] for a, b in zip(turns, turns[1:])]
        faults = [f for _, f in turns]
        out.append((conv, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return out


SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def found(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


def odd_rows():
    rng = random.Random(3)
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(rng.randrange(0, 9)):
            text = rng.choice(["Yes.", "No", "What?", " \t", "", None, "Long one here!", "é。", "a\nb."])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 2, -1]), rng.choice(["user", "assistant", "system", "tool", None, ""]), text))
    return rows + [rows[0], rows[3]]


def test_whole_path_equals_plain_python(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "7 AS cid", "'x' AS at", "1 AS part")
    assert found(R.repair_conversations(df)) == sorted(plain(rows), key=str)


def test_long_conversations_are_cut_and_joined(spark):
    rng = random.Random(8)
    rows = [(1, i, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Fine.", "So", "", f"Number {i}."])) for i in range(3000)]
    rows += [(2, 0, "user", "Hello."), (2, 1, "assistant", "Hello.")] + [(3, i, "user", "Again and again.") for i in range(700)]
    assert found(R.repair_conversations(spark.createDataFrame(rows, SCHEMA))) == sorted(plain(rows), key=str)


def test_no_rows(spark):
    assert found(R.repair_conversations(spark.createDataFrame([], SCHEMA))) == []
    gone = [i for i in range(200) if zlib.crc32(f"{i}:0".encode()) % 20 == 0][0]
    (only,) = found(R.repair_conversations(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)))
    assert only == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
