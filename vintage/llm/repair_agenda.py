"""Operator 12: conversation repair by Knuth's lightest-derivation agenda.

Roles should read ``(s?(ua)+)?`` by their initials. A repair is a derivation
in a weighted hypergraph: item (i, q) says that the turns from i on can be
brought to an accepted end from state q of that pattern. Edits are deductions

    Keep, Delete or Rerole of turn i - 1:  (i, q) -> (i - 1, p)
    Insert before turn i:                  (i, q) -> (i, p)

and each puts its initial in front of the audit and its cost on the cost. Items
are popped from an agenda in the order of (cost, turns used, audit), so the
first value popped for an item is its lightest, until the goal (0, start) is.
Each deduction is superior in that order: it adds cost or uses a turn. And it is
monotone: an initial put in front of two audits leaves their order as it is.

A conversation of more than ``SEGMENT`` turns is cut into segments of as many. A
segment's lightest derivations from each state to each other make a table, and tables
are joined by the same agenda: a deduction over a whole segment puts its audit in front.
That is exact: two derivations of one table entry with equal costs are never one a
prefix of the other, as the longer would only add paid inserts. So no conversation
is gathered in one task, whatever its length. Only its repaired text goes
through one, as a stream that is hashed, because SHA-256 has no other way.

Edge cases: nulls of any column read as one space, so a null text is blank, a null role
has no place in the pattern, and a null id's turns are one conversation, returned
with its null id (an id of text ' ' would be another one); null turns come first;
turns of equal number are ordered by role and text; repeated rows are duplicates;
a conversation without turns after damage is whole, with an empty audit; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintage.llm.common import hot_keys, materialize, parts, spread_join, table

#: Fixed: edits by initial with their costs; an undeleted truncated turn adds one.
KEEP, REROLE, DELETE, INSERT = ("K", 0), ("R", 2), ("D", 3), ("I", 2)
#: Fixed: role initials by state (0 nothing yet, 1 system, 2 user, 3 assistant), and the accepted states.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ENDS = (0, 1, 2, 3), (0, 3)
ROLES = {"u": "user", "a": "assistant"}
FAULTS = ("blank", "duplicate", "truncated")
SEGMENT, MERGED = 512, 64

Value = tuple[int, str]
Step = tuple[int, int, Value]  # turns back, state before, (cost, audit)


# ------------------------------------------------------------------ agenda
_INSERTS = {q: [(0, p, (INSERT[1], INSERT[0])) for (p, x), to in NEXT.items() if to == q and x in ROLES] for q in STATES}


def _turn_steps(initial: str, fault: str) -> dict[int, list[Step]]:
    """Deductions over one turn, by the state after it."""
    steps: dict[int, list[Step]] = {q: [(1, q, (DELETE[1], DELETE[0]))] for q in STATES}
    if fault not in ("blank", "duplicate"):
        more = int(fault == "truncated")
        for (p, x), q in NEXT.items():
            if x == initial:
                steps[q].append((1, p, (KEEP[1] + more, KEEP[0])))
            if x in ROLES:
                steps[q].append((1, p, (REROLE[1] + more, REROLE[0])))
    return steps


TURN_STEPS = {(x, f): _turn_steps(x, f) for x in ("s", "u", "a", "") for f in (*FAULTS, "")}


def lightest(n: int, steps: Callable[[int, int], list[Step]], ends: tuple[int, ...], goal: int | None = None) -> dict[int, Value]:
    """state -> lightest (cost, audit) from it over ``n`` units to one of
    ``ends``; ``steps(i, q)`` are the deductions over unit i - 1 that end in q. With
    a ``goal``, the agenda stops at this state's value."""
    agenda: list[tuple[int, int, str, int]] = [(0, 0, "", q) for q in ends]
    final: dict[tuple[int, int], Value] = {}
    while agenda:
        cost, used, audit, q = heapq.heappop(agenda)
        i = n - used
        if (i, q) in final:
            continue
        final[i, q] = (cost, audit)
        if i == 0 and q == goal:
            break
        for back, p, (more, edits) in (*_INSERTS[q], *(steps(i, q) if i else ())):
            if (i - back, p) not in final:
                heapq.heappush(agenda, (cost + more, used + back, edits + audit, p))
    return {q: final[0, q] for q in STATES if (0, q) in final}


Table = dict[tuple[int, int], Value]  # (state before, state after)


def segment_table(turns: list[tuple[str, str]]) -> Table:
    """Of turns (initial, fault): the lightest derivations between all states."""
    over = [TURN_STEPS[x if x in ("s", "u", "a") else "", f] for x, f in turns]
    return {(p, q): v for q in STATES for p, v in lightest(len(over), lambda i, s: over[i - 1][s], (q,)).items()}


def joined_tables(tables: list[Table]) -> Table:
    """The table of consecutive segments together."""
    over = [{s: [(1, p, v) for (p, q), v in t.items() if q == s] for s in STATES} for t in tables]
    return {(p, q): v for q in STATES for p, v in lightest(len(over), lambda i, s: over[i - 1][s], (q,)).items()}


def repair(turns: list[tuple[str, str]]) -> Value:
    """(cost, audit) of a whole conversation."""
    over = [TURN_STEPS[x if x in ("s", "u", "a") else "", f] for x, f in turns]
    return lightest(len(over), lambda i, s: over[i - 1][s], ENDS, goal=0)[0]


def repaired(rows: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn that stays, in order."""
    state = 0
    for edit in audit:
        role, text = next(rows) if edit != INSERT[0] else ("", "")
        if edit == DELETE[0]:
            continue
        if edit != KEEP[0]:
            # after an inserted or re-roled turn the pattern leaves one role to each state
            role = ROLES["a" if state == 2 else "u"]
        state = NEXT[state, role[:1]]
        yield role, text


# ------------------------------------------------------------------- Spark
def damaged(conversations: DataFrame) -> DataFrame:
    """cid (the id as text), turn, role and text of the rows after damage by
    crc32 of ``conv_id:turn``: one in twenty each is dropped, emptied, rid of its
    stops, repeated, or given to the user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").isNull().alias("no_id"), text("conv_id").alias("cid"), F.col("turn").alias("turn"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    rows = rows.where("kind <> 0").select(
        "no_id", "cid", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy").withColumn("nth", F.monotonically_increasing_id())


CONV = ["no_id", "cid"]


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``at``: whole numbers without gaps in the order of
    conversation, turn, role and text, from a sort by ranges, so a long conversation is cut over tasks."""
    order = [*CONV, F.col("turn").asc_nulls_first(), "role", "text", "nth"]  # the last cuts a run of equal rows
    n = parts(rows.sparkSession)
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    out = materialize(ranged.withColumns({"part": F.spark_partition_id(), "nth": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "turns")
    sizes = sorted((r.part, r.n) for r in out.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # one a partition
    before, starts = 0, []
    for part, size in sizes:
        starts.append((part, before))
        before += size
    starts = out.sparkSession.createDataFrame(starts, "part int, start long")
    return out.join(F.broadcast(starts), "part").select(*CONV, "turn", "role", "text", (F.col("nth") + F.col("start")).alias("at"))


def faults(rows: DataFrame) -> DataFrame:
    """no_id, cid, at, part, initial and fault of each placed row, without its
    text; ``part`` numbers the segments of long conversations and is -1 in others."""
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    blanks = F.lit(" \t\n\x0b\f\r")
    last = F.right(F.btrim("text", blanks), F.lit(1))
    thin = rows.select(*CONV, "at", F.substring("role", 1, 1).alias("initial"), F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").alias("fault"), F.unhex(same).alias("same"))
    thin = materialize(thin, "thin")
    again = thin.where("fault is null or fault <> 'blank'").groupBy(*CONV, "same").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("_c")).where("_c > 1")
    again = materialize(again, "again")
    hot = hot_keys(again, [*CONV, "same"], thin.count())
    out = spread_join(thin, again.drop("_c"), [*CONV, "same"], hot, ["at"], "left")
    fault = F.when(F.col("fault") == "blank", "blank").when(F.col("at") > F.col("first"), "duplicate").otherwise(F.coalesce("fault", F.lit("")))
    out = out.select(*CONV, "at", "initial", fault.alias("fault"))
    long_ = thin.groupBy(*CONV).agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("_c")).where(F.col("_c") > SEGMENT)
    long_ = materialize(long_, "long")
    out = spread_join(out, long_.drop("_c"), CONV, hot_keys(long_, CONV, thin.count()), ["at"], "left")
    return out.withColumn("part", F.coalesce(F.floor((F.col("at") - F.col("start")) / SEGMENT), F.lit(-1))).drop("start")


_TABLE_SCHEMA = "no_id boolean, cid string, part long, at long, blank long, duplicate long, truncated long, illegal long, head string, tail string, spans array<struct<before:int,after:int,cost:long,audit:string>>"
LEGAL = {"su", "ua", "au"}


def _spans(t: Table) -> list[dict]:
    return [{"before": p, "after": q, "cost": c, "audit": a} for (p, q), (c, a) in t.items()]


def _grouped(df: DataFrame, key: list[str], one: Callable[[pd.DataFrame], tuple], schema: str) -> DataFrame:
    """``one`` of each run of rows with equal ``key`` and bounded size, in order of ``at``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, columns = None, [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            change = np.flatnonzero((b[key].to_numpy()[1:] != b[key].to_numpy()[:-1]).any(axis=1)) + 1
            cut = [0, *change.tolist()]
            out = [one(b.iloc[i:j]) for i, j in zip(cut, cut[1:])]
            held = b.iloc[cut[-1] :]
            if out:
                yield pd.DataFrame(out, columns=columns)
        if held is not None and len(held):
            yield pd.DataFrame([one(held)], columns=columns)

    return df.repartition(parts(df.sparkSession), *key).sortWithinPartitions(*key, "at").mapInPandas(run, schema)  # as many tasks however few bytes: the work is in Python


def segments(facts: DataFrame) -> DataFrame:
    """One row for each short conversation and each segment of a long one: counts
    of faults, illegal neighbours, first and last initial, lightest derivations (of a
    short one only that from the start to its end)."""

    def one(rows: pd.DataFrame) -> tuple:
        initials, found = rows["initial"].tolist(), rows["fault"].tolist()
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
        r, turns = rows.iloc[0], list(zip(initials, found))
        t = {(0, ENDS[0]): repair(turns)} if r["part"] < 0 else segment_table(turns)
        return (r["no_id"], r["cid"], r["part"], r["at"], *[found.count(f) for f in FAULTS], illegal, initials[0], initials[-1], _spans(t))

    return _grouped(facts, [*CONV, "part"], one, _TABLE_SCHEMA)


def merged(tables: DataFrame) -> DataFrame:
    """The rows of ``segments`` joined, MERGED at a time, until each long conversation has one."""

    def one(rows: pd.DataFrame) -> tuple:
        r = rows.iloc[0]
        if len(rows) == 1:
            return tuple(r[c.split()[0]] for c in _TABLE_SCHEMA.split(", ")[:10]) + (r["spans"],)
        ends = [a + b for a, b in zip(rows["tail"], rows["head"].iloc[1:])]
        t = joined_tables([{(x["before"], x["after"]): (x["cost"], x["audit"]) for x in s} for s in rows["spans"]])
        illegal = int(rows["illegal"].sum()) + sum(e not in LEGAL for e in ends)
        return (r["no_id"], r["cid"], r["part"], r["at"], *[int(rows[f].sum()) for f in FAULTS], illegal, r["head"], rows["tail"].iloc[-1], _spans(t))

    whole = None
    while True:
        tables = materialize(tables, "segments")
        cut = tables.groupBy(*CONV).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        cut = materialize(cut, "cut")
        if cut.isEmpty():
            return tables if whole is None else whole.unionByName(tables)
        done = tables.join(cut, CONV, "left_anti")
        whole = done if whole is None else whole.unionByName(done)
        tables = _grouped(tables.join(cut, CONV).withColumn("part", F.floor(F.col("part") / MERGED)), [*CONV, "part"], one, _TABLE_SCHEMA)


def repaired_digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """no_id, cid, repaired_sha256. A conversation's audit comes as the row
    before its turns; both pass by as a stream and only the hash is held."""
    out = audits.select(*CONV, F.lit(-1).cast("long").alias("at"), F.col("audit").alias("role"), F.lit("").alias("text"))
    both = out.unionByName(rows.select(*CONV, "at", "role", "text")).repartition(*CONV).sortWithinPartitions(*CONV, "at")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def stream() -> Iterator[tuple]:
            for b in batches:
                yield from zip(b["no_id"], b["cid"], b["at"], b["role"], b["text"])

        done, held, source = [], None, stream()

        def turns(conv: tuple) -> Iterator[tuple[str, str]]:
            nonlocal held
            for no, cid, at, role, text in source:
                if (no, cid) != conv:
                    held = (no, cid, at, role, text)
                    return
                yield role, text

        held = next(source, None)
        while held is not None:
            no, cid, _, audit, _ = held
            held, own, sha, mark = None, turns((no, cid)), hashlib.sha256(), b""
            for role, text in repaired(own, audit):
                sha.update(mark + f"{role}:{text}".encode())
                mark = b"\n"
            for _ in own:  # nothing is left but where the audit is shorter than the turns
                pass
            done.append((no, cid, sha.hexdigest()))
            if len(done) == 10_000:
                yield pd.DataFrame(done, columns=[*CONV, "repaired_sha256"])
                done = []
        yield pd.DataFrame(done, columns=[*CONV, "repaired_sha256"])

    return both.mapInPandas(run, "no_id boolean, cid string, repaired_sha256 string")


def repair_conversations(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256 of every conversation; ``rows`` (no_id, cid, turn, role, text)
    are what is to be repaired, by default the rows after damage."""
    rows = placed(damaged(conversations) if rows is None else rows)
    tables = merged(segments(faults(rows)))
    ends = F.filter("spans", lambda x: (x.before == 0) & x.after.isin(*ENDS))
    best = F.array_min(F.transform(ends, lambda x: F.struct(x.cost, x.audit)))
    found = tables.select(*CONV, *FAULTS, "illegal", best.alias("best"))
    found = materialize(found.select(*CONV, *FAULTS, "illegal", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit")), "audits")
    gaps = rows.groupBy(*CONV).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    own = conversations.select("conv_id").distinct()
    own = own.select("conv_id", F.col("conv_id").isNull().alias("no_id"), F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("cid"))
    out = own.join(gaps, CONV, "left").join(found, CONV, "left").join(repaired_digests(rows, found.select(*CONV, "audit")), CONV, "left")
    numbers = ["gaps", *FAULTS, "illegal", "cost"]
    return out.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def op12_repair_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))
