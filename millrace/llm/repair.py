"""Repair of conversations' structure: which turns to keep, rerole, delete or insert, at the least cost."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rank import places
from ._common import prepare

DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: What a repaired conversation has last: nothing, a system's, a user's or an assistant's turn.
STATES = "esua"
#: Turns that must be inserted between a state and a retained turn of a role; pairs that aren't here can't be mended by inserting.
BETWEEN = {("e", "s"): 0, ("e", "u"): 0, ("e", "a"): 1, ("s", "u"): 0, ("s", "a"): 1, ("u", "a"): 0, ("u", "u"): 1, ("a", "u"): 0, ("a", "a"): 1}
#: Turns that must be inserted at the end, and the role that comes next.
AFTER = {"e": 0, "s": 2, "u": 1, "a": 0}
NEXT = {"e": "user", "s": "user", "u": "assistant", "a": "user"}
NEVER = 1 << 60
#: Rows of a conversation that are repaired at once.
BLOCK = 1024
SPACE = " \t\n\x0b\f\r"


def _or_space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with a fixed damage, to have something to repair: conv_id, turn, role and text.

    By crc32 of ``conv_id:turn`` modulo 20, 0 drops a row, 1 empties its
    text, 2 removes its full stops and marks, 3 repeats it and 4 makes the
    user say it.  Nulls are one space, in that key as well; conv_id and turn
    stay null.
    """
    kind = F.crc32(F.concat(_or_space("conv_id"), F.lit(":"), _or_space("turn")).cast("binary")) % 20
    told = rows.select("conv_id", "turn", _or_space("role").alias("role"), _or_space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    twice = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return told.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(twice).alias("copy")).drop("copy")


def cheapest(rows: Sequence[tuple[str, str]], start: str = "e") -> dict[str, tuple[int, str]]:
    """Cost and audit of the cheapest edits of rows (initial of the role, fault) from a state, for each state in which they can end.

    The retained rows form a subsequence.  ``best`` has the cheapest one that
    ends in each state, net of the deletions up to its last row, so that the
    rows deleted after it cost a difference of two prefix sums and leave the
    minima as they are; the pair of roles tells what must be inserted between
    them.  Of equal costs the least audit is taken: audits to be compared
    have used up the same rows and end with no insertion, so that none
    begins another, and what follows can't reverse their order.  In a gap
    deletions come before insertions, which is least.
    """
    best: dict[str, tuple[int, str, int]] = {start: (0, "", 0)}
    gone = 0
    for k, (initial, fault) in enumerate(rows):
        found = []
        if fault not in ("b", "d"):
            extra = TRUNCATED if fault == "t" else 0
            for role in "sua":
                if role != initial and role == "s":
                    continue
                price, op = (extra, "K") if role == initial else (extra + REROLE, "R")
                for state, (net, audit, at) in best.items():
                    missing = BETWEEN.get((state, role))
                    if missing is not None:
                        found.append((role, net + gone + price + INSERT * missing, f"{audit}{'D' * (k - at)}{'I' * missing}{op}"))
        gone += DELETE
        for role, cost, audit in found:
            held = best.get(role)
            if held is None or (cost - gone, audit) < (held[0], held[1] + "D" * (k + 1 - held[2])):
                best[role] = (cost - gone, audit, k + 1)
    return {state: (net + gone, audit + "D" * (len(rows) - at)) for state, (net, audit, at) in best.items()}


def ended(ways: dict[str, tuple[int, str]]) -> tuple[str, int, str]:
    """The state, cost and audit of the cheapest way with the insertions that end it."""
    cost, audit, state = min((cost + INSERT * AFTER[state], audit + "I" * AFTER[state], state) for state, (cost, audit) in ways.items())
    return state, cost, audit


def applied(rows: Sequence[tuple[str, str]], audit: str, state: str = "e") -> list[tuple[str, str]]:
    """role and text of the repaired rows (role, text)."""
    out, k = [], 0
    for op in audit:
        role, text = NEXT[state], ""
        if op != "I":
            role, text = rows[k][0] if op == "K" else role, rows[k][1]
            k += 1
        if op != "D":
            out.append((role, text))
            state = role[0]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...] = ("conv", "block")) -> Iterator[list[dict]]:
    """The rows of each block, from batches that are sorted by it; a block may reach over batches."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(row[k] != held[0][k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _prices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block, the cost from each state to each, the order of the audits from one state, and the last initial."""
    for rows in _blocks(batches):
        facts = [(r["initial"], r["fault"]) for r in rows]
        costs, ranks = [], []
        for start in STATES:
            ways = cheapest(facts, start)
            order = sorted(ways, key=lambda s: ways[s][1])
            costs += [ways[s][0] if s in ways else NEVER for s in STATES]
            ranks += [order.index(s) if s in ways else -1 for s in STATES]
        yield pa.RecordBatch.from_arrays(
            [pa.array([rows[0]["conv"]], pa.string()), pa.array([rows[0]["block"]], pa.int64()), pa.array([costs], pa.list_(pa.int64())), pa.array([ranks], pa.list_(pa.int64())), pa.array([rows[-1]["initial"]], pa.string())],
            ["conv", "block", "costs", "ranks", "last"],
        )


def _route(frame: pd.DataFrame) -> pd.DataFrame:
    """The states between the blocks of a conversation on the cheapest way, the least audit of equals.

    Different states between two blocks have different audits, so their
    order decides, and audits themselves needn't be here.
    """
    frame = frame.sort_values("block")
    now, back = {0: (0, 0)}, []
    for costs, ranks in zip(frame["costs"], frame["ranks"], strict=True):
        ways = {}
        for z in range(4):
            fits = [(cost + int(costs[4 * y + z]), rank, y) for y, (cost, rank) in now.items() if costs[4 * y + z] < NEVER]
            if fits:
                ways[z] = min(fits)
        back.append({z: way[2] for z, way in ways.items()})
        order = sorted(ways, key=lambda z: (ways[z][1], ranks[4 * ways[z][2] + z]))
        now = {z: (ways[z][0], k) for k, z in enumerate(order)}
    state = min(now, key=lambda z: (now[z][0] + INSERT * AFTER[STATES[z]], now[z][1]))
    ends, starts = [], []
    for step in reversed(back):
        ends.append(STATES[state])
        state = step[state]
        starts.append(STATES[state])
    return pd.DataFrame({"conv": frame["conv"], "block": frame["block"], "start": starts[::-1], "end": ends[::-1], "before": [None, *frame["last"].tolist()[:-1]], "final": [False] * (len(frame) - 1) + [True]})


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_FOUND = "conv string, block long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns array<struct<role:string,text:string>>"


def _mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    size = 0
    for rows in _blocks(batches):
        first = rows[0]
        facts = [(r["initial"], r["fault"]) for r in rows]
        if first["start"] is None:
            _, _, audit = ended(cheapest(facts))
            start = "e"
        else:
            start = first["start"]
            audit = cheapest(facts, start)[first["end"]][1] + "I" * (AFTER[first["end"]] if first["final"] else 0)
        kept = [op for op in audit if op != "I"]
        cost = sum({"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[op] for op in audit) + sum(TRUNCATED for (_, fault), op in zip(facts, kept, strict=True) if fault == "t" and op != "D")
        met = [*([first["before"]] if first["before"] is not None else []), *(i for i, _ in facts)]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(met, met[1:], strict=False))
        count = lambda f: sum(fault == f for _, fault in facts)  # noqa: E731, B023
        turns = [{"role": role, "text": text} for role, text in applied([(r["role"], r["text"]) for r in rows], audit, start)]
        out.append((first["conv"], first["block"], count("b"), count("d"), count("t"), illegal, cost, audit, turns))
        size += sum(len(t["text"]) for t in turns) + 100
        if size > 1 << 20 or len(out) >= 1000:
            yield _batch(out)
            out, size = [], 0
    if out:
        yield _batch(out)


def _batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), _TURNS]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], [f.split(" ")[0] for f in _FOUND.split(", ")])


def repair(turns: DataFrame, block: int = BLOCK, most: int = 100_000) -> DataFrame:
    """Blocks of repaired conversations: conv (conv_id as text, a space for null), block, the numbers of blank, duplicate and truncated rows, of illegal neighbours, cost, audit and turns (role, text).

    Rows count in order of turn, nulls first, then role and text.  A row's
    first fault counts: blank, duplicate (role and text of an earlier row of
    the conversation), truncated (its last character that isn't white space
    isn't one of ``.!?``).  The edits (K keep, R rerole, D delete, I insert)
    are the cheapest that give ``(s?(ua)+)?`` as initials of roles, the audit
    that is least in ASCII of equals; blank and duplicate rows are deleted.

    A conversation of up to ``block`` rows is one block.  Of a longer one
    every block is priced from each state to each, in any task; those tables
    of 16 numbers decide, conversation by conversation, in which states its
    blocks begin and end, and then every block is mended by itself, so that
    no task has a whole conversation (nor its order, see places(), which
    sorts conversations of over ``most`` rows by ranges).

    Null roles and texts are one space; rows with null conv_id are one
    conversation; repeated rows are duplicates; texts of any length must fit
    in a worker, ``block`` at a time; an empty table gives an empty result;
    other columns, whatever they are called, play no part.
    """
    prepare(turns.sparkSession)
    rows = turns.select(_or_space("conv_id").alias("conv"), F.col("turn").alias("turn"), _or_space("role").alias("role"), _or_space("text").alias("text"))
    rows = rows.withColumn("same", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    placed = places(rows, ["conv"], F.asc_nulls_first("turn"), "role", "text", size="size", most=most).checkpoint()
    firsts = placed.groupBy("conv", "same").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    bare = F.rtrim("text", F.lit(SPACE))
    fault = F.when(bare == "", "b").when(F.col("place") > F.col("first"), "d").when(~F.right(bare, F.lit(1)).isin(*".!?"), "t").otherwise("")
    told = placed.join(firsts, ["conv", "same"], "left").select("conv", F.floor(F.col("place") / block).cast("long").alias("block"), "place", "size", "role", "text", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))

    dealt = lambda df: df.repartition("conv", "block").sortWithinPartitions("conv", "block", "place")
    prices = dealt(told.where(F.col("size") > block).select("conv", "block", "place", "initial", "fault")).mapInArrow(_prices, "conv string, block long, costs array<long>, ranks array<long>, last string")
    routes = prices.groupBy("conv").applyInPandas(_route, "conv string, block long, start string, end string, before string, final boolean")
    known = dealt(told.drop("size").join(routes, ["conv", "block"], "left"))
    return known.mapInArrow(_mended, _FOUND)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation, from its blocks in order; texts are hashed as they come and never joined."""
    out: list[tuple] = []
    now: list | None = None
    digest = hashlib.sha256()

    def close() -> None:
        out.append((now[0], *now[1:6], "".join(now[6]), digest.hexdigest()))

    names = ["conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.string()]
    flushed = lambda: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
    for batch in batches:
        for row in batch.to_pylist():
            if now is None or row["conv"] != now[0]:
                if now is not None:
                    close()
                now, digest, begun = [row["conv"], 0, 0, 0, 0, 0, []], hashlib.sha256(), False
            for k, name in enumerate(names[1:6], 1):
                now[k] += row[name]
            now[6].append(row["audit"])
            for turn in row["turns"]:
                digest.update((("\n" if begun else "") + turn["role"] + ":" + turn["text"]).encode())
                begun = True
        if len(out) >= 1000:
            yield flushed()
            out.clear()
    if now is not None:
        close()
    if out:
        yield flushed()


def summary(blocks: DataFrame) -> DataFrame:
    """conv, the numbers of repair()'s blocks added up, audit and repaired_sha256 (of ``role:text``, a line each) of every conversation."""
    fields = "conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return blocks.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(_summed, fields)


def gaps(turns: DataFrame) -> DataFrame:
    """conv and gaps: the turns that are missing between its first and its last, nulls apart; 0 if all are null."""
    wide = lambda c: c.cast("decimal(20,0)")
    missing = wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count_distinct("turn")
    most = F.lit(2**63 - 1).cast("decimal(20,0)")
    return turns.groupBy(_or_space("conv_id").alias("conv")).agg(F.when(missing.isNull(), 0).otherwise(F.least(missing, most)).cast("long").alias("gaps"))
