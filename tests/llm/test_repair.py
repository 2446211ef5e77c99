import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import repair


def brute_edits(facts):
    """Cost and audit of the cheapest edits, least audit first, by trying them all."""
    most = 3 * len(facts)  # deleting all always works
    found = []

    def legal(roles):
        return all(r in ("su" if k == 0 else "ua") for k, r in enumerate(roles)) and all(a + b in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))

    def go(k, roles, cost, audit):
        if cost > most or not legal(roles):
            return
        if k == len(facts) and (not roles or roles[-1] == "a"):
            found.append((cost, audit))
        for r in "ua":
            go(k, roles + r, cost + 2, audit + "I")
        if k < len(facts):
            initial, fault = facts[k]
            go(k + 1, roles, cost + 3, audit + "D")
            if fault not in ("b", "d"):
                extra = fault == "t"
                go(k + 1, roles + (initial if len(initial) == 1 else "?"), cost + extra, audit + "K")
                for r in "ua":
                    go(k + 1, roles + r, cost + 2 + extra, audit + "R")

    go(0, "", 0, "")
    return min(found)


def test_cheapest_edits_against_all_edits():
    rng = random.Random(3)
    for _ in range(300):
        facts = [(rng.choice(["u", "a", "u", "a", "s", "t", ""]), rng.choice(["", "", "t", "b", "d"])) for _ in range(rng.randint(0, 5))]
        assert repair.ended(repair.cheapest(facts))[1:] == brute_edits(facts), facts


def plain(rows):
    """Every conversation of (conv, turn, role, text), repaired row by row."""
    space = " \t\n\x0b\x0c\r"
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, own in convs.items():
        own.sort()
        seen, facts = set(), []
        for _, _, role, text in own:
            bare = text.strip(space)
            fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            facts.append((role[:1], fault))
        _, cost, audit = repair.ended(repair.cheapest(facts))
        told = [(r, t) for _, _, r, t in own]
        text = "\n".join(f"{r}:{t}" for r, t in repair.applied(told, audit))
        count = lambda f: sum(x == f for _, x in facts)  # noqa: E731, B023
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(facts, facts[1:], strict=False))
        out[" " if conv is None else str(conv)] = (count("b"), count("d"), count("t"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


ROLES, TEXTS = ["user", "assistant", "user", "assistant", "system", "tool", "", None], ["yes.", "no", "", " \n", "why? ", None, "Été!", "日本", "a" * 3000 + "."]


@pytest.fixture(scope="module")
def said(spark):
    rng = random.Random(9)
    rows = [(c, None if rng.random() < 0.05 else rng.randint(-3, 40), rng.choice(ROLES), rng.choice(TEXTS) if rng.random() < 0.3 else f"t{rng.randrange(10**6)}{rng.choice(['.', '', '!'])}") for c, n in ((1, 1), (2, 7), (3, 61), (None, 30), (4, 12), (5, 200)) for _ in range(n)]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, block string, size int").repartition(4)


@pytest.mark.parametrize(("block", "most"), [(1024, 1000), (5, 1000), (3, 20), (1, 0)])
def test_repair_against_plain_python(said, block, most):
    """Conversations in one block and in many give the same, and so do both ways to order them."""
    rows, turns = said
    got = {r.conv: tuple(r)[1:] for r in repair.summary(repair.repair(turns, block=block, most=most)).collect()}
    assert got == plain(rows)


def test_repair_of_nothing(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.summary(repair.repair(turns)).count() == 0 and repair.damaged(turns).count() == 0 and repair.gaps(turns).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", f"One. Two? {c}!") for c in range(4) for t in range(40)] + [(None, 1, None, None), (7, None, "user", "x.")]
    got = {}
    for r in repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text))
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or " ", text or " "
        plain_ = {0: [], 1: [(role, "")], 2: [(role, "".join(x for x in text if x not in ".!?"))], 3: [(role, text)] * 2, 4: [("user", text)]}.get(kind, [(role, text)])
        assert got.get((conv, turn), []) == plain_


def test_gaps(spark):
    rows = [(1, 3), (1, 7), (1, 7), (1, None), (2, None), (None, 5), (3, -(2**63)), (3, 2**63 - 1)]
    found = {r.conv: r.gaps for r in repair.gaps(spark.createDataFrame(rows, "conv_id long, turn long")).collect()}
    assert found == {"1": 3, "2": 0, " ": 0, "3": 2**63 - 1}


def test_a_long_conversation_is_in_no_task_alone(spark):
    """Blocks of one conversation are mended in several tasks."""
    turns = spark.range(6000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = repair.repair(turns, block=100, most=500).withColumn("task", F.spark_partition_id()).checkpoint()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert blocks.select("task").distinct().count() > 1 and blocks.count() == 60
    one = repair.summary(blocks.drop("task")).first()
    assert (one.cost, one.audit) == (0, "K" * 6000)
