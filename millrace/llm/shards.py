"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Racks of a full region and shards of a full rack.
REGION, RACK = 4, 4
#: Hex digits of an MD5 that a draw uses: as many bits as a double holds.
DIGITS = 13
#: Region, rack, shard: weight.
Tree = Mapping[int, Mapping[int, Mapping[int, float]]]


def even_tree(shards: int) -> dict[int, dict[int, dict[int, float]]]:
    """Places of weight 1 for so many shards, in racks of 4 and regions of 16, filled in order.

    The last region has places for shards that aren't there yet: see
    ``shards`` of with_shard().
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    size = REGION * RACK
    return {r: {k: {s: 1.0 for s in range(k * RACK, (k + 1) * RACK)} for k in range(r * REGION, (r + 1) * REGION)} for r in range(-(-shards // size))}


def weighted(tree: Tree, regions: Mapping[int, float] | None = None, racks: Mapping[int, float] | None = None) -> dict[int, dict[int, dict[int, float]]]:
    """The tree with some regions or racks brought to a weight of their own, shared by what is below them as before."""
    out = {}
    for r, held in tree.items():
        below = {}
        for k, shards in held.items():
            scale = (racks or {}).get(k, total := sum(shards.values())) / total if shards else 1.0
            below[k] = {s: w * scale for s, w in shards.items()}
        whole = sum(sum(shards.values()) for shards in below.values())
        scale = (regions or {}).get(r, whole) / whole if whole else 1.0
        out[r] = {k: {s: w * scale for s, w in shards.items()} for k, shards in below.items()}
    return out


#: Attempts at a place that is there before a region's shards draw themselves.
ATTEMPTS = 64


def _draw(kind: str, node: Column, attempt: Column | int, name: Column) -> Column:
    """-ln(u), u being hashed from a node, an attempt and the key: exponential, and the same whatever the tree."""
    attempt = attempt if isinstance(attempt, Column) else F.lit(attempt)
    text = F.concat(F.lit(kind), node.cast("string"), F.lit(":"), attempt.cast("string"), F.lit(":"), name)
    return -F.log((F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS))


def _bound(x: Column, use) -> Column:
    """use(x), with x evaluated once."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def with_shard(df: DataFrame, key: Column, tree: Tree, out: str, shards: int | None = None) -> DataFrame:
    """Adds ``out``: the shard of ``key`` in the tree; shards of weight 0 get nothing.

    A key descends: the regions draw -ln(u) / weight, and the least draw wins;
    then the racks of that region do, then the shards of that rack.  Weights
    are those of what is below a node.  A draw depends on its node and the
    key alone, so that where the weight of a subtree changes keys move into
    it or out of it, level by level, and nowhere else.

    With ``shards``, places of the tree from that number on aren't there yet.
    A region that has some draws for all its places: a key that comes to one
    that isn't there goes on, and the region's draw grows by its next one,
    until a place is there or another region's draw is less.  (Refusing
    arrivals thins them to the share of the places that are there, so shards
    stay even; after 64 refusals the region's shards draw themselves.)  The
    place that one more shard fills was refused before, and what it takes
    all goes to that shard.
    """
    name = F.coalesce(key.cast("string"), F.lit("null"))
    racks = {r: [(k, [(s, float(w)) for s, w in sorted(leaves.items()) if w > 0]) for k, leaves in sorted(held.items())] for r, held in sorted(tree.items())}
    racks = {r: [(k, leaves) for k, leaves in held if leaves] for r, held in racks.items()}
    total = lambda held: sum(w for _, leaves in held for _, w in leaves)
    there = lambda s: shards is None or s < shards
    full = {r: held for r, held in racks.items() if held and all(there(s) for _, leaves in held for s, _ in leaves)}
    open_ = {r: held for r, held in racks.items() if r not in full and any(there(s) for _, leaves in held for s, _ in leaves)}
    if not full and not open_:
        raise ValueError("no shard has a weight")

    def leaf_table(leaves) -> Column:
        return F.array(*(F.struct(F.lit(s).alias("node"), F.lit(w).alias("weight")) for s, w in leaves))

    def rack_table(held) -> Column:
        return F.array(*(F.struct(F.lit(k).alias("node"), F.lit(sum(w for _, w in leaves)).alias("weight"), leaf_table(leaves).alias("below")) for k, leaves in held))

    def least(kind: str, nodes: Column, attempt: Column | int) -> Column:
        """The place in ``nodes`` of the node with the least draw, the first of equals."""
        return F.array_min(F.transform(nodes, lambda x, i: F.struct((_draw(kind, x["node"], attempt, name) / x["weight"]).alias("draw"), i.alias("at"))))["at"]

    def descend(held: Column, attempt: Column | int) -> Column:
        rack = F.get(held, least("k", held, attempt))["below"]
        return _bound(rack, lambda leaves: F.get(leaves, least("s", leaves, attempt))["node"])

    # the regions whose places are all there
    table = F.array(*(F.struct(F.lit(r).alias("node"), F.lit(total(held)).alias("weight"), rack_table(held).alias("racks")) for r, held in full.items())) if full else None
    never = F.struct(F.lit(float("inf")).alias("draw"), F.lit(-1).alias("at"))
    best = F.array_min(F.transform(table, lambda x, i: F.struct((_draw("r", x["node"], 0, name) / x["weight"]).alias("draw"), i.alias("at")))) if full else never

    def arrive(r: int, held, best: Column) -> Column:
        """A region that lacks some: when the key comes to a place that is there, and to which shard; -1 where another region is first."""
        nodes, weight = rack_table(held), total(held)

        def step(state: Column, attempt: Column) -> Column:
            came = state["draw"] + _draw("r", F.lit(r), attempt, name) / weight
            place = lambda t: F.when(t < best["draw"], descend(nodes, attempt)).otherwise(-1)
            kept = lambda p: F.when(p < shards, p).otherwise(-1)
            tried = _bound(came, lambda t: F.struct(t.alias("draw"), _bound(place(t), kept).alias("shard")))
            return F.when((state["shard"] >= 0) | (state["draw"] >= best["draw"]), state).otherwise(tried)

        start = F.struct(F.lit(0.0).alias("draw"), F.lit(-1).alias("shard"))
        own = [(s, w) for _, leaves in held for s, w in leaves if there(s)]

        def last(state: Column) -> Column:
            drawn = F.transform(leaf_table(own), lambda x: F.struct((state["draw"] + _draw("t", x["node"], 0, name) / x["weight"]).alias("draw"), x["node"].alias("shard")))
            return F.when((state["shard"] >= 0) | (state["draw"] >= best["draw"]), state).otherwise(F.array_min(drawn))

        found = F.aggregate(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), start, step, last)
        return _bound(found, lambda f: F.when((f["shard"] >= 0) & (f["draw"] < best["draw"]), f).otherwise(F.struct(F.lit(float("inf")).alias("draw"), F.lit(-1).alias("shard"))))

    def choose(best: Column) -> Column:
        inside = descend(F.get(table, best["at"])["racks"], 0) if full else F.lit(-1)
        if not open_:
            return inside
        return _bound(F.array_min(F.array(*(arrive(r, held, best) for r, held in open_.items()))), lambda f: F.when(f["shard"] >= 0, f["shard"]).otherwise(inside))

    return df.withColumn(out, _bound(best, choose).cast("int"))


#: Rows of one key that are written out at once, and hash buckets of a shard.
CHUNK, BUCKETS = 1000, 256


def assign(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: doc_id and the number of shards alone decide, and
    grown_shard is the shard among ``shards`` + 1.  size is the text's UTF-8
    bytes plus 16.  slot numbers a shard's rows from 0 without gaps: rows are
    numbered within 256 hash buckets of the shard, and counts of the buckets,
    of which the driver gets one number each, give each bucket's first slot,
    so that no task sorts a whole shard and texts are never shuffled.

    A null text counts as empty (size 16, checksum 0); rows with null doc_id
    share one shard; repeated rows stay, each with its own slot: equal ones
    are counted first, numbered together and written out in chunks that
    spread over tasks, so that one that makes up much of the table is no
    one task's; an empty table gives an empty result; other columns are not
    read.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    rows = with_shard(with_shard(rows, F.col("doc_id"), even_tree(shards), "shard", shards), F.col("doc_id"), even_tree(shards + 1), "grown_shard", shards + 1)
    place = F.md5(F.concat(F.lit("slot:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    rows = rows.withColumn("bucket", F.conv(F.substring(place, 1, 2), 16, 10).cast("int"))
    rows = rows.groupBy("shard", "bucket", "doc_id", "text_crc32", "size", "grown_shard").agg(F.count("*").alias("n")).checkpoint()
    counts = [0] * (shards * BUCKETS)
    for r in rows.groupBy("shard", "bucket").agg(F.sum("n").alias("n")).collect():  # at most shards * BUCKETS rows, whatever the input
        counts[r["shard"] * BUCKETS + r["bucket"]] = r["n"]
    first = [sum(counts[k - k % BUCKETS : k]) for k in range(len(counts))]
    table = F.split(F.lit(",".join(map(str, first))), ",").cast("array<long>")
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("own", F.sum("n").over(within) - F.col("n")).withColumn("first", F.element_at(table, F.col("shard") * BUCKETS + F.col("bucket") + 1))
    chunks = numbered.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {CHUNK}")))).hint("rebalance")
    each = chunks.withColumn("k", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK) - 1)))
    return each.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("own") + F.col("k")).cast("long").alias("slot"), F.col("grown_shard").cast(T.IntegerType())
    )
