"""Merkle manifests of datasets: a digest for every row, one for every subset, one for all, and the proofs that tie them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..operators.rank import places_by_range
from ._common import prepare
from .pfp import _near

#: Children of a block at most: what a combiner holds.
MOST = 1024
_STEPS = "array<struct<before:string,after:string>>"

#: A block that is being combined: the width of each of its levels, the arity, and the digests known so far by (level, place).
Partial = tuple[tuple[int, ...], int, dict[tuple[int, int], str]]
Child = tuple[int, str, int, int, int, int]


def told(x: Column) -> Column:
    """A value as a manifest writes it: its length in UTF-8 bytes, a colon and itself, or - for null."""
    text = x.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest_of(fields: Sequence[Column]) -> Column:
    """The digest of a row's fields, lowercase hex of sha256 of them all."""
    return F.sha2(F.concat(*(told(f) for f in fields)).cast("binary"), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf gives with the siblings of its proof."""
    return F.aggregate(proof, leaf, lambda now, step: F.sha2(F.concat(step["before"], now, step["after"]).cast("binary"), 256))


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), "").cast("binary"), 256)


def _arrive(part: Partial, level: int, place: int, digest: str) -> None:
    """A child's digest has come: if it completes its parent, the parent's comes too, and so on."""
    widths, arity, known = part
    known[level, place] = digest
    while level + 1 < len(widths):
        parent = place // arity
        if (level + 1, parent) in known:
            return
        run = [known.get((level, k)) for k in range(parent * arity, min((parent + 1) * arity, widths[level]))]
        if None in run:
            return
        level, place = level + 1, parent
        known[level, place] = hashlib.sha256("".join(run).encode()).hexdigest()


def _create(child: Child) -> Partial:
    place, digest, arity, n, block, span = child
    widths = [min(span, n - block * span)]
    # a block of a tree that has more of them is as high as any; that of a tree of one block ends with a single node
    left = span
    while left > 1 if n > span else widths[-1] > 1:
        widths.append(-(-widths[-1] // arity))
        left //= arity
    part = (tuple(widths), arity, {})
    _arrive(part, 0, place, digest)
    return part


def _add(part: Partial, child: Child) -> Partial:
    _arrive(part, 0, child[0], child[1])
    return part


def _merge(part: Partial, other: Partial) -> Partial:
    if len(part[2]) < len(other[2]):
        part, other = other, part
    for (level, place), digest in sorted(other[2].items()):
        if (level, place) not in part[2]:
            _arrive(part, level, place, digest)
    return part


def _span(arity: int, most: int) -> int:
    span = arity
    while span * arity <= most:
        span *= arity
    return span


def _links(item: tuple[tuple, Partial], span: int) -> Iterator[tuple]:
    """A row for each child of a block, the first with the block's digest: the siblings on the way up, from the links of its ancestors."""
    (tree, block, n), (widths, arity, known) = item
    steps: list[list[tuple]] = []  # of each node of the level above
    for level in range(len(widths) - 2, -1, -1):
        above, steps = steps, []
        for place in range(widths[level]):
            parent = place // arity
            run = range(parent * arity, min((parent + 1) * arity, widths[level]))
            step = ("".join(known[level, k] for k in run if k < place), "".join(known[level, k] for k in run if k > place))
            steps.append([step, *(above[parent] if above else [])])
    top = known[len(widths) - 1, 0]
    for place, mine in enumerate(steps or [[]]):
        yield tree, n, block * span + place, mine, top if place == 0 else None


def _round(nodes: DataFrame, arity: int, span: int) -> DataFrame:
    """Blocks of nodes (tree, n, idx, digest) become their top nodes.

    combineByKey: the tasks that have nodes combine them to partial blocks as
    they come; a parent whose last child has come is hashed at once, and only
    what a task knows of a block is shuffled, to meet the rest of it there.
    """

    def keyed(row: Row) -> tuple[tuple, Child]:
        block, place = divmod(row.idx, span)
        return (row.tree, block, row.n), (place, row.digest, arity, row.n, block, span)

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = nodes.select("tree", "n", "idx", "digest").rdd.map(keyed).combineByKey(_create, _add, _merge, parts).flatMap(lambda item: _links(item, span))
    return nodes.sparkSession.createDataFrame(found, f"tree string, n long, idx long, steps {_STEPS}, top string", verifySchema=False)


def forest(nodes: DataFrame, arity: int = 2, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Proofs (tree, idx, steps) of nodes (tree, n, idx, digest) up to the root of their tree, and the roots (tree, digest).

    idx counts the n nodes of a tree from 0.  While a tree has several nodes,
    every ``arity`` consecutive ones, the last of them maybe fewer, become
    one.  A round takes blocks of ``most`` nodes or so up to one node each, so
    rounds grow with the logarithm of the largest tree and a block's combiner
    is small, whatever the size of its tree.  Proofs go the other way: the
    steps within a block, then those of its top node.
    """
    span, rounds = _span(arity, most), []
    while (nodes.agg(F.max("n")).first()[0] or 0) > 1 or not rounds:
        rounds.append(_round(nodes, arity, span).checkpoint())
        nodes = rounds[-1].where("top IS NOT NULL").select("tree", F.ceil(F.col("n") / span).alias("n"), F.floor(F.col("idx") / span).alias("idx"), F.col("top").alias("digest"))
    proofs = rounds.pop().select("tree", "idx", "steps")
    while rounds:
        above = proofs.select(F.col("tree"), F.col("idx").alias("block"), F.col("steps").alias("more"))
        below = rounds.pop().select("tree", "idx", "steps", F.floor(F.col("idx") / span).alias("block"))
        proofs = below.join(above, ["tree", "block"]).select("tree", "idx", F.concat("steps", "more").alias("steps"))
    return proofs, nodes.select("tree", "digest")


def manifest(docs: DataFrame, fields: Sequence[str], key: str = "doc_id", tree: str = "lang", arity: int = 2, carry: Mapping[str, Column] | None = None, most: int = MOST) -> DataFrame:
    """key, leaf, subroot, root and proof of every row, and what ``carry`` names.

    A leaf is the digest of a row's fields.  The leaves of each value of
    ``tree`` ascend by key, every ``arity`` of them become one until their
    subroot is left (see forest()), and the subroots, by the value's bytes,
    null first, become the root likewise.  proof has a step for each level,
    the siblings before and after.

    Leaves are put in order by ranges, so that a value which most rows have
    is in no task alone.  Rows with null keys come first; of equal keys the
    smaller leaf does; rows that repeat are leaves for each; null fields are
    written as ``-``, empty texts as ``0:``; texts never leave the JVM, so
    they may have any length; an empty table gives an empty result; columns
    that aren't named play no part.
    """
    prepare(docs.sparkSession)
    # an order-preserving key that is never null
    part = F.when(F.col(tree).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(tree).cast("string")))
    more = carry or {}
    rows = docs.select(F.col(key).alias("key"), part.alias("tree"), digest_of([F.col(f) for f in fields]).alias("leaf"), *(c.alias(f"c{k}") for k, c in enumerate(more.values()))).checkpoint()
    sizes = rows.groupBy("tree").agg(F.count("*").alias("n")).checkpoint()
    numbered = rows.withColumn("row", F.monotonically_increasing_id())  # of a stored table, so that equal rows may be split
    placed = places_by_range(numbered, ["tree"], "key", "leaf", "row", place="idx").join(_near(sizes), "tree").checkpoint()
    proofs, subroots = forest(placed.select("tree", "n", "idx", F.col("leaf").alias("digest")), arity, most)
    subroots = subroots.checkpoint()
    ordered = places_by_range(subroots, [], "tree", place="idx").withColumn("n", F.lit(subroots.count()).cast("long")).checkpoint()
    upper, root = forest(ordered.select(F.lit("").alias("tree"), "n", "idx", "digest"), arity, most)
    roots = ordered.join(upper.drop("tree"), "idx").crossJoin(F.broadcast(root.select(F.col("digest").alias("root"))))  # one row
    roots = roots.select("tree", F.col("digest").alias("subroot"), F.col("steps").alias("more"), "root").checkpoint()
    found = placed.join(proofs, ["tree", "idx"]).join(_near(roots, F.lit(200) + 150 * F.size("more")), "tree")
    return found.select(F.col("key").alias(key), "leaf", "subroot", "root", F.concat("steps", "more").alias("proof"), *(F.col(f"c{k}").alias(name) for k, name in enumerate(more)))
