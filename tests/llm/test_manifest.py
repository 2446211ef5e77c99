import hashlib
import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import manifest

FIELDS = ["doc_id", "lang", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes, arity):
    """The root of nodes, and of each the siblings (before, after) of every level."""
    proofs, own = [[] for _ in nodes], [[k] for k in range(len(nodes))]  # own: the leaves below each node
    while len(nodes) > 1:
        above, below = [], []
        for a in range(0, len(nodes), arity):
            run = nodes[a : a + arity]
            for k in range(len(run)):
                for leaf in own[a + k]:
                    proofs[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(h(*run))
            below.append([leaf for k in range(len(run)) for leaf in own[a + k]])
        nodes, own = above, below
    return nodes[0], proofs


def plain(rows, arity):
    """Of each row (doc_id, lang, text), leaf, subroot, root and proof."""
    told = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    langs = {}
    for row in rows:
        langs.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, h(*map(told, row))))
    order = sorted(langs, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {lang: plain_tree([leaf for _, _, leaf in sorted(langs[lang])], arity) for lang in order}
    root, upper = plain_tree([trees[lang][0] for lang in order], arity)
    out = []
    for lang, more in zip(order, upper, strict=True):
        out += [(key if known else None, leaf, trees[lang][0], root, [*proof, *more]) for (known, key, leaf), proof in zip(sorted(langs[lang]), trees[lang][1], strict=True)]
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, lang string, text string, leaf string, idx int, n int")


@pytest.mark.parametrize(("arity", "most"), [(2, 1024), (2, 4), (3, 9), (5, 5), (1000, 10)])
def test_manifest_against_plain_python(spark, arity, most):
    rng = random.Random(arity)
    rows = [(k, rng.choice(["de", "fr", "日本", None, "", "de"]), rng.choice([None, "", "Été", "a" * 3000]) if k % 5 == 0 else f"text {k}") for k in range(90)]
    rows += [rows[7], rows[7], (None, "de", "x"), (None, None, None), (7, "de", "another text"), (900, "alone", "y")]
    found = manifest.manifest(table(spark, rows).repartition(5), FIELDS, arity=arity, most=most, carry={"again": manifest.digest_of([F.col(f) for f in FIELDS])})
    found = found.withColumn("folded", manifest.fold(F.col("leaf"), F.col("proof"))).withColumn("digest", manifest.proof_digest(F.col("proof"))).collect()
    order = lambda r: (str(r[0]), r[1], str(r[4]))
    got = sorted(((r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in found), key=order)
    assert got == sorted(plain(rows, arity), key=order)
    assert all(r.folded == r.root and r.again == r.leaf and r.digest == h(*(x for s in r.proof for x in s)) for r in found)


def test_a_changed_leaf_does_not_fold_to_the_root(spark):
    rows = [(k, "de", f"t{k}") for k in range(9)]
    found = manifest.manifest(table(spark, rows), FIELDS, carry={"other": manifest.digest_of([F.col("doc_id"), F.col("lang"), F.lit("changed")])})
    assert found.where(manifest.fold(F.col("other"), F.col("proof")) == F.col("root")).count() == 0


def test_manifest_of_one_row_and_of_nothing(spark):
    one = manifest.manifest(table(spark, [(1, "de", "x")]), FIELDS).first()
    assert one.leaf == one.subroot == one.root == h("1:1", "2:de", "1:x") and one.proof == []
    assert manifest.manifest(table(spark, []), FIELDS).count() == 0


def test_partial_blocks_meet_in_any_order():
    """Combiners that know different children of a block give the block's digests whatever the order in which they meet."""
    digests = [h(str(k)) for k in range(23)]
    root, _ = plain_tree(digests, 2)
    rng = random.Random(1)
    for _ in range(50):
        children = [(k, d, 2, 23, 0, 1024) for k, d in enumerate(digests)]
        rng.shuffle(children)
        parts = []
        for child in children:
            if parts and rng.random() < 0.7:
                k = rng.randrange(len(parts))
                parts[k] = manifest._add(parts[k], child)
            else:
                parts.append(manifest._create(child))
        while len(parts) > 1:
            rng.shuffle(parts)
            parts.append(manifest._merge(parts.pop(), parts.pop()))
        widths, _, known = parts[0]
        assert known[len(widths) - 1, 0] == root
