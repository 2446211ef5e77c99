import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import jaccard, pfp, shards
from millrace.llm._phrases import phrases
from millrace.llm._shingles import shingle_sets
from millrace.operators.graph import components


def brute_components(rows):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        found = frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) or (frozenset([tuple(words)]) if words else frozenset())
        sets.setdefault(i, set()).add(found)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    flat = [(i, s) for i, own in sets.items() for s in own if s]
    for k, (i, a) in enumerate(flat):
        for j, b in flat[:k]:
            if 100 * len(a & b) >= 80 * len(a | b) and find(i) != find(j):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, sets


def test_jaccard_against_brute_force(odd_docs):
    membership, links = jaccard.jaccard_join(odd_docs)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id is not None]
    want, sets = brute_components(rows)
    got = membership.collect()
    assert len(got) == odd_docs.count()
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id] and r.n_shingles in {len(s) for s in sets[r.doc_id]}
        else:
            assert r.component_id is None
    assert {tuple(sorted(p)) for p in links.collect()}


def test_jaccard_on_near_copies(spark):
    import random

    rng = random.Random(7)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(120)] = f"edit{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = brute_components(rows)
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_join(docs)[0].collect()} == want
    kept = {r.doc_id for r in jaccard.keep_first(docs).collect()}
    assert kept == set(want.values())


def test_jaccard_of_nothing(no_docs):
    membership, links = jaccard.jaccard_join(no_docs)
    assert membership.count() == 0 and links.count() == 0


def test_shingle_sets_count():
    grams, n = shingle_sets(["a b c d e f", "a b", "", "A B C D E a b c d e", "a b c d e"])
    assert n.tolist() == [2, 1, 0, 5, 1]
    assert grams[-1] in grams[:2]


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (5, 5), (None, 1), (12, 3)], "a long, b long")
    assert {(r.id, r.component) for r in components(links).collect()} == {(1, 1), (2, 1), (3, 1), (12, 1), (6, 6), (7, 6), (8, 6), (9, 6)}


def test_a_token_of_all_documents_pairs_none(spark, monkeypatch):
    """Documents that share most of their words without linking: no candidates come of them."""
    shared = " ".join(f"common{k}" for k in range(60))
    texts = [f"{' '.join(f'own{i}x{j}' for j in range(20))} {shared}" for i in range(400)]
    seen = []
    meet = jaccard._meet_in_every_order
    monkeypatch.setattr(jaccard, "_meet_in_every_order", lambda pairs, *rest: seen.append(pairs.count()) or meet(pairs, *rest))
    membership, links = jaccard.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert all(r.component_id == r.doc_id for r in membership.collect()) and links.count() == 0
    assert seen[0] <= 4 * len(texts) and seen[1] == 0


@pytest.mark.parametrize("small", [0, 1_000_000])
def test_both_sides_of_small_lists(spark, monkeypatch, odd_docs, small):
    """Lists that are sent to every executor, and the same lists joined by shuffling."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(pfp, "SMALL", small)
    docs = odd_docs.where("doc_id IS NOT NULL")
    want, _ = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_join(docs)[0].collect()} == want
    assert sorted(spans_of(docs)) == brute_spans([(r.doc_id, (r.text or "").encode()) for r in docs.collect()])


def brute_spans(rows, window=50):
    first, want = {}, []
    for i, data in sorted(rows, key=lambda r: r[0]):
        for p in range(len(data) - window + 1):
            first.setdefault(data[p : p + window], i)
    for i, data in rows:
        covered = bytearray(len(data))
        for p in range(len(data) - window + 1):
            if first[data[p : p + window]] < i:
                covered[p : p + window] = b"\1" * window
        runs = sum(1 for k in range(len(data)) if covered[k] and not (k and covered[k - 1]))
        want.append((i, len(data), sum(covered), runs, hashlib.sha256(bytes(b for b, c in zip(data, covered, strict=True) if not c)).hexdigest()))
    return sorted(want)


def spans_of(docs):
    out = []
    for r in pfp.without_repeats(docs).collect():
        data = (r.text or "").encode()
        out.append((r.doc_id, len(data), len(data) - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()))
    return out


def test_spans_against_brute_force(odd_docs):
    got = sorted(x for x in spans_of(odd_docs) if x[0] is not None)
    assert got == brute_spans([(r.doc_id, (r.text or "").encode()) for r in odd_docs.collect() if r.doc_id is not None])


@pytest.mark.parametrize("salts", [1, 3])
@pytest.mark.parametrize("sent,many,stretch", [(64, 256, 1 << 19), (1, 1, 1 << 19), (2, 3, 70), (64, 256, 130)])
def test_span_steps_in_one_process(monkeypatch, sent, many, stretch, salts):
    """All steps on batches here, with limits so low that triggers are hot and texts are parsed in several stretches."""
    import random

    for name, value in (("SENT", sent), ("MANY", many), ("STRETCH", stretch)):
        monkeypatch.setattr(pfp, name, value)
    rng = random.Random(stretch + sent)
    words = [f"w{k}" for k in range(40)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(4)]
    rows = []
    for i in range(40):
        a, b = rng.choice(base), rng.choice(base)
        x, y = rng.randrange(len(a)), rng.randrange(len(b))
        rows.append((i * 3, (a[:x] + b[y:] + "é" * rng.randrange(3)).encode()))
    rng.shuffle(rows)

    def batch(part, **more):
        columns = {"doc_id": pa.array([i for i, _ in part], pa.int64()), "tag": pa.array([7] * len(part), pa.int64()), "text": pa.array([t.decode(errors="replace") for _, t in part])} | more
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    rows = [(i, t.decode(errors="replace").encode()) for i, t in rows]
    def shared(batches, kind):
        """What shares hand on, under the number of the whole part."""
        for b in batches:
            part = [p // salts if k == kind else p for k, p in zip(b.column("kind").to_pylist(), b.column("part").to_pylist(), strict=True)]
            yield b.set_column(1, "part", pa.array(part, pa.int64()))

    dealt = [x for part in (rows[:13], rows[13:25], rows[25:]) for x in pfp._parse(50, 5, salts)(iter([batch(part)]))]
    met = list(pfp._meet(True)(shared(pfp._meet(False)(iter(dealt)), "phrase") if salts > 1 else iter(dealt)))
    still = {}
    for b in met:
        for kind, doc, data in zip(*(b.column(c).to_pylist() for c in ("kind", "doc_id", "data")), strict=True):
            if kind == "open":
                still.setdefault(doc, []).append(data)
    mine = [r for r in rows if r[0] in still]
    again = [batch(part, open=pa.array([still[i] for i, _ in part])) for part in (mine[:9], mine[9:]) if part]
    opened = [x for b in again for x in pfp._open(50, 5, salts)(iter([b]))]
    if salts > 1:
        opened = list(shared(pfp._windows_meet(False, pfp._in_smaller)(iter(opened)), "window"))
    covered = {i: bytearray(len(t)) for i, t in rows}
    for b in (*met, *pfp._sort(50)(iter(opened))):
        for kind, doc, data in zip(*(b.column(c).to_pylist() for c in ("kind", "doc_id", "data")), strict=True):
            if kind == "known":
                for first, n in np.frombuffer(data, "<i4").reshape(-1, 2).tolist():
                    covered[doc][first : first + n + 49] = b"\1" * (n + 49)
    assert sorted((i, sum(c)) for i, c in covered.items()) == [(i, r) for i, _, r, _, _ in brute_spans(rows)]


def test_spans_of_repetitive_texts(spark):
    texts = ["ab" * 100, "ba" * 60, "x" * 200, "x" * 49, "x" * 50, "é" * 40, "z" + "é" * 40, "ab" * 30 + "q" * 60 + "x" * 60, "ab" * 100]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(spans_of(docs)) == brute_spans([(i, t.encode()) for i, t in enumerate(texts)])


def test_whole_characters(spark):
    """Characters that a span cuts go as a whole; genuine replacement characters stay."""
    texts = ["x" * 30 + "é" * 60, "é" * 60, "a\ufffdb " + "x" * 30 + "é" * 13 + "\ufffd", "日本語" * 40, "z" + "日本語" * 40 + "\ufffd"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pfp.without_repeats(docs, whole_characters=True).collect():
        data, out = r.text.encode(), b""
        cut = {k for s in r.spans for k in range(s["start"], s["end"])}
        at = 0
        for sign in r.text:
            n = len(sign.encode())
            out += b"" if cut & set(range(at, at + n)) else data[at : at + n]
            at += n
        assert bytes(r.kept) == out and out.decode() is not None
    kept = {r.doc_id: bytes(r.kept).decode() for r in pfp.without_repeats(docs, whole_characters=True).collect()}
    assert kept[2].startswith("a\ufffdb") and kept[4].endswith("\ufffd")


def test_texts_of_many_spans_take_linear_time(spark):
    import time

    one = "".join(chr(97 + k % 26) for k in range(7)) * 9
    took = []
    for n in (500, 4000, 16_000):
        rows = [(0, one), (1, "".join(f"{one}<{k}>" for k in range(n)))]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        began = time.time()
        got = next(r for r in pfp.without_repeats(docs).collect() if r.doc_id == 1)
        assert len(got.spans) == n and bytes(got.kept) == "".join(f"<{k}>" for k in range(n)).encode()
        took.append(time.time() - began)
    assert took[2] < 8 * took[1] + 3


def test_spans_of_nothing(no_docs):
    assert pfp.without_repeats(no_docs).count() == 0


def test_windows_have_one_phrase():
    rng = np.random.default_rng(1)
    parts = [rng.integers(97, 100, n).astype(np.uint8) for n in (10, 49, 50, 51, 400, 0, 300)]
    sizes = np.array([len(p) for p in parts])
    owner, first, n, key, ident = phrases(np.concatenate(parts), np.cumsum(sizes) - sizes, sizes)
    for d, size in enumerate(sizes):
        mine = owner == d
        assert n[mine].sum() == max(size - 49, 0) and (np.cumsum(n[mine]) - n[mine]).tolist() == first[mine].tolist()


def test_shards(odd_docs, no_docs):
    rows = shards.assign(odd_docs).collect()
    assert len(rows) == odd_docs.count() and shards.assign(no_docs).count() == 0
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40 and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((r.doc_id or -1, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in odd_docs.collect())
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in rows) == want


def drawn(key, tree, n=None):
    """A plain walk down the tree."""
    import math

    draw = lambda kind, node, j: -math.log((int(hashlib.md5(f"{kind}{node}:{j}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13)
    weight = lambda x: sum(map(weight, x.values())) if isinstance(x, dict) else x

    def descend(region, j):
        rack = min((draw("k", k, j) / weight(x), k) for k, x in region.items() if weight(x) > 0)[1]
        return min((draw("s", s, j) / w, s) for s, w in region[rack].items() if w > 0)[1]

    found = []
    for r, region in tree.items():
        places = [(s, w) for x in region.values() for s, w in x.items() if w > 0]
        if not any(n is None or s < n for s, _ in places):
            continue
        t = 0.0
        for j in range(shards.ATTEMPTS):
            t += draw("r", r, j) / weight(region)
            s = descend(region, j)
            if n is None or s < n:
                found.append((t, s))
                break
        else:
            found.append(min((t + draw("t", s, 0) / w, s) for s, w in places if s < n))
    return min(found)[1]


def test_shards_by_a_plain_walk(spark):
    from pyspark.sql import functions as F

    tree = shards.weighted(shards.even_tree(11), regions={0: 5.0}, racks={1: 3.0})
    tree[0][0][2] = 4.0
    tree[7] = {70: {700: 2.0, 701: 0.0}, 71: {}}
    assert abs(sum(sum(x.values()) for x in shards.weighted(shards.even_tree(20), regions={0: 5.0})[0].values()) - 5) < 1e-9
    rows = shards.with_shard(spark.range(500), F.col("id"), tree, "s").collect()
    assert [r.s for r in rows] == [drawn(r.id, tree) for r in rows]


@pytest.mark.parametrize(("n", "attempts"), [(1, 64), (1, 2), (9, 1), (16, 64), (17, 64), (17, 0), (40, 64), (41, 64)])
def test_places_that_are_not_there(spark, monkeypatch, n, attempts):
    """Arrivals at missing places are refused; after the last attempt the shards that are there draw."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(shards, "ATTEMPTS", max(attempts, 1))
    tree = shards.even_tree(n)
    rows = shards.with_shard(spark.range(300), F.col("id"), tree, "s", n).collect()
    assert [r.s for r in rows] == [drawn(r.id, tree, n) for r in rows] and all(r.s < n for r in rows)


def test_movement_stays_in_the_subtree_whose_weight_changes(spark):
    from pyspark.sql import functions as F

    tree = shards.even_tree(32)
    raised, rack, region, none = (shards.weighted(tree) for _ in range(4))
    raised[0][1][6] = 3.0
    rack = shards.weighted(tree, racks={2: 8.0})
    region = shards.weighted(tree, regions={1: 2.0})
    none[1][5][21] = 0.0
    df, trees = spark.range(6000), {"base": tree, "raised": raised, "rack": rack, "region": region, "none": none}
    for name, t in trees.items():
        df = shards.with_shard(df, F.col("id"), t, name)
    got = df.toPandas()
    moved = {n: got[got.base != got[n]] for n in ("raised", "rack", "region", "none")}

    def into(m, after, changed):
        """Level by level, keys move into the subtrees whose weight has risen only."""
        for size, at in ((16, changed // 16), (4, changed // 4), (1, changed)):
            across = m[(m.base // size) != (m[after] // size)]
            held = across if size == 16 else across[across.base // (4 * size) == across[after] // (4 * size)]
            assert (held[after] // size == at).all()

    assert len(moved["raised"]) and len(moved["rack"]) and len(moved["region"]) and len(moved["none"])
    into(moved["raised"], "raised", 6)
    into(moved["rack"], "rack", 8)
    assert (moved["region"].base >= 16).all() and (moved["region"].region < 16).all()
    # a weight that falls to nothing: keys leave its region, its rack, or it, and 21 has none
    left = moved["none"]
    assert (left.base // 16 == 1).all() and 21 not in set(got.none)
    inside = left[left.none // 16 == 1]
    assert (inside.base // 4 == 5).all() and (inside[inside.none // 4 == 5].base == 21).all()
    for name, t in trees.items():
        weights = {s: w for region in t.values() for rack in region.values() for s, w in rack.items()}
        share = got.groupby(name).size() / len(got)
        assert all(abs(share.get(s, 0) - w / sum(weights.values())) < 0.02 for s, w in weights.items())


def test_a_row_that_repeats_often(spark):
    docs = spark.range(5000).selectExpr("CASE WHEN id < 2500 THEN 7 ELSE id END AS doc_id", "CASE WHEN id < 2500 THEN 'same' ELSE 'x' END AS text")
    slots = {}
    for r in shards.assign(docs, 3).collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, slots.values())) == 5000 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_every_added_shard_takes_rows_only_into_itself(spark):
    from pyspark.sql import functions as F

    df = spark.range(4000).withColumnRenamed("id", "k")
    for n in (1, 2, 3, 4, 5, 15, 16, 17, 18, 33, 39, 40, 41):
        df = shards.with_shard(df, F.col("k"), shards.even_tree(n), f"s{n}", n)
    got = df.toPandas()
    for a in (1, 2, 3, 4, 15, 16, 17, 39, 40):
        if f"s{a + 1}" in got:
            moved = got[got[f"s{a}"] != got[f"s{a + 1}"]]
            assert (moved[f"s{a + 1}"] == a).all() and len(moved) > 0
    counts = np.bincount(got["s40"], minlength=40)
    assert counts.min() > 60 and counts.max() < 150


@pytest.mark.parametrize("operator", ["bytes", "words"])
def test_hot_phrases_meet_in_two_steps(spark, monkeypatch, operator):
    """A passage, and surroundings of a passage, in most documents: the same result by shares as at once, and no task gets an entry for every batch."""
    import random

    from millrace.llm import recompress

    rng = random.Random(6)
    line = " ".join(f"shared{k}" for k in range(24))
    texts = [" ".join([f"own{rng.randrange(10**9)}" for _ in range(rng.randint(5, 40))] + [line, *(["again and again the same words stand here " * 4] if i % 2 else [])] + [f"end{rng.randrange(10**9)}" for _ in range(30)]) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(900, texts[5])], "doc_id long, text string").repartition(12)
    module = pfp if operator == "bytes" else recompress
    spans = pfp.repeated_spans if operator == "bytes" else recompress.repeated_words
    found = lambda: sorted((r.doc_id, [tuple(s) for s in r.spans]) for r in spans(docs).collect())
    want = found()
    assert len(want) > 250
    monkeypatch.setattr(module, "_salts", lambda total, meet: 5)
    assert found() == want


def test_shares_hand_on_little():
    """What a share of a part hands on of one hot trigger, and of one phrase that all batches have."""
    rows = 600
    ids, tags = np.arange(rows), np.zeros(rows, np.int64)
    entries = np.zeros(rows, pfp.PHRASE)
    entries["ident"], entries["n"], entries["doc"] = np.arange(rows), 1, np.arange(rows)
    entries["ident"][300:] = 7
    entries["key"][300:, 0] = 1  # the second half is one phrase, the first many phrases of one trigger
    blobs = list(pfp._packed("phrase", np.zeros(rows, np.int64), entries, ids, tags))
    out = list(pfp._meet(False)(iter(blobs)))
    kinds = [k for b in out for k in b.column("kind").to_pylist()]
    sent = [d for b in out for k, d in zip(b.column("kind").to_pylist(), b.column("data").to_pylist(), strict=True) if k == "phrase"]
    left = pfp._unpacked(sent, pfp.PHRASE)[0]
    assert len(left) == 2 and sorted(left["n"].tolist()) == [1, 1 | pfp.MARK] and kinds.count("open") == 300 and kinds.count("known") == 299
