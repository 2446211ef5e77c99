import random

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import recompress
from millrace.llm._symbols import boundaries, names_of, rounds_for, window_phrases, words_of


def brute(rows, window):
    """n_words, n_removed and kept of every document (doc_id, text), by comparing all windows."""
    first, out = {}, {}
    split = {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(split):
        for p in range(len(split[i]) - window + 1):
            first.setdefault(tuple(split[i][p : p + window]), (i, p))
    for i, words in split.items():
        gone = set()
        for p in range(len(words) - window + 1):
            if first[tuple(words[p : p + window])] < (i, p):
                gone.update(range(p, p + window))
        out[i] = (len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode())
    return out


def cut(docs, window=20):
    found = recompress.without_repeats(docs, window).collect()
    assert all(sum(s.end - s.start for s in r.spans) + len(r.kept.split()) == r.n_words for r in found)
    return {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), r.kept) for r in found}


def test_against_brute_force(spark, odd_docs):
    docs = odd_docs.where("doc_id IS NOT NULL")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert cut(docs) == brute(rows, 20)
    nameless = recompress.without_repeats(odd_docs.where("doc_id IS NULL")).collect()
    assert len(nameless) == 2 and all(not r.spans for r in nameless)
    found = recompress.without_repeats(odd_docs)
    assert found.count() == odd_docs.count() and found.columns == ["doc_id", "text", "count", "n_words", "spans", "kept"]


@pytest.mark.parametrize("window", [1, 4, 6, 20, 50])
def test_many_shapes_against_brute_force(spark, window):
    """Runs, periods, few words and many, shared passages with other neighbours, copies and repeats in one document."""
    rng = random.Random(window)
    passages = [[f"p{k}x{j}" for j in range(n)] for k, n in enumerate((12, 19, 20, 21, 40, 90))]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 5)):
            kind = rng.randrange(6)
            if kind == 0:
                words += ["run"] * rng.choice([1, 5, 30, 70])
            elif kind == 1:
                words += ["a", "b", "c"][: rng.randint(2, 3)] * rng.randint(1, 30)
            elif kind == 2:
                words += rng.choice(passages)
            elif kind == 3:
                words += [f"w{rng.randrange(3)}" for _ in range(rng.randint(1, 60))]
            else:
                words += [f"own{rng.randrange(10**9)}" for _ in range(rng.randint(1, 30))]
        rows.append((i * 7 % 120, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(1000 + k, rows[k][1]) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert cut(docs, window) == brute(rows, window)


def test_nothing(spark, no_docs):
    assert recompress.without_repeats(no_docs).count() == 0


def test_one_passage_in_all_documents(spark):
    """Different neighbours on both sides: the surroundings of the passage's ends are shared, its inner phrases are the same."""
    passage = " ".join(f"s{k}" for k in range(30))
    rows = [(k, f"{' '.join(f'l{k}x{j}' for j in range(25))} {passage} {' '.join(f'r{k}x{j}' for j in range(25))}") for k in range(300)]
    got = cut(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert got == brute(rows, 20) and sum(n for _, n, _ in got.values()) == 299 * 30


def sample(rng, words, n):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.mark.parametrize("window", [6, 20, 50])
def test_equal_windows_have_equal_anchors(window):
    rng = random.Random(window)
    for words in (1, 2, 3, 10, 1000):
        texts = [sample(rng, words, rng.choice([0, 1, window, 3 * window, 300])) for _ in range(10)]
        texts += [texts[-1] + " end", "start " + texts[-1], "x " * 3 * window, "x y " * window]
        sizes = np.array([len(t) for t in texts])
        data, starts = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum(sizes) - sizes
        begin, end, counts = words_of(data, starts, sizes)
        split = [t.split() for t in texts]
        assert counts.tolist() == [len(w) for w in split]
        owner, first, n, key, ident = window_phrases(names_of(data, begin, end, 0), names_of(data, begin, end, 1), counts, window)
        keys, told, seen = {}, {}, 0
        for o, a, m, k, i in zip(owner.tolist(), first.tolist(), n.tolist(), key.tolist(), ident.tolist(), strict=True):
            told.setdefault((k, i), set()).add(tuple(split[o][a : a + m + window - 1]))
            for p in range(a, a + m):
                keys.setdefault(tuple(split[o][p : p + window]), set()).add(k)
                seen += 1
        assert seen == sum(max(0, len(w) - window + 1) for w in split)
        assert all(len(k) == 1 for k in keys.values()) and all(len(w) == 1 for w in told.values())


def test_boundaries_depend_on_their_surroundings_only():
    rng = np.random.default_rng(3)
    rounds, reach = rounds_for(50)
    assert (rounds, reach, rounds_for(20), rounds_for(5)) == (3, 14, (2, 6), (0, 0))
    for words in (2, 4, 100):
        names = rng.integers(0, 2**63, words).astype(np.uint64)[rng.integers(0, words, 3000)]
        edge = np.zeros(3000, bool)
        edge[0] = True
        whole = set(boundaries(names, edge, rounds).tolist())
        for a in range(0, 2900, 37):
            part = names[a : a + 100]
            found = {a + p for p in boundaries(part, edge[: len(part)] | (np.arange(len(part)) == 0), rounds).tolist()}
            inside = range(a + reach, a + 100 - reach + 1)
            assert found & set(inside) == whole & set(inside)


def test_long_texts_are_parsed_in_stretches(monkeypatch):
    rng = random.Random(4)
    texts = [sample(rng, 50, n) for n in (900, 3, 100, 0, 19, 20, 2500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7), pa.int64()), pa.array([0] * 7, pa.int64()), pa.array(texts)], ["doc_id", "tag", "text"])

    def windows():
        doc, first, n, key, _ = recompress._Texts(batch).phrases(20)
        return {(d, p): k for d, a, m, k in zip(doc.tolist(), first.tolist(), n.tolist(), key.tolist(), strict=True) for p in range(a, a + m)}

    whole = windows()
    assert len(whole) == sum(max(0, len(t.split()) - 19) for t in texts)
    monkeypatch.setattr(recompress, "STRETCH", 100)
    assert windows() == whole


def test_frequent_phrases_go_on_once_a_task():
    minded = recompress._Minded()
    ident, ones = np.array([5, 6], np.uint64), np.zeros(2, np.int64)
    assert not minded.later(ident, np.array([9, 1]), np.array([10, 10]), ones, ones).any()
    assert minded.later(ident, np.array([1, 1]), np.array([11, 11]), ones, ones).tolist() == [True, False]
    assert not minded.later(ident, np.array([1, 1]), np.array([9, 9]), ones, ones).any()
    assert not minded.later(ident, np.array([1, 1]), np.array([9, 9]), ones, ones).any()
