import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import bpe, edits, packing

MULTI, PLAIN, WORDS = (P.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))


def library(path):
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


REFERENCE, REFERENCE_PLAIN = library(MULTI), library(PLAIN)
TOKENIZER = Tokenizer.from_file(WORDS)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200) | st.text(alphabet="ab '\n", max_size=300))
def test_encoder_equals_library(text):
    ids, lengths = bpe.encoder(MULTI, P.PATTERN)([text, ""])
    assert ids.tolist() == REFERENCE.encode_ordinary(text) and lengths.tolist() == [len(ids), 0]
    assert bpe.encoder(MULTI, P.PATTERN).vocabulary.decode(ids)[0].tobytes() == text.encode()


def test_long_pretokens():
    for text in ("a" * 20_000, "ab" * 5_000, " " * 5_000, "é" * 4_000, "abcabd" * 3_000):
        assert bpe.encoder(MULTI, P.PATTERN)([text])[0].tolist() == REFERENCE.encode_ordinary(text)


def test_dense_pretokens_in_linear_time():
    """Word-like and periodic strings, where merges enable others of lower rank."""
    import time

    rng = random.Random(4)
    code = bpe.encoder(MULTI, P.PATTERN)
    words = ["the", "ing", "tion", "and", "er", "abc", "x", "qu", "st", "é"]
    text = "".join(rng.choice(words) for _ in range(20_000))
    for t in (text, "abcabd" * 10_000, "the" * 20_000, "ing" * 8_000 + "tion" * 3_000):
        assert code([t])[0].tolist() == REFERENCE.encode_ordinary(t)
    for t in (text * 4, "abcabd" * 40_000):
        took = []
        for part in (t[: len(t) // 4], t):
            code.memo.clear()
            began = time.process_time()
            code([part])
            took.append(time.process_time() - began)
        assert took[1] < 10 * took[0] + 0.5  # quadratic time would be 16 times as much, of seconds


def test_rank_queue_order():
    from millrace.llm._merge import RankQueue

    rng = random.Random(1)
    queue, want = RankQueue(70_000), {}
    for _ in range(500):
        rank, at = rng.randrange(70_000), rng.randrange(1000)
        queue.push(rank, np.array([at]))
        want.setdefault(rank, set()).add(at)
    got = []
    while (x := queue.pop()) is not None:
        got.append((x[0], set(x[1].tolist())))
    assert got == sorted(want.items())


def test_encode_rows(odd_docs, no_docs):
    rows = bpe.decode(bpe.encode(odd_docs, MULTI, P.PATTERN), MULTI).collect()
    want = sorted(((r.doc_id if r.doc_id is not None else -1), tuple(REFERENCE.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in odd_docs.collect())
    assert sorted(((r.doc_id if r.doc_id is not None else -1), tuple(r.ids), bytes(r.data)) for r in rows) == want
    assert bpe.decode(bpe.encode(no_docs, MULTI, P.PATTERN), MULTI).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=150) | st.text(alphabet="aB.,' é\x1c\x85İ1", max_size=200))
def test_chunk_encoder_equals_library(text):
    got = packing.encoder(WORDS)([text, "end."])
    assert np.frombuffer(got[0], "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_special_strings_are_single_ids():
    texts = ["one <|startoftext|> two", "<|endoftext|>", "a<|endoftext|>b<|startoftext|><|startoftext|>c", "<|ENDOFTEXT|> <|endoftext", "ΑΣ<|endoftext|>Σ \u0301<|startoftext|>\u0301 e", "plain"]
    got = packing.encoder(WORDS)(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]
    assert 49406 in np.frombuffer(got[0], "<u4") and got[1] == np.array([49407], "<u4").tobytes()


def test_binary_lengths():
    for n in (1, 2, 7, 4095, 4096, 4097, 8192, 20_001):
        got = packing.binary_lengths(n, 4096)
        assert sum(got) == n and all(x & (x - 1) == 0 and x <= 4096 for x in got) and got == sorted(got, reverse=True)


def starts(n, most):
    at = 0
    for length in packing.binary_lengths(n, most):
        yield at, length
        at += length


def test_packing_covers_every_id(odd_docs, no_docs):
    rows = packing.pack(odd_docs, WORDS, 2, 512).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(1 << r.sequence_id % (1 << packing.LEVEL_BITS) == r.length for r in rows)
    assert all(r.offset == 0 and r.length == len(r.ids) // 4 for r in rows)
    made = {}
    for r in sorted(rows, key=lambda r: r.start):
        made.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    texts = {}
    for d in odd_docs.collect():
        ids = TOKENIZER.encode(d.text or "", add_special_tokens=False).ids + [2]
        texts.setdefault((d.doc_id, len(ids)), []).append(np.array(ids, "<u4").tobytes())
    for key, pieces in made.items():
        # repeated rows give each piece as often as they repeat; texts of one doc_id and length may differ, and then each has its own pieces
        want = sorted((at, ids[4 * at : 4 * (at + n)]) for ids in texts[key] for at, n in starts(len(ids) // 4, 512))
        assert sorted((p.start, bytes(p.ids)) for p in pieces) == want
    assert set(made) == set(texts)
    assert packing.pack(no_docs, WORDS).count() == 0


def test_checksums_of_pieces(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "some words " * 40)], "doc_id long, text string")
    ids = np.array([*TOKENIZER.encode("some words " * 40, add_special_tokens=False).ids, 2], "<u4")
    for r in packing.pack(docs, WORDS, 2, 64).withColumn("crc", F.crc32("ids")).collect():
        assert r.crc == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_edits_equal_full_recount():
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice(["a", "b", "the ", "  ", "'", "s", "re", "\n", " ", "1", "é", ".", "日"]) for _ in range(n))
    texts = [some(rng.choice([0, 1, 3, 10, 60, 300, 2000])) for _ in range(200)]
    made, final = [], []
    for text in texts:
        own = []
        for _ in range(rng.randint(0, 8)):
            a = rng.randint(0, len(text) + 2)
            b = a + rng.choice([0, 0, 1, 2, 5, 40])
            new = some(rng.choice([0, 1, 2, 6, 400]))
            own.append({"start": a, "end": b, "text": new})
            text = text[:a] + new + text[max(min(b, len(text)), min(a, len(text))) :]
        made.append(own)
        final.append(text)
    code = bpe.encoder(PLAIN, P.PATTERN)
    trees = [edits.TokenTree(t, *leaves) for t, leaves in zip(texts, edits.leaves_of(code, texts), strict=True)]
    for tree, (before, n, _), start, end, own in zip(trees, edits.recount(code, trees, made), texts, final, made, strict=True):
        text, chars, tokens = tree.whole()
        assert text == end and chars.tolist() == [len(p) for p in code.pieces(end)] and n == len(own) and tree.n_pieces == len(chars)
        assert (before, tree.tokens[1], tokens.sum(), tree.chars[1]) == (len(REFERENCE_PLAIN.encode_ordinary(start)), *[len(REFERENCE_PLAIN.encode_ordinary(end))] * 2, len(end))


def test_stored_leaves_spare_encoding(spark, monkeypatch):
    """Edits of a counted text encode what they touch and nothing else, from call to call."""
    texts = ["many common words in a row " * 300, "x", None]
    counted = edits.count(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PLAIN, P.PATTERN).collect()
    code = bpe.Encoder(bpe.Vocabulary(PLAIN), P.PATTERN)
    trees = [edits.TokenTree(r.text, np.array(r.piece_chars, np.int64), np.array(r.piece_tokens, np.int64)) for r in counted]
    asked = []
    learn = code.learn
    monkeypatch.setattr(code, "learn", lambda pieces, keep=False: learn(asked.extend(p := list(pieces)) or p, keep))
    for _ in range(3):
        numbers = edits.recount(code, trees, [[{"start": 4000, "end": 4004, "text": "other"}], [], []])
        assert numbers[0][2] < 12
    assert len(asked) < 60 and trees[0].tokens[1] == len(REFERENCE_PLAIN.encode_ordinary(trees[0].whole()[0]))


def test_edit_counts_rows(odd_docs, no_docs, spark):
    counted = edits.count(odd_docs, PLAIN, P.PATTERN)
    once = edits.edit(edits.revised(counted), PLAIN, P.PATTERN)
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    at_once = edits.edit(edits.revised(odd_docs.select("doc_id", "text")), PLAIN, P.PATTERN)
    assert sorted(map(tuple, once.fillna(-1, "doc_id").collect()), key=repr) == sorted(map(tuple, at_once.fillna(-1, "doc_id").collect()), key=repr)
    for rows, n in ((once, 1), (edits.edit(edits.revised(once.select("doc_id", "text", "piece_chars", "piece_tokens")), PLAIN, P.PATTERN), 2)):
        got = rows.collect()
        assert len(got) == odd_docs.count()
        for r in got:
            assert r.n_tokens == sum(r.piece_tokens) == len(REFERENCE_PLAIN.encode_ordinary(r.text)) and r.n_pieces == len(r.piece_chars) and r.n_edits == 4
            if r.doc_id is not None and n == 1:
                assert r.n_tokens_before == len(REFERENCE_PLAIN.encode_ordinary(texts[r.doc_id])) and r.text.startswith("It's ")
    assert edits.edit(edits.revised(edits.count(no_docs, PLAIN, P.PATTERN)), PLAIN, P.PATTERN).count() == 0
    none = spark.createDataFrame([(1, "abc", [3], [1], None), (2, None, None, None, [(None, None, None)])], "doc_id long, text string, piece_chars array<int>, piece_tokens array<int>, edits array<struct<start:int,end:int,text:string>>")
    assert {(r.doc_id, r.n_edits, r.n_tokens) for r in edits.edit(none, PLAIN, P.PATTERN).collect()} == {(1, 0, 1), (2, 1, 0)}
