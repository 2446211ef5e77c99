import numpy as np
import public_tokenizers as P
from test_copies import brute_components
from test_quality import SF, brute_base, brute_random
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import cotrain


def whole_characters(text, cut):
    out, at = [], 0
    for sign in text:
        n = len(sign.encode())
        if not any(cut[at : at + n]):
            out.append(sign)
        at += n
    return "".join(out)


def cut_texts(rows, window=50):
    """Texts without repeated bytes, position by position; emptied ones go."""
    first = {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        for p in range(len(data) - window + 1):
            first.setdefault(data[p : p + window], i)
    out = {}
    for i, text in rows:
        data = (text or "").encode()
        cut = bytearray(len(data))
        for p in range(len(data) - window + 1):
            if first[data[p : p + window]] < i:
                cut[p : p + window] = b"\1" * window
        if not any(cut):
            out[i] = text
        elif (left := whole_characters(text, cut)).strip(" "):
            out[i] = left
    return out


def masked(texts):
    random = brute_random(list(texts.values()))
    out = {}
    for k, (i, text) in enumerate(texts.items()):
        spans = sorted([(s, e) for s, _, e, _ in brute_base(text or "")] + [(s, e) for d, s, e in random if d == k])
        made, at = "", 0
        for start, end in spans:
            made += "" if start < at else text[at:start] + "[SECRET]"
            at = max(at, end)
        out[i] = made + text[at:] if spans else text
    return out


def test_every_stage_against_plain_python(spark):
    stages = [f for _, f in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = {r.doc_id: r.text for r in docs.collect()}
    judged = stages[0](spark, docs, SF).checkpoint()
    kept = {r.doc_id for r in cotrain.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.kept}
    assert {r.doc_id: r.text for r in judged.collect()} == {i: held[i] for i in kept} and 0 < len(kept) < len(held)
    single = stages[1](spark, judged, SF).checkpoint()
    want, _ = brute_components([(i, held[i]) for i in kept])
    assert {r.doc_id: r.text for r in single.collect()} == {i: held[i] for i in kept if want[i] == i}
    cut = stages[2](spark, single, SF).checkpoint()
    want = cut_texts([(r.doc_id, r.text) for r in single.collect()])
    assert {r.doc_id: (r.text, r.n_chars) for r in cut.collect()} == {i: (t, len(t)) for i, t in want.items()}
    clean = stages[3](spark, cut, SF).checkpoint()
    want = masked({r.doc_id: r.text for r in cut.orderBy("doc_id").collect()})
    assert {r.doc_id: (r.text, r.n_chars) for r in clean.collect()} == {i: (t, len(t)) for i, t in want.items()}
    made = {}
    for r in sorted(stages[4](spark, clean, SF).collect(), key=lambda r: r.start):
        made[r.doc_id] = made.get(r.doc_id, b"") + bytes(r.ids)
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert made == {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for i, t in want.items()}


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    """Nulls, repeats, empty tables, and columns named like those that the stages use inside."""
    from pyspark.sql import functions as F

    clash = {c: F.lit(c) for c in ("kept", "c0", "c1", "t", "d", "tag", "base", "tokens", "doc", "__secrets", "__spans", "fold", "a.b")}
    for docs in (odd_docs.withColumns(clash), no_docs):
        left = docs
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, left, SF)
            if name == "packing":
                assert after.select("doc_id").distinct().count() == left.select("doc_id").distinct().count()
                break
            assert after.columns == docs.columns
            rows = after.collect()
            assert all(r[c] == c for r in rows for c in clash if c in docs.columns)
            assert docs is no_docs and not rows or any(r.doc_id is None for r in rows) or name == "quality classifier" or not left.where("doc_id IS NULL").count()
            left = after.checkpoint()
