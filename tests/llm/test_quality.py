import hashlib
import re
import string
import math
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import _stats, cotrain, queries, rules, secrets, topk

SF = "/root/testdata/sf0.001"


def test_counts_of():
    got = dict(zip(_stats.COUNTS, _stats.counts_of("a # b\n\nx y\na # b\nx"), strict=True))
    assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == (9, 9, 2, 1, 0)


def brute_repeats(words):
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    return len({k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)})


def test_repeated_words():
    rng = random.Random(2)
    for _ in range(200):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 60))]
        assert _stats.repeated_words(words) == brute_repeats(words)


def test_trees_are_monotone_and_learn():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = (rng.random(3000) < 1 / (1 + np.exp(-6 * (x[:, 0] - x[:, 1])))).astype(float)
    trees = rules.fit_trees(x, y, np.array([1, -1, 0]))
    for f, sign in ((0, 1), (1, -1)):
        at = rng.random((200, 3))
        line = np.repeat(at[:, None, :], 30, axis=1)
        line[:, :, f] = np.linspace(0, 1, 30)
        steps = np.diff(trees.score(line.reshape(-1, 3)).reshape(200, 30), axis=1)
        assert (sign * steps >= -1e-12).all()
    assert ((trees.score(x) > 0) == (y > 0)).mean() > 0.75


def test_rules_rows(odd_docs, no_docs, labels):
    rows = rules.judge(odd_docs, labels).collect()
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r.doc_id is not None:
            words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])
            assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
            if len(words) < 500:
                assert r.n_repeat_words == brute_repeats(words)
            assert r.base_failed == (len(words) < 10 or 100 * r.n_repeat_words > 20 * len(words)) and not (r.base_failed and r.kept)
    assert rules.judge(no_docs, labels).count() == 0
    assert {r.kept != r.base_failed for r in rules.judge(odd_docs, labels.limit(0)).collect()} == {True}


def test_rules_against_plain_python(spark, odd_docs, labels):
    """Every count from its definition, and every verdict by walking the nodes one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    marks = spark.read.parquet(f"{SF}/labels.parquet")
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, set()).add(r.text or "")
    counts = _stats.document_counts(docs)
    x, y, names = rules.labelled_sample(counts, marks, 20_000)
    trees = rules.fit_trees(x, y, np.array([rules.MONOTONE.get(n, 0) for n in names]))
    for r in rules.judge(docs, marks).collect():
        if len(texts[r.doc_id]) > 1:
            continue
        text = next(iter(texts[r.doc_id]))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == want
        if len(words) < 400:
            assert r.n_repeat_words == brute_repeats(words)
        assert r.base_failed == (len(words) < 10 or 100 * r.n_repeat_words > 20 * len(words))
        row, score = _stats.features_of({c: np.array([r[c]]) for c in _stats.COUNTS})[1][0], trees.base
        for node in trees.roots.tolist():
            while trees.child[node] != node:
                node = int(trees.child[node]) + int(row[trees.feature[node]] > trees.threshold[node])
            score += trees.value[node]
        assert r.kept == (not r.base_failed and score >= 0) and abs(score - r.score) < 1e-9


def test_cotraining_rows(odd_docs, no_docs, labels):
    rows = cotrain.classify(odd_docs, labels, rounds=1).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.quality_score <= 1 for r in rows)
    assert cotrain.classify(no_docs, labels).count() == 0
    assert all(r.kept for r in cotrain.classify(odd_docs, labels.limit(0)).collect())
    kept = cotrain.keep_good(odd_docs, labels, rounds=1)
    assert kept.columns == odd_docs.columns


def test_all_confident_documents_are_exchanged(spark):
    """Neither a bound nor copies of one text decide what the views learn from each other."""
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    marks = marks.where("doc_id % 2 = 0")
    _, grams, table = cotrain.trained(docs, marks, rounds=0)
    one = table.where("quality IS NULL").orderBy("doc_id").limit(1)
    copies = one.crossJoin(spark.range(1000)).withColumn("doc_id", F.col("id") + 10**9).drop("id")
    model, again = (cotrain.fit(t, rounds=1, exchange=5) for t in (table, table.unionByName(copies)))
    first = cotrain.apply(table.where("quality IS NULL"), cotrain.fit(table, rounds=0))
    sure = F.array(*(((F.col(f"{v}_score") >= 0.95) | (F.col(f"{v}_score") <= 0.05)).cast("int") for v in ("text", "meta")))
    by_text = first.groupBy("text_hash").agg(*(F.sum(sure[v]).alias(f"n{v}") for v in (0, 1)), F.count("*").alias("rows"))
    least, most = by_text.agg(*(F.sum(sum((F.col(f"n{v}") >= k).cast("int") for v in (0, 1))) for k in (F.col("rows"), F.lit(1)))).first()
    assert 20 < least <= model.exchanged <= most  # copies may differ in metadata
    assert again.exchanged == model.exchanged and np.array_equal(again.text.beta, model.text.beta) and np.array_equal(again.meta.beta, model.meta.beta)


def test_cotraining_against_plain_python(spark):
    """One round on a small table, recomputed from the rows one by one."""
    docs, marks = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    _, grams, table = cotrain.trained(docs, marks.where("doc_id % 2 = 0"), rounds=0)
    rows = sorted((r.asDict() for r in table.collect()), key=lambda r: r["doc_id"])
    # grams: every labelled text by itself
    held = {r["doc_id"] for r in rows if r["quality"] is not None}
    words = {}
    for r in docs.collect():
        if r.doc_id in held:
            for w in {slot_of(w) for w in re.findall(r"[^\x20\x09-\x0D]+", r.text or "")}:
                words[w] = words.get(w, 0) + 1
    assert {k: int(n) for k, n in enumerate(grams.counts[:, :, 0].sum(axis=(0, 1))) if n} == words
    before, after = cotrain.fit(table, rounds=0), cotrain.fit(table, rounds=1, exchange=10, confidence=0.8)
    inputs = cotrain._inputs({c: [r[c] for r in rows] for c in cotrain.USED})
    cells = {"text": before.text.cells(inputs[0], inputs[2][:, :0]), "meta": before.meta.cells(inputs[1], inputs[2])}
    views = {"text": before.text, "meta": before.meta}
    seen, unlabelled = set(), []
    for k, r in enumerate(rows):
        if r["quality"] is None and r["text_hash"] not in seen:
            least = min((bytes(np.concatenate([cells["text"][j], cells["meta"][j]])), j) for j, o in enumerate(rows) if o["quality"] is None and o["text_hash"] == r["text_hash"])
            seen.add(r["text_hash"])
            unlabelled.append(least[1])
    labelled = [k for k, r in enumerate(rows) if r["quality"] is not None]
    fitted = [k for i, k in enumerate(labelled) if i % 5 != 4]
    y, total = np.array([rows[k]["quality"] for k in fitted], float), 0
    for giver, taker in (("text", "meta"), ("meta", "text")):
        view = views[taker]
        pull, bend = np.zeros(len(view.beta)), np.zeros((len(view.beta),) * 2)
        for good in (0, 1):
            given = [k for k in unlabelled if (p := cotrain._sigmoid(views[giver].logit(cells[giver][k : k + 1]))[0]) >= 0.8 and good or p <= 1 - 0.8 and not good]
            total += len(given)
            for k in given:
                x = view.design(cells[taker][k : k + 1])[0]
                q = cotrain._sigmoid(x @ view.beta)
                pull += 0.5 * min(len(given), 10) / len(given) * (good - q) * x
                bend += 0.5 * min(len(given), 10) / len(given) * q * (1 - q) * np.outer(x, x)
        x, beta, penalty = view.design(cells[taker][fitted]), view.beta.copy(), np.array([1e-6, *[1.0] * (len(view.beta) - 1)])
        for _ in range(12):
            q = cotrain._sigmoid(x @ beta)
            beta += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag(penalty) + bend, x.T @ (y - q) - penalty * beta + pull - bend @ (beta - view.beta))
        assert np.allclose(beta, getattr(after, taker).beta, atol=1e-3)
    assert after.exchanged == total and total > 0
    a, b = after.text.logit(cells["text"]), after.meta.logit(cells["meta"])
    both = 1 / (1 + np.exp(-(a + b - np.log(after.prior / (1 - after.prior)))))
    got = {r.doc_id: r.quality_score for r in cotrain.apply(table, after).collect()}
    assert all(abs(got[r["doc_id"]] - p) < 1e-9 for r, p in zip(rows, both, strict=True))


def test_both_views_hand_over_labels_and_change_verdicts(spark, monkeypatch):
    """Sources and words that both tell of quality, and texts of the middling kind whose words don't: what one view is sure of teaches the other."""
    rng = random.Random(2)
    good, bad, both = ([f"{c}{k}" for k in range(30)] for c in ("good", "bad", "plain"))
    rows, marks = [], []
    for i in range(1600):
        quality = i % 2
        own = both if rng.random() < 0.25 else good if quality else bad
        words = [rng.choice(own if rng.random() < 0.5 else both) for _ in range(40)]
        # sources of the second half are never labelled
        known = f"s{quality}{rng.randrange(3)}" if i < 800 else f"new{quality}{rng.randrange(3)}"
        rows.append((i, " ".join(words), "en", known if rng.random() < 0.97 else "s00", 200))
        if i < 160:
            marks.append((i, quality))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    given = []
    sums = cotrain.exchanged_sums
    monkeypatch.setattr(cotrain, "exchanged_sums", lambda *a: given.append({taker: sum(out[taker, g][0] for g in (0, 1)) for taker in ("text", "meta")} if (out := sums(*a)) else None) or out)
    scores = lambda rounds: {r.doc_id: r for r in cotrain.classify(docs, labels, rounds=rounds).collect()}
    before, after = scores(0), scores(3)
    assert len(given) == 3 and all(g["text"] > 100 and g["meta"] > 100 for g in given), given
    changed = [i for i in before if before[i].kept != after[i].kept]
    right = lambda found: np.mean([found[i].kept == bool(i % 2) for i in range(800, 1600)])
    assert changed and right(after) > right(before), (len(changed), right(before), right(after))


def test_sums_of_exchanges_are_added_up_in_a_tree(spark, monkeypatch):
    """The same sums from one part and from forty, of which no task and not the driver gets all."""
    docs, marks = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    _, _, table = cotrain.trained(docs, marks.where("doc_id % 2 = 0"), rounds=0)
    model = cotrain.fit(table, rounds=0)
    views = {"text": model.text, "meta": model.meta}
    cells = cotrain.unlabelled_cells(table, model.text, model.meta)
    one, many = (cotrain.exchanged_sums(cells.repartition(n).checkpoint(), views, views, 0.8) for n in (1, 40))
    assert sum(n for n, _, _ in one.values()) > 0
    for k in one:
        assert one[k][0] == many[k][0] and all(np.array_equal(a, b) for a, b in zip(one[k][1:], many[k][1:], strict=True))


def slot_of(word):
    import xxhash

    return xxhash.xxh32_intdigest(word) % cotrain.GRAM_SLOTS


def test_quality_of_held_out_labels(spark):
    """Trained on half of the labels, both models find the others right."""
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    half = marks.where("doc_id % 2 = 0")
    rest = marks.where("doc_id % 2 = 1").join(cotrain.classify(docs, half), "doc_id").join(rules.judge(docs, half).select("doc_id", F.col("kept").alias("ruled")), "doc_id").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rest]) > 0.95
    assert np.mean([r.ruled or r.quality == 0 for r in rest]) > 0.9 and np.mean([not r.ruled for r in rest if r.quality == 0]) > 0.75


ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_base(text):
    found = [(m.start(), 1, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 2, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 3, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def planted(spark):
    rng = random.Random(4)
    draw = lambda signs, n: "".join(rng.choice(signs) for _ in range(n))
    b62, hexa = string.digits + string.ascii_letters, string.digits + "abcdef"
    keys = [draw(b62, rng.randint(32, 60)) for _ in range(40)]
    texts = [f"Élan vital token={draw(b62, 12)} and é {k} end" for k in keys]
    texts += ["token=token: abcdefgh", 'API_KEY = "abc" passwd:\'abcdef\'', "AKIA" + "A" * 16, "AKIA" + "Z" * 10, draw(hexa, 40), draw(hexa, 23), "secret==abc123", "", None]
    natural = ["thequickbrownfoxjumpsoverthelazydog2024", "version_2024_release_candidate_build", "aaaaaaaaaaaaaaaaaaaaaaaa1111", "abcdefghijklmnopqrstuvwxyz0123456789", "/usr/local/lib/python3/site-packages/numpy"]
    texts += natural
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), keys, natural


def test_secret_spans(spark, odd_docs, no_docs):
    docs, keys, natural = planted(spark)
    found = 0
    for r in secrets.scan(docs).collect():
        assert [(s["start"], s["order"], s["end"], s["kind"]) for s in r.spans if s["order"] < 4] == brute_base(r.text or "")
        random_ = [(r.text or "")[s["start"] : s["end"]] for s in r.spans if s["kind"] == "random"]
        assert r.text not in natural or not random_
        found += sum(k in random_ for k in keys)
    assert found >= 36
    for r in secrets.scan(odd_docs).collect():
        assert [(s["start"], s["order"], s["end"], s["kind"]) for s in r.spans if s["order"] < 4] == brute_base(r.text or "")
    assert secrets.scan(no_docs).count() == 0 and secrets.scan(odd_docs).columns == ["doc_id", "text", "count", "spans"]


def test_keys_of_every_encoding_are_found(spark):
    """Among nine natural tokens for each key, 37 of 40 keys of each encoding and length, and 97 % of all."""
    rng = random.Random(9)
    up, low, dig = string.ascii_uppercase, string.ascii_lowercase, string.digits
    signs = {"hex": dig + "abcdef", "HEX": dig + "ABCDEF", "base32": up + dig[2:8], "base36": dig + low, "BASE36": dig + up, "base62": dig + up + low, "base64": up + low + dig + "+/", "base64url": up + low + dig + "-_"}
    keys = []
    for name, alphabet in signs.items():
        for n in (20, 24, 32, 40, 64):
            made = (("".join(rng.choice(alphabet) for _ in range(n))) for _ in iter(int, 1))
            mixed = (k for k in made if re.search("[0-9]", k) and re.search("[A-Za-z]", k))
            keys += [(name, n, next(mixed)) for _ in range(40)]
    words = "return the value of every option when network address table version buffer release status parser handle".split()
    natural = lambda: rng.choice("_-/").join([*(rng.choice(words) for _ in range(rng.randint(4, 7))), str(rng.randint(1, 2030))])
    texts = [" ".join([k, *(natural() for _ in range(9))]) for _, _, k in keys]
    found, wrong = dict.fromkeys(((name, n) for name, n, _ in keys), 0), 0
    for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        name, n, key = keys[r.doc_id]
        found[name, n] += any((s["start"], s["end"]) == (0, n) for s in r.spans)
        wrong += sum(s["start"] > 0 for s in r.spans)
    assert min(found.values()) >= 37 and sum(found.values()) >= 0.97 * len(keys), found
    assert wrong <= 0.01 * len(keys)


def brute_random(texts, rate=0.01):
    """The battery, both limits and the random spans of texts, number by number."""
    costs, signs = secrets._costs(), secrets.SIGNS
    found = []
    for d, text in enumerate(texts):
        for m in re.finditer(secrets.TOKEN, text or ""):
            x = m[0]
            alphabet = next((a for p, a in secrets.ENCODINGS if re.search(p, x)), None)
            if alphabet is None or not re.search("[0-9]", x) or not re.search("[A-Za-z]", x):
                continue
            n, size, values = len(x), len(alphabet), [alphabet.index(c) for c in x]
            chi = size / n * sum(x.count(c) ** 2 for c in alphabet) - n
            low = [2 * v < size for v in values]
            k = sum(low)
            runs = 1 + sum(a != b for a, b in zip(low, low[1:], strict=False))
            pairs = 2 * k * (n - k)
            z_runs = 99 if k in (0, n) else abs(runs - 1 - pairs / n) / math.sqrt(max(pairs * (pairs - n) / (n * n * (n - 1)), 0.01))
            mean, square = sum(values) / n, sum(v * v for v in values) / n
            z_serial = 99 if square <= mean * mean else math.sqrt(n) * abs(sum(a * b for a, b in zip(values, values[1:], strict=False)) / (n - 1) - mean * mean) / (square - mean * mean)
            df = size - 1
            z_chi = (max(chi / df, 0) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df))
            natural = sum(costs[a * len(signs) + b] for a, b in zip([0, *(signs.index(c) + 1 for c in x)], (signs.index(c) for c in x), strict=False))
            found.append((d, m.start(), m.end(), n, natural - n * math.log(size) - math.log(len(secrets.ENCODINGS)), max(z_chi, z_runs, z_serial, 0) ** 2 / 2 - math.log(3)))
    if not found:
        return set()
    weight = [2.0 ** int(math.log2(n)) for _, _, _, n, _, _ in found]
    weight = [math.log(w * len(found) / sum(weight)) for w in weight]

    def step_up(values, total):
        sure = [e for k, e in enumerate(sorted(values, reverse=True), 1) if total * math.exp(-e) <= rate * sum(v >= e - 1e-9 for v in values)]
        return min(sure, default=math.inf)

    grid = lambda v, step, top: math.floor(min(max(v, -step), top) / step) * step
    gains = [grid(f[4], secrets.STEP, secrets.STEP * secrets.STEPS) + w for f, w in zip(found, weight, strict=True)]
    doubts = [grid(f[5], secrets.DOUBT_STEP, secrets.DOUBT_STEP * secrets.DOUBT_STEPS) + w for f, w in zip(found, weight, strict=True)]
    limit = step_up([g for g, f in zip(gains, found, strict=True) if f[4] >= 0], len(found))
    passed = [k for k, f in enumerate(found) if f[4] >= 0 and gains[k] >= limit - 1e-9]
    doubted = step_up([doubts[k] for k in passed if found[k][5] >= 0], len(passed))
    out = set()
    for k in passed:
        d, a, b = found[k][:3]
        if doubts[k] < doubted - 1e-9 and not any(s < b and a < e for s, _, e, _ in brute_base(texts[d] or "")):
            out.add((d, a, b))
    return out


def test_battery_against_plain_python(spark):
    docs, _, _ = planted(spark)
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    rng = random.Random(12)
    texts += [" ".join(rng.choice(["".join(rng.choice("abcdefghij0123456789") for _ in range(24)), "a1b2" * 8, "0123456789abcdefghijklmnopqrst", "buffer_table_2024_version_stream", "Zz9" * 9]) for _ in range(4)) for _ in range(30)]
    got = {(r.doc_id, s["start"], s["end"]) for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect() for s in r.spans if s["kind"] == "random"}
    assert got == brute_random(texts) and len(got) > 30


def test_scan_and_redaction_take_linear_time(spark):
    import time

    rng = random.Random(6)
    took = []
    for n in (200, 4000, 16_000):
        text = "é😀 " + " ".join("".join(rng.choice("0123456789abcdef") for _ in range(24)) for _ in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        assert secrets.redact(docs).first().text == "é😀 " + " ".join(["[SECRET]"] * n)
        took.append(time.time() - began)
    assert took[2] < 8 * took[1] + 2  # quadratic time would be 16 times as much, and the first call compiles


def test_redaction_of_overlaps(spark):
    key = "0123456789abcdef" * 2
    texts = [f"token={key}", f"😀 secret: {key}{key} AKIA{'A' * 20}é", f"{key}AKIA{'Q' * 16}", f"a {key}", "token=abcdef;token=abcdef"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {}
    for k, text in enumerate(texts):
        out, at = "", 0
        for start, _, end, _ in brute_base(text):
            out += "" if start < at else text[at:start] + "[SECRET]"
            at = max(at, end)
        want[k] = out + text[at:]
    assert {r.doc_id: r.text for r in secrets.redact(docs).collect()} == want


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é password: hunter22 x"), (2, "clean"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in secrets.redact(docs).collect()} == {1: "é [SECRET] x", 2: "clean", 3: None}


@pytest.mark.parametrize("k,rows", [(20, 300), (3, 50), (20, 4)])
def test_top_k(spark, k, rows):
    rng = random.Random(rows)
    data = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.gauss(0, 1)]) for _ in range(6)]) for i in range(rows)]
    data += [(1000 + i, [0.25, 0.25, 0.0, 0.0, 0.0, 0.0]) for i in range(60 if rows > 4 else 0)]
    bad = [(5000, None), (None, [1.0] * 6), (5020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (5040, [float("nan")] * 6), (5060, [float("inf")] * 6)]
    df = spark.createDataFrame(data + bad, "vec_id long, embedding array<double>")
    whole = {i: np.floor(64 * np.array(v)).astype(int) for i, v in data}
    want = set()
    for q in whole:
        if q % 20 == 0:
            scored = sorted((-int(whole[q] @ whole[c]), c) for c in whole if c != q)[:k]
            want |= {(q, n, c, -s) for n, (s, c) in enumerate(scored, 1)}
    got = topk.top_k(df, F.col("id") % 20 == 0, k=k).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("size", [600.0, 1e6, 1e8, 1e12, 1e300])
def test_top_k_of_large_vectors(spark, size):
    rng = random.Random(int(min(size, 1e12)))
    data = [(i, [rng.uniform(-size, size) for _ in range(3)] if i % 3 else [rng.gauss(0, 1), -size, 0.0]) for i in range(50)] + [(100, [1.7e308 * (size > 1e200)] * 3)]
    whole = {i: [math.floor(min(max(64 * x, -sys.float_info.max), sys.float_info.max)) for x in v] for i, v in data}
    want = set()
    for q in (i for i in whole if i % 20 == 0):
        score = lambda c: min(max(sum(a * b for a, b in zip(whole[q], whole[c], strict=True)), -(2**63)), 2**63 - 1)  # noqa: B023, E731
        want |= {(q, n, c, -s) for n, (s, c) in enumerate(sorted((-score(c), c) for c in whole if c != q)[:5], 1)}
    got = topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, k=5).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want and len(got) == len(want)


def test_top_k_groups_of_blocks():
    assert topk.grid(1, 1, 32) == (1, 1)
    for queries, candidates, tasks in ((5, 100, 4000), (500, 10_000, 4000), (3, 7, 8)):
        a, b = topk.grid(queries, candidates, tasks)
        assert a <= queries and b <= candidates and a * b >= min(tasks, queries * candidates) / 2


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.col("id") % 20 == 0).count() == 0


def test_every_query_has_its_columns(spark):
    want = {
        "op2_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op3_histogram_top_k": ["query_id", "rank", "vec_id", "score"],
        "op6_randomness_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        "op9_hash_tree_shards": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        "op10_binary_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    }
    for name, columns in want.items():
        assert queries.queries()[name](spark, SF).columns == columns
    row = queries.queries()["op2_byte_bpe"](spark, SF).orderBy("doc_id").first()
    assert row.decoded_sha256 == hashlib.sha256(spark.read.parquet(f"{SF}/documents.parquet").where(f"doc_id = {row.doc_id}").first().text.encode()).hexdigest()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids, held = {r.doc_id for r in docs.collect()}, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, held, SF)
        if name != "packing":
            assert after.columns == docs.columns
            after = after.checkpoint()
            left = {r.doc_id for r in after.collect()}
            assert left <= ids
            ids, held = left, after
    assert {r.doc_id for r in after.collect()} == ids
