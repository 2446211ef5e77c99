"""Quality classification by co-training a text-content view and a page-metadata view."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import pieces_of, text_or_empty, trim
from ._stats import COUNTS, counts_of, features_of, find_words
from .rules import sample

#: What each view sees.  The text-content view has what words, signs and lines a text is made of; the metadata view a
#: page's language, source and declared length, and nothing of its text.
GRAMS = ("word_odds", "sign_odds")
TEXT_VIEW = (*GRAMS, "mean_word", "symbols", "repeats", "distinct", "upper", "digits", "marks", "stops", "longest_word", "words_a_line", "dup_lines", "lines", "line_length")
META_NUMBERS = ("declared",)
META_NAMES = ("lang", "source")
NAME_SLOTS = 64
#: Hash slots of words and of character trigrams (three bytes).
GRAM_SLOTS = 4096


class _Slots(dict):
    """A worker's memo of words' slots; it is emptied with the task that fills it."""

    def __missing__(self, word: str) -> int:
        found = self[word] = xxhash.xxh32_intdigest(word) % GRAM_SLOTS
        return found


_slots = _Slots()


def gram_slots(text: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The slots of a text's distinct words, in order, and the distinct slots of its character trigrams."""
    if len(_slots) > 200_000:
        _slots.clear()
    own = np.array([_slots[w] for w in dict.fromkeys(words)], np.int64)
    raw = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    signs = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761) >> np.uint32(20) if len(raw) > 2 else raw[:0]
    return own, np.flatnonzero(np.bincount(signs, minlength=GRAM_SLOTS))


@dataclass
class Grams:
    """How many labelled texts of each fold and class hold each slot: counts[fold, class, kind, slot], texts[fold, class]."""

    counts: np.ndarray
    texts: np.ndarray

    def odds(self, fold: int | None) -> np.ndarray:
        """Log odds of good quality by kind and slot; for a labelled text those of the other fold, so that it doesn't tell on itself."""
        use = [f for f in range(len(self.texts)) if f != fold]
        held, texts = self.counts[use].sum(axis=0), self.texts[use].sum(axis=0)
        rates = np.log((held + 1) / (texts + 2)[:, None, None])
        return rates[1] - rates[0]


FOLDS = 2


def _fold(key: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(7)), F.lit(FOLDS)).cast("int")


def learn_grams(docs: DataFrame, marks: DataFrame) -> Grams:
    """Grams of labelled documents: marks (doc_id, quality) are a sample of a bounded number.

    A document counts once, whatever its rows; only counts by slot leave the executors.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(marks), "doc_id")  # bounded by the sample
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select((_fold(F.col("doc_id")) * 2 + F.col("quality")).alias("group"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts = np.zeros((FOLDS * 2, 2 * GRAM_SLOTS), np.int64), np.zeros(FOLDS * 2, np.int64)
        for whole in batches:
            for batch in pieces_of(whole, "text"):
                for group, text in zip(batch.column("group").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    words, signs = gram_slots(text, find_words(text))
                    held[group, words] += 1  # once, however many words share a slot
                    held[group, GRAM_SLOTS + signs] += 1
                    texts[group] += 1
        group, slot = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.append(group, range(FOLDS * 2)), np.append(slot, [-1] * FOLDS * 2), np.append(held[group, slot], texts))], ["group", "slot", "n"])

    counts, texts = np.zeros((FOLDS * 2, 2 * GRAM_SLOTS), np.int64), np.zeros(FOLDS * 2, np.int64)
    for r in rows.mapInArrow(run, "group long, slot long, n long").groupBy("group", "slot").agg(F.sum("n").alias("n")).collect():  # at most one row a group and slot
        if r["slot"] < 0:
            texts[r["group"]] = r["n"]
        else:
            counts[r["group"], r["slot"]] = r["n"]
    return Grams(counts.reshape(FOLDS, 2, 2, GRAM_SLOTS), texts.reshape(FOLDS, 2))


class Describer:
    """COUNTS and GRAMS of texts; fold tells which labelled texts take the odds of the other fold (null: all labelled texts)."""

    def __init__(self, grams: Grams):
        self.odds = {f: grams.odds(f) for f in (None, *range(FOLDS))}

    def __call__(self, texts: list[str], folds: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
        counts, odds = np.zeros((len(texts), len(COUNTS)), np.int64), np.zeros((len(texts), 2))
        for k, (text, fold) in enumerate(zip(texts, folds, strict=True)):
            words = find_words(text)
            counts[k] = counts_of(text, words)
            table = self.odds[fold]
            odds[k] = [table[kind][own].mean() if len(own) else 0.0 for kind, own in enumerate(gram_slots(text, words))]
        return counts, np.round(odds * FRACTION) / FRACTION


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float, steps: int = 12) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the first column is the constant."""
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ beta)
        v = np.maximum(w * p * (1 - p), 1e-9)
        step = np.linalg.solve((x * v[:, None]).T @ x + np.diag(penalty), x.T @ (w * (y - p)) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


@dataclass
class View:
    """An additive model over quantile bins of numbers and hashed names, with its calibration."""

    edges: list[np.ndarray]
    beta: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def cells(self, numbers: np.ndarray, names: np.ndarray) -> np.ndarray:
        """The bin of every number and the slot of every name."""
        bins = [np.searchsorted(e, numbers[:, f], side="left") for f, e in enumerate(self.edges)]
        return np.stack([*bins, *names.T], axis=1).astype(np.uint8)

    def places(self, cells: np.ndarray) -> np.ndarray:
        """Columns of the design that are 1, besides the constant."""
        widths = [*(len(e) + 1 for e in self.edges), *[NAME_SLOTS] * (cells.shape[1] - len(self.edges))]
        return cells + np.cumsum([1, *widths[:-1]])

    def design(self, cells: np.ndarray) -> np.ndarray:
        widths = [*(len(e) + 1 for e in self.edges), *[NAME_SLOTS] * (cells.shape[1] - len(self.edges))]
        return np.concatenate([np.ones((len(cells), 1)), *(np.eye(w)[cells[:, f]] for f, w in enumerate(widths))], axis=1)

    def raw(self, cells: np.ndarray) -> np.ndarray:
        z = np.full(len(cells), self.beta[0])
        for column in self.places(cells).T:  # sums of a row never depend on its neighbours
            z += self.beta[column]
        return z

    def logit(self, cells: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(cells) + self.shift

    def calibrated(self, cells: np.ndarray, y: np.ndarray) -> View:
        """Calibrated on rows that took no part in the fit."""
        z = self.raw(cells)
        a = _logistic(np.stack([np.ones(len(z)), z], axis=1), y, np.ones(len(z)), ridge=0.05)
        return View(self.edges, self.beta, float(a[1]), float(a[0]))


def edges_of(numbers: np.ndarray, bins: int = 16) -> list[np.ndarray]:
    return [np.unique(np.quantile(numbers[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(numbers.shape[1])]


@dataclass
class CoTrained:
    """Both calibrated views, the share of good documents among the labelled ones and the number of texts of the last exchange."""

    text: View
    meta: View
    prior: float
    exchanged: int

    def score(self, inputs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality by the text view, by the metadata view and by both (views independent given quality)."""
        text, numbers, names = inputs
        a, b = self.text.logit(self.text.cells(text, names[:, :0])), self.meta.logit(self.meta.cells(numbers, names))
        return _sigmoid(a), _sigmoid(b), _sigmoid(a + b - np.log(self.prior / (1 - self.prior)))


def _inputs(columns: dict[str, np.ndarray | list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text features, metadata numbers and hashed names."""
    counts = {c: np.asarray(columns[c], np.int64) for c in COUNTS}
    known, x = features_of(counts)
    lines = np.maximum(counts["n_lines"], 1)
    more = {"lines": np.log1p(counts["n_lines"]), "line_length": np.log1p(counts["text_chars"] / lines), **{g: np.asarray(columns[g], np.float64) for g in GRAMS}}
    text = np.stack([more[n] if n in more else x[:, known.index(n)] for n in TEXT_VIEW], axis=1)
    numbers = {"declared": np.log1p(np.maximum(np.array([v or 0 for v in columns["n_chars"]], np.float64), 0))}
    slots: dict[str | None, int] = {}
    names = np.zeros((len(text), len(META_NAMES)), np.int64)
    for f, column in enumerate(META_NAMES):
        for at, v in enumerate(columns[column]):
            if v not in slots:
                slots[v] = xxhash.xxh32_intdigest(str(v)) % NAME_SLOTS
            names[at, f] = slots[v]
    return text, np.stack([numbers[n] for n in META_NUMBERS], axis=1), names


def _metadata(docs: DataFrame) -> list:
    kinds = {"lang": "string", "source": "string", "n_chars": "long"}
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]


def labelled(labels: DataFrame, most: int) -> DataFrame:
    """doc_id and quality of about ``most`` labelled documents at most; labels of one doc_id count once, the best of them."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().where("quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return sample(marks, most).checkpoint()


def described(docs: DataFrame, marks: DataFrame, grams: Grams) -> DataFrame:
    """Counts, odds, metadata and text hash of every document, with its label if marks has it, else null."""
    tell = Describer(grams)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *_metadata(docs))
    rows = rows.join(F.broadcast(marks), "doc_id", "left")  # bounded by the sample
    rows = rows.withColumn("fold", F.when(F.col("quality").isNotNull(), _fold(F.col("doc_id")))).withColumn("text_hash", F.xxhash64("text"))
    names = [c for c in rows.columns if c not in ("text", "fold")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, "text"):
                counts, odds = tell(batch.column("text").to_pylist(), batch.column("fold").to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(np.ascontiguousarray(c)) for c in (*counts.T, *odds.T))], [*names, *COUNTS, *GRAMS])
        _slots.clear()
        trim()

    fields = [f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names]
    return rows.mapInArrow(run, ", ".join([*fields, *(f"{n} long" for n in COUNTS), *(f"{g} double" for g in GRAMS)]))


USED = (*COUNTS, *GRAMS, "n_chars", *META_NAMES)
#: Places after the point, in bits, to which terms of sums over documents are rounded, so that their order is of no effect.
FRACTION = 2.0**20
#: Parts whose sums are added up in one task, and those that send theirs to the driver.
FAN, LAST = 32, 4


def unlabelled_cells(table: DataFrame, text: View, meta: View) -> DataFrame:
    """Cells of both views with the number of different unlabelled texts in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                t, numbers, names = _inputs({c: batch.column(c).to_pylist() for c in USED})
                cells = np.concatenate([text.cells(t, names[:, :0]), meta.cells(numbers, names)], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("text_hash"), pa.array([r.tobytes() for r in cells], pa.binary())], ["text_hash", "cells"])

    rows = table.where(F.col("quality").isNull()).mapInArrow(run, "text_hash long, cells binary")
    texts = rows.groupBy("text_hash").agg(F.min("cells").alias("cells"))
    return texts.groupBy("cells").agg(F.count("*").alias("n")).checkpoint()


def exchanged_sums(cells: DataFrame, givers: dict[str, View], takers: dict[str, View], confidence: float) -> dict[tuple[str, int], tuple[int, np.ndarray, np.ndarray]]:
    """For each taker and class, over all documents of which the other view is sure: their number, gradient and curvature of the log likelihood."""
    cut = len(TEXT_VIEW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list] = {}
        for batch in batches:
            both = np.frombuffer(b"".join(batch.column("cells").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            n = batch.column("n").to_numpy()
            own = {"text": both[:, :cut], "meta": both[:, cut:]}
            for giver, taker in (("text", "meta"), ("meta", "text")):
                p = _sigmoid(givers[giver].logit(own[giver]))
                for good in (0, 1):
                    at = p >= confidence if good else p <= 1 - confidence
                    x, q, m = takers[taker].design(own[taker][at]), _sigmoid(takers[taker].raw(own[taker][at])), n[at]
                    new = [m.sum(), x.T @ (m * np.round((good - q) * FRACTION) / FRACTION), (x * (m * np.round(q * (1 - q) * FRACTION) / FRACTION)[:, None]).T @ x]
                    sums[taker, good] = [a + b for a, b in zip(sums.get((taker, good), [0, 0.0, 0.0]), new, strict=True)]
        if sums:
            keys = list(sums)
            columns = [[k[0] for k in keys], [k[1] for k in keys], [int(sums[k][0]) for k in keys], [sums[k][1].tobytes() for k in keys], [sums[k][2].tobytes() for k in keys]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["taker", "good", "n", "slope", "bend"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                held = sums.setdefault((r["taker"], r["good"]), [0, 0.0, 0.0])
                held[:] = [held[0] + r["n"], held[1] + np.frombuffer(r["slope"]), held[2] + np.frombuffer(r["bend"])]
        if sums:
            rows = [(*k, n, slope.tobytes(), bend.tobytes()) for k, (n, slope, bend) in sums.items()]
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["taker", "good", "n", "slope", "bend"])

    total = {(v, g): (0, np.zeros(len(t.beta)), np.zeros((len(t.beta),) * 2)) for v, t in takers.items() for g in (0, 1)}
    fields = "taker string, good int, n long, slope binary, bend binary"
    sums_, parts = cells.mapInArrow(run, fields), cells.rdd.getNumPartitions()
    while parts > LAST:  # a tree: every task adds up the sums of some parts, so that no task and not the driver gets those of all
        parts = -(-parts // FAN)
        sums_ = sums_.repartition(parts).mapInArrow(add, fields)
    for r in sums_.collect():  # 4 rows a part, of a size that the views' bins give
        n, slope, bend = total[r.taker, r.good]
        total[r.taker, r.good] = (n + r.n, slope + np.frombuffer(r.slope), bend + np.frombuffer(r.bend).reshape(bend.shape))
    return total


def fit(table: DataFrame, rounds: int = 3, exchange: int = 500, confidence: float = 0.95) -> CoTrained | None:
    """Co-train on a table from described(); None if the labels are not of both kinds.

    A fifth of the labelled documents is held out for calibration.  In each
    round both views score every unlabelled text, and each hands the other
    all texts of either class whose calibrated probability reaches
    ``confidence``.  Copies of a text count once.  A class that a view hands
    over counts half a labelled document a text and round, and all its texts
    together no more than ``exchange`` texts would, so that labels keep their
    say however large the table is.  A round is one pass over the cells of
    unlabelled texts, in as many tasks as they have parts: gradient and
    curvature of what is handed over, at the taker's present weights, are
    added up from task to task in a tree and are all that leaves the
    executors, and the driver then fits labels and that second-order term
    together.
    """
    # one row a document, so that rows that repeat don't make the sample larger
    known = table.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min(F.struct("text_hash", "quality", *USED)).alias("r")).select("doc_id", "r.*")
    got = known.toPandas().sort_values("doc_id", kind="stable")
    y = got["quality"].to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return None
    text, numbers, names = _inputs({c: got[c].tolist() for c in USED})
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    check = held if held.any() else ~held
    prior = float(np.clip(y.mean(), 0.01, 0.99))
    views, own = {}, {}
    for view, x, z in (("text", text, names[:, :0]), ("meta", numbers, names)):
        blank = View(edges_of(x[~held]), np.zeros(0))
        own[view] = blank.cells(x, z)
        blank.beta = _logistic(blank.design(own[view][~held]), y[~held], np.ones((~held).sum()), ridge=1.0)
        views[view] = blank.calibrated(own[view][check], y[check])
    exchanged = 0
    cells = unlabelled_cells(table, views["text"], views["meta"]) if rounds else None
    for turn in range(1, rounds + 1):
        takers = {v: View(m.edges, m.beta) for v, m in views.items()}
        sums = exchanged_sums(cells, views, takers, confidence)
        exchanged = sum(n for n, _, _ in sums.values())
        for v, taker in takers.items():
            weight = {good: 0.5 * turn * min(sums[v, good][0], exchange) / max(sums[v, good][0], 1) for good in (0, 1)}
            pull = sum(weight[good] * sums[v, good][1] for good in (0, 1))
            bend = sum(weight[good] * sums[v, good][2] for good in (0, 1))
            takers[v] = View(taker.edges, _refit(taker.design(own[v][~held]), y[~held], taker.beta, pull, bend))
        views = {v: t.calibrated(own[v][check], y[check]) for v, t in takers.items()}
    return CoTrained(views["text"], views["meta"], prior, exchanged)


def _refit(x: np.ndarray, y: np.ndarray, start: np.ndarray, pull: np.ndarray, bend: np.ndarray, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    """Newton steps on labels, ridge and a second-order term with gradient ``pull`` and curvature ``bend`` at ``start``."""
    beta, penalty = start.copy(), np.full(len(start), ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        q = _sigmoid(x @ beta)
        slope = x.T @ (y - q) - penalty * beta + pull - bend @ (beta - start)
        curve = (x * np.maximum(q * (1 - q), 1e-9)[:, None]).T @ x + np.diag(penalty) + bend
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


SCORES = ("text_score", "meta_score", "quality_score")


def apply(table: DataFrame, model: CoTrained | None) -> DataFrame:
    """Adds text_score, meta_score and quality_score to a table from described(); without a model all are 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None or not batch.num_rows:
                scores = [np.ones(batch.num_rows)] * 3
            else:
                scores = model.score(_inputs({c: batch.column(c).to_pylist() for c in USED}))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(s) for s in scores)], [*batch.schema.names, *SCORES])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
    return table.mapInArrow(run, fields + "".join(f", {s} double" for s in SCORES))


def trained(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000, **fitting) -> tuple[CoTrained | None, Grams, DataFrame]:
    """The model of a corpus, the grams that it needs, and the table of all documents that it was fitted on."""
    marks = labelled(labels, most_labelled)
    grams = learn_grams(docs, marks)
    table = described(docs, marks, grams).checkpoint()
    return fit(table, **fitting), grams, table


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **fitting) -> DataFrame:
    """doc_id, text_score, meta_score, quality_score and kept for every document.

    kept: the combined calibrated probability of good quality is at least
    ``threshold``.  The model is fitted on a sample of about
    ``most_labelled`` labelled documents, those with a low hash of doc_id,
    and on all unlabelled ones.  A null text counts as empty; null metadata
    is a value of its own; columns lang, source and n_chars may be missing;
    rows with null doc_id are scored but never labelled; repeated rows are
    scored each for itself; texts of any length are read whole; an empty
    table gives an empty result; without labels of both kinds every document
    is kept with scores of 1.
    """
    model, _, table = trained(docs, labels, **fitting)
    return apply(table, model).select("doc_id", *SCORES, (F.col("quality_score") >= threshold).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **fitting) -> DataFrame:
    """The documents, with all their columns, that classify() keeps, on the same terms.

    Rows are scored where they lie: texts are counted once more instead of
    being shuffled to their scores.
    """
    marks = labelled(labels, fitting.pop("most_labelled", 20_000))
    grams = learn_grams(docs, marks)
    model = fit(described(docs, marks, grams).checkpoint(), **fitting)
    tell, names = Describer(grams), docs.columns
    body = docs.select(
        *(F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate(names)), F.col("doc_id").cast("long").alias("d"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"), *(c.alias(f"m{k}") for k, c in enumerate(_metadata(docs)))
    )
    known = marks.select(F.col("doc_id").alias("d"), _fold(F.col("doc_id")).alias("fold"))
    body = body.join(F.broadcast(known), "d", "left")  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, "t"):
                if model is not None:
                    counts, odds = tell(batch.column("t").to_pylist(), batch.column("fold").to_pylist())
                    meta = {c: batch.column(f"m{k}").to_pylist() for k, c in enumerate(("lang", "source", "n_chars"))}
                    score = model.score(_inputs(dict(zip(COUNTS, counts.T, strict=True)) | dict(zip(GRAMS, odds.T, strict=True)) | meta))[2]
                    batch = batch.filter(pa.array(score >= threshold))
                yield batch.select([f"c{k}" for k in range(len(names))])
        _slots.clear()
        trim()

    fields = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema.fields))
    return body.mapInArrow(run, fields).toDF(*names)
